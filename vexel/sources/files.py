"""Exports and loads by format, directories of texts, append-only logs, and files on any file system of Spark."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """Objects under a root, on whatever file system its URI names (local, HDFS, S3, Azure)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, prefix: str = "") -> list[str]:
        """Names directly under a folder, in order; none if it is not there."""
        path = self._path(self.at(prefix))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, name: str, data: bytes, overwrite: bool = True) -> None:
        stream = self._fs.create(self._path(self.at(name)), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def move(self, old: str, new: str) -> bool:
        """False if new is there already."""
        if self.exists(new):
            return False
        self._fs.mkdirs(self._path(self.at(new)).getParent())
        return self._fs.rename(self._path(self.at(old)), self._path(self.at(new)))

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self._path(self.at(name)), True)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a partition as one JSON array."""
    first = True
    for batch in batches:
        lines = [("[" if first and i == 0 else ",") + row for i, row in enumerate(batch.column(0).to_pylist())]
        first = first and not lines
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])


FORMATS = ("jsonl", "json", "csv", "parquet", "orc", "vectors_json", "vectors_csv")


def export(df: DataFrame, path: str, form: str = "jsonl", per_file: int | None = None, codec: str | None = None) -> None:
    """Writes df, in files of `per_file` rows at most if that is given.

    json has an array in each file; csv has a header, all values in quotes, doubled quotes, and nothing for null; the
    vector formats take columns id, vector and metadata, vectors_csv as id, dimension and numbers with ';' between.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}; one of {FORMATS}")
    if form == "vectors_csv":
        df = df.select("id", F.size("vector").alias("dimension"), F.concat_ws(";", F.col("vector").cast("array<string>")).alias("vector"))
    elif form == "vectors_json":
        df = df.select("id", "vector", "metadata")
    if form == "json":
        if per_file:
            df = df.repartition(max(1, -(-df.count() // per_file)))
        df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(_arrays, "value string").write.mode("overwrite").options(**({"compression": codec} if codec else {})).text(path)
        return
    writer = df.write.mode("overwrite")
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    if codec:
        writer = writer.option("compression", codec)
    if form in ("csv", "vectors_csv"):
        writer.options(header=True, quoteAll=True, escape='"', nullValue="", emptyValue="").csv(path)
    elif form in ("jsonl", "vectors_json"):
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.format(form).save(path)


def load(spark: SparkSession, path: str, form: str, schema: str) -> DataFrame:
    """What export wrote, with the schema given."""
    if form == "vectors_csv":
        rows = spark.read.options(header=True, escape='"').schema("id string, dimension int, vector string").csv(path)
        return rows.select("id", "dimension", F.transform(F.split("vector", ";"), lambda x: x.cast("float")).alias("vector"))
    if form == "csv":
        return spark.read.options(header=True, escape='"', nullValue="", multiLine=True).schema(schema).csv(path)
    if form == "json":
        return spark.read.option("multiLine", True).schema(schema).json(path)
    return spark.read.schema(schema).format({"jsonl": "json", "vectors_json": "json"}.get(form, form)).load(path)


def _by_line(spark: SparkSession, path: str, suffix: str, recursive: bool) -> bool:
    """Whether the first line of the first such file is a JSON value by itself; all of a folder's are taken to be alike."""
    rows = spark.read.format("binaryFile").options(pathGlobFilter=f"*{suffix}", recursiveFileLookup=recursive).load(path)
    first = rows.where("length > 0").select("path").orderBy("path").first()
    if first is None:
        return True
    line = spark.read.text(first.path).first()[0]
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def load_texts(spark: SparkSession, path: str, text: str = "text", metadata: tuple[str, ...] = (), suffixes: tuple[str, ...] = (".json", ".jsonl", ".csv", ".txt"), recursive: bool = True) -> DataFrame:
    """text, metadata (a map of the fields named that are there) and origin of every record of a file or folder whose text is not blank; a .json file has records by line or in an array, a .txt file is one record."""
    parts = []
    schema = ", ".join(f"`{c}` string" for c in (text, *metadata))
    for suffix in suffixes:
        read = spark.read.options(pathGlobFilter=f"*{suffix}", recursiveFileLookup=recursive)
        if suffix == ".txt":
            rows = read.option("wholetext", True).text(path).select(F.col("value").alias(text), *[F.lit(None).cast("string").alias(c) for c in metadata], F.col("_metadata.file_path").alias("origin"))
        elif suffix == ".csv":
            # A header can only be read where there is a file.
            if read.format("binaryFile").load(path).select("path").limit(1).isEmpty():
                continue
            rows = read.format("csv").options(header=True, escape='"', multiLine=True, enforceSchema=False).csv(path)
            rows = rows.select(*[(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in (text, *metadata)], F.col("_metadata.file_path").alias("origin"))
        else:
            rows = read.option("multiLine", suffix == ".json" and not _by_line(spark, path, suffix, recursive)).schema(schema).json(path).select(*[f"`{c}`" for c in (text, *metadata)], F.col("_metadata.file_path").alias("origin"))
        parts.append(rows)
    if not parts:
        parts = [spark.createDataFrame([], ", ".join(f"`{c}` string" for c in (text, *metadata, "origin")))]
    every = reduce(DataFrame.unionByName, parts).where(F.trim(F.col(f"`{text}`")) != "")
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").alias("v")) for c in metadata]) if metadata else F.array().cast("array<struct<k:string,v:string>>")
    return every.select(F.col(f"`{text}`").alias("text"), F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("metadata"), "origin")


def parse_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, text, error of every file in a folder, by its suffix: texts as they are, HTML without its tags, and a line of measures for PNG images and WAV sounds. Other suffixes have the kind 'unknown'; what cannot be parsed has an error."""

    @F.udf("struct<kind: string, text: string, error: string>")
    def parse(name: str, data: bytes):
        import html
        import io
        import re
        import struct
        import wave

        suffix = name.rsplit(".", 1)[-1].lower()
        try:
            if suffix in ("txt", "md", "csv", "json", "jsonl"):
                return "text", data.decode(), None
            if suffix in ("html", "htm"):
                plain = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", data.decode())
                return "html", " ".join(html.unescape(plain).split()), None
            if suffix == "png":
                if data[:8] != b"\x89PNG\r\n\x1a\n":
                    raise ValueError("no PNG signature")
                return "image", "{} x {}".format(*struct.unpack(">II", data[16:24])), None
            if suffix == "wav":
                with wave.open(io.BytesIO(data)) as w:
                    return "audio", f"{w.getnchannels()} channels, {w.getframerate()} Hz, {w.getnframes()} frames", None
            return "unknown", None, f"no parser for .{suffix}"
        except Exception as e:
            return {"png": "image", "wav": "audio"}.get(suffix, "text"), None, str(e)

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", parse("path", "content").alias("x")).select("path", "x.*")


class Log:
    """An append-only log of JSON lines in segments; a segment that is beyond `most` bytes is closed."""

    def __init__(self, spark: SparkSession, root: str, most: int = 64 << 20):
        self.files, self.most = Files(spark, root), most
        self._sizes: dict[str, int] = {}

    def append(self, entries: list[dict]) -> None:
        """Each call is a file of its own, since object stores cannot append; files of a segment share its number."""
        data = "".join(json.dumps(e) + "\n" for e in entries).encode()
        names = self.files.names()
        segment = int(names[-1].split("-")[0]) if names else 0
        held = sum(self._size(n) for n in names if int(n.split("-")[0]) == segment)
        if held and held + len(data) > self.most:
            segment += 1
        self.files.write(f"{segment:08d}-{len(names):08d}-{uuid.uuid4().hex}.jsonl", data, overwrite=False)

    def _size(self, name: str) -> int:
        if name not in self._sizes:
            self._sizes[name] = self.files._fs.getFileStatus(self.files._path(self.files.at(name))).getLen()
        return self._sizes[name]

    def segments(self) -> int:
        return len({n.split("-")[0] for n in self.files.names()})

    def read(self, schema: str) -> DataFrame:
        return self.files.spark.read.schema(schema).json(self.files.root)

    def replay(self, schema: str, key: str, order: str, op: str = "op") -> DataFrame:
        """The state after all entries: of each key the last one, without those deleted."""
        from vexel.operators.storage import latest

        return latest(self.read(schema), key, order).where(F.col(op) != "delete")


def sensor_records(messages: DataFrame, value: str = "value") -> DataFrame:
    """kind, at (seconds), frame, reading (JSON) of sensor messages in JSON text; a message without a kind or a stamp is dropped."""
    m = F.try_parse_json(F.col(value))
    get = lambda path, kind: F.try_variant_get(m, path, kind)
    at: Column = get("$.header.stamp.sec", "bigint") + F.coalesce(get("$.header.stamp.nanosec", "bigint"), F.lit(0)) / 1e9
    return messages.select(get("$.kind", "string").alias("kind"), at.alias("at"), get("$.header.frame_id", "string").alias("frame"), F.to_json(get("$.data", "variant")).alias("reading")).where("kind is not null and at is not null")
