"""SQL statements on collections of a catalogue: SELECT by Spark, INSERT, UPDATE, DELETE, CREATE INDEX and DROP as new versions."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.operators.catalog import Catalog

_NAME = r"([A-Za-z_]\w*)"
_INSERT = re.compile(rf"(?is)^\s*insert\s+into\s+{_NAME}\s*\(([^)]*)\)\s*(values\b.*|select\b.*)$")
_DELETE = re.compile(rf"(?is)^\s*delete\s+from\s+{_NAME}(?:\s+where\s+(.*))?$")
_UPDATE = re.compile(rf"(?is)^\s*update\s+{_NAME}\s+set\s+(.*?)(?:\s+where\s+(.*))?$")
_INDEX = re.compile(rf"(?is)^\s*create\s+index\s+{_NAME}\s+on\s+{_NAME}\s*\(([^)]*)\)\s*$")
_DROP = re.compile(rf"(?is)^\s*drop\s+table\s+{_NAME}\s*$")


def execute(catalog: Catalog, text: str) -> DataFrame | int | bool:
    """A SELECT's rows, or how many rows a statement changed, or whether it did what it says.

    Collections are views with the columns id, vector and metadata.  Rows that are inserted without an id get one.
    CREATE INDEX writes the collection in the order of its columns, by which Parquet then skips row groups.
    """
    text = text.strip().rstrip(";")
    spark = catalog.spark
    if m := _INSERT.match(text):
        names = [c.strip() for c in m[2].split(",")]
        source = f"SELECT * FROM {m[3]} AS t" if m[3].lower().startswith("values") else m[3]
        if not m[3].lower().startswith("values"):
            _views(catalog)
        rows = spark.sql(source).toDF(*names)
        if "id" not in names:
            rows = rows.withColumn("id", F.concat(F.lit("id_"), F.expr("uuid()")))
        n = rows.count()
        catalog.insert(m[1], rows)
        return n
    if m := _DELETE.match(text):
        rows = catalog.read(m[1])
        return catalog.delete(m[1], (rows.where(m[2]) if m[2] else rows).select("id"))
    if m := _UPDATE.match(text):
        rows = catalog.read(m[1])
        put = dict(re.findall(rf"(?is){_NAME}\s*=\s*(.*?)(?=,\s*[A-Za-z_]\w*\s*=|$)", m[2]))
        if unknown := put.keys() - {"vector", "metadata"}:
            raise ValueError(f"cannot set {sorted(unknown)}")
        some = rows.where(m[3]) if m[3] else rows
        return catalog.update(m[1], some.select("id", *[F.expr(put[c]).alias(c) if c in put else F.lit(None).cast(t).alias(c) for c, t in (("vector", "array<float>"), ("metadata", "string"))]))
    if m := _INDEX.match(text):
        columns = [c.strip() for c in m[3].split(",")]
        catalog._write(m[2], catalog.read(m[2]).repartitionByRange(*columns).sortWithinPartitions(*columns))
        about = catalog.describe(m[2])
        catalog.files.write(f"{m[2]}/meta.json", json.dumps(about | {"indexes": about.get("indexes", {}) | {m[1]: columns}}).encode())
        return True
    if m := _DROP.match(text):
        return catalog.drop(m[1])
    if re.match(r"(?is)^\s*(select|with)\b", text):
        _views(catalog)
        return spark.sql(text)
    raise ValueError(f"unsupported statement: {text[:60]!r}")


def _views(catalog: Catalog) -> None:
    for name in catalog.names():
        catalog.read(name).createOrReplaceTempView(name)
