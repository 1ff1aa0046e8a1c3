"""Streams over files as they come: micro-batches, event-time windows with watermarks, rate limits as state, change logs into collections.

Every job keeps its position and state in a checkpoint folder, so that a lost driver or executor
goes on where it stopped; `drain` works off what is there and ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vexel.functions import vector as V
from vexel.operators import storage
from vexel.operators.catalog import Catalog


def files(spark: SparkSession, path: str, schema: str, form: str = "parquet", per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a folder, at most so many a batch: what a bounded channel is to a push source."""
    read = spark.readStream.schema(schema).format(form)
    return (read.option("maxFilesPerTrigger", per_batch) if per_batch else read).load(path)


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", form: str = "parquet") -> StreamingQuery:
    """Appends what is there to the sink, exactly once, and ends."""
    q = stream.writeStream.format(form).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    return q


def drain_each(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Calls f with each micro-batch and its number. A batch can come a second time, with its old number, after a failure."""
    q = stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def drain_whole(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """The whole result of an aggregation, written anew by every batch."""
    return drain_each(stream, lambda df, _: df.write.mode("overwrite").parquet(sink), checkpoint, "complete")


def progress(q: StreamingQuery) -> dict[str, int]:
    """Batches, rows read and rows dropped as late, so far."""
    past = q.recentProgress
    late = sum(int(s["numRowsDroppedByWatermark"]) for p in past for s in p["stateOperators"])
    return {"batches": len(past), "rows": sum(p["numInputRows"] for p in past), "late": late}


def windows(stream: DataFrame, ts: str, size: str, slide: str | None, late: str, by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates of event-time windows; rows that are later than `late` are left out, and their windows closed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *by).agg(*aggregates).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "*").drop("window")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates of sessions: rows of a key with no gap as long as that between them."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(*aggregates).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "*").drop("session_window")


def once(stream: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key; keys are forgotten when the watermark has passed."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def rate_limit(stream: DataFrame, limit: int, window: int, key: str = "key", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """seq and accepted of a stream of requests: as governance.rate_limit, with the times of a key's last accepted requests as its state, at most `limit` of them. Rows of a batch are taken in the order of ts, then seq."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()

    def fold(name: tuple, frames, state: GroupState):
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([ts, seq])
        out = []
        for t in rows[ts].tolist():
            held = [x for x in held if x > t - window]
            out.append(len(held) < limit)
            if out[-1]:
                held.append(t)
        state.update((held,))
        yield pd.DataFrame({key: rows[key].to_numpy(), seq: rows[seq].to_numpy(), "accepted": out})

    return stream.select(key, ts, seq).groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {seq} long, accepted boolean", "held array<bigint>", "append", GroupStateTimeout.NoTimeout)


def vector_changes(changes: DataFrame, fields: list[str], key: str = "key", op: str = "op", data: str = "data") -> DataFrame:
    """Of database changes (key, op, data as a map of text): id, op, vector and seq columns. The vector has the fields that are numbers, in order; changes of the schema are dropped."""
    numbers = F.array(*[F.try_element_at(F.col(data), F.lit(f)).try_cast("float") for f in fields])
    rest = [c for c in changes.columns if c not in (key, op, data)]
    kept = changes.where(F.lower(op).isin("insert", "update", "delete"))
    return kept.select(F.col(key).cast("string").alias("id"), F.lower(op).alias("op"), F.filter(numbers, lambda x: x.isNotNull()).alias("vector"), F.to_json(data).alias("metadata"), *rest)


def into_collection(stream: DataFrame, catalog: Catalog, name: str, seq: str, checkpoint: str) -> StreamingQuery:
    """Applies a stream of changes (id, op, vector, metadata, seq) to a collection, a version for each batch. Applying a batch twice gives the same rows."""
    return drain_each(stream, lambda df, _: catalog.apply(name, df, seq), checkpoint)


def consolidate(memories: DataFrame, least: float = 0.7) -> DataFrame:
    """Short-term memories that are important enough to keep."""
    return memories.where(F.coalesce("importance", F.lit(0.0)) >= least)


def unexpired(rows: DataFrame, now: Column, ttl: str = "ttl", written: str = "written", capacity: int | None = None, used: str = "used") -> DataFrame:
    """A cache's content: rows whose time to live (seconds, null for ever) has not run out; of these, the `capacity` last used ones."""
    alive = rows.where(F.col(ttl).isNull() | (F.col(written) + F.col(ttl) > now))
    return alive if capacity is None else storage.last_n(alive, capacity, used)


def embedded(stream: DataFrame, embed: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Each row of a stream with its vector, at unit length."""
    return stream.withColumn("vector", V.normalize(embed(F.col(text))))
