"""Time series: buckets, statistics, rolling frames and moving averages over rows (series, seq, ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Aggregates of a bucket. First and last are by order of arrival (seq), not by time.
AGGREGATES: dict[str, Column] = {}


def _aggregates() -> dict[str, Column]:
    v = F.col("value")
    return {"mean": F.avg(v), "sum": F.sum(v), "min": F.min(v), "max": F.max(v), "count": F.count("*").cast("double"), "first": F.min_by("value", "seq"), "last": F.max_by("value", "seq"), "std": F.stddev_pop(v)}


def downsample(points: DataFrame, bucket: int, how: list[str], by: list[str] | None = None) -> DataFrame:
    """One row for each series and bucket of ts, `bucket` long (division cuts toward zero), with the aggregates named; no rows if bucket is not positive."""
    by = ["series"] if by is None else by
    if bucket <= 0:
        points, bucket = points.limit(0), 1
    known = _aggregates()
    start = F.expr(f"(ts div {bucket}L) * {bucket}L").alias("bucket")
    return points.groupBy(*by, start).agg(*[(F.round(known[h], 6) + 0.0).alias(h) for h in how])


def between(points: DataFrame, start: int, end: int) -> DataFrame:
    """Both ends count."""
    return points.where(F.col("ts").between(start, end))


def statistics(points: DataFrame) -> DataFrame:
    return points.groupBy("series").agg(F.count("*").alias("n"), (F.round(F.avg("value"), 6) + 0.0).alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def rolling(points: DataFrame, n: int) -> DataFrame:
    """points with the mean, population deviation, count and fullness of the last n rows of the series."""
    w = Window.partitionBy("series").orderBy("seq").rowsBetween(1 - n, 0)
    return points.select("series", "seq", "value", (F.round(F.avg("value").over(w), 6) + 0.0).alias("mean"), (F.round(F.stddev_pop("value").over(w), 6) + 0.0).alias("std"), F.count("*").over(w).alias("n"), (F.count("*").over(w) == n).alias("full"))


def moving_average(points: DataFrame, alpha: float) -> DataFrame:
    """Exponential moving average, the first being the first value: series, seq, ema of every row.

    The recursion is linear, so it runs in Arrow batches of a series in order; a batch hands on its last average.
    """
    import pandas as pd

    a = min(1.0, max(0.0, alpha))

    def run(frames):
        held: dict = {}
        for frame in frames:
            parts = []
            for name, rows in frame.groupby("series", sort=False):
                values = rows["value"]
                if name in held:
                    values = pd.concat([pd.Series([held[name]]), values])
                ema = values.ewm(alpha=a, adjust=False).mean() if a else pd.Series([values.iloc[0]] * len(values))
                held = {name: ema.iloc[-1]}
                parts.append(pd.DataFrame({"series": rows["series"].to_numpy(), "seq": rows["seq"].to_numpy(), "ema": ema.iloc[len(ema) - len(rows) :].to_numpy()}))
            if parts:
                yield pd.concat(parts)

    return points.select("series", "seq", "value").repartition("series").sortWithinPartitions("series", "seq").mapInPandas(run, "series string, seq long, ema double").withColumn("ema", F.round("ema", 6) + 0.0)


def drop_older(points: DataFrame, ts: int) -> DataFrame:
    """Retention: what is not older than ts."""
    return points.where(F.col("ts") >= ts)


def count_windows(rows: DataFrame, size: int, slide: int, order: str, by: list[str]) -> DataFrame:
    """Windows of `size` rows that begin every `slide` rows, the last ones partial: rows with window_no, once for each window that holds them.

    Rows of a key are numbered by a window function, hence keys should be many.
    """
    w = Window.partitionBy(*by).orderBy(order)
    n = F.row_number().over(w) - 1
    low = F.greatest(F.ceil((F.col("__n") - size + 1) / slide), F.lit(0)).cast("long")
    high = F.floor(F.col("__n") / slide).cast("long")
    return rows.withColumn("__n", n).where(F.col("__n") % slide < size).withColumn("window_no", F.explode(F.sequence(low, high))).drop("__n")


def as_of(probes: DataFrame, log: DataFrame, by: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """probes with the latest value of their key at or before their ts. One union and one window, so the cost is a sort and not a product."""
    names = probes.columns
    both = probes.select(*names, F.lit(None).cast(log.schema[value].dataType).alias("__v"), F.lit(1).alias("__probe")).unionByName(
        log.select(*by, ts, F.col(value).alias("__v"), F.lit(0).alias("__probe")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(ts, "__probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("as_of_value", F.last("__v", ignorenulls=True).over(w)).where("__probe = 1").select(*names, "as_of_value")
