"""Access rules, rate limits, node health, metrics and storage tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUNDS = (1, 5, 10, 50, 100, 500, 1000, 5000)


def effective_permissions(users: DataFrame, grants: DataFrame, parents: DataFrame) -> DataFrame:
    """user, permission, allowed: users (user, role), grants (role, permission, effect), parents (role, parent). Roles inherit from one level; a deny wins over any allow."""
    roles = users.select("user", "role").union(users.join(parents, "role").select("user", F.col("parent").alias("role"))).distinct()
    return roles.join(grants, "role").groupBy("user", "permission").agg((F.bool_or(F.col("effect") == "allow") & ~F.bool_or(F.col("effect") == "deny")).alias("allowed"))


def match_policies(requests: DataFrame, policies: DataFrame, few: int = 1000) -> DataFrame:
    """requests (request_id, subject, resource, action) with allowed: by the first policy (priority, subject, resource, action, effect) that fits, '*' fitting all; false if none does.

    Up to `few` policies are one array that each request looks through in its row; more of them are joined once for each pattern of wildcards, by equality.
    """
    keys = ["subject", "resource", "action"]
    if policies.count() <= few:
        ordered = policies.agg(F.array_sort(F.collect_list(F.struct("priority", "effect", *keys))).alias("__p"))
        fits = lambda p: (p["subject"].isin("*") | (p["subject"] == F.col("subject"))) & (p["resource"].isin("*") | (p["resource"] == F.col("resource"))) & (p["action"].isin("*") | (p["action"] == F.col("action")))
        first = F.try_element_at(F.filter("__p", fits), F.lit(1))
        return requests.crossJoin(F.broadcast(ordered)).select(*requests.columns, F.coalesce(first["effect"] == "allow", F.lit(False)).alias("allowed"))
    parts = None
    for mask in range(8):
        fixed = [k for i, k in enumerate(keys) if mask >> i & 1]
        some = policies.where(" and ".join(f"{k} {'<>' if k in fixed else '='} '*'" for k in keys)).select(*fixed, "priority", "effect")
        hit = (requests.join(some, fixed) if fixed else requests.crossJoin(some)).select("request_id", "priority", "effect")
        parts = hit if parts is None else parts.union(hit)
    first = parts.groupBy("request_id").agg(F.min(F.struct("priority", "effect")).alias("m"))
    return requests.join(first, "request_id", "left").select(*requests.columns, F.coalesce(F.col("m.effect") == "allow", F.lit(False)).alias("allowed"))


def rate_limit(requests: DataFrame, limit: int, window: int, key: str = "key", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """requests (key, ts, seq) with accepted: whether fewer than `limit` accepted requests of the key lie within `window` before it. Only accepted ones count, so this is a fold over a key's rows in order; it runs over sorted Arrow batches and keeps `limit` times a key."""
    import pandas as pd
    from collections import deque

    kind = requests.schema[key].dataType.simpleString()

    def run(frames):
        current, held = object(), deque()
        for frame in frames:
            out = []
            for k, t in zip(frame[key].tolist(), frame[ts].tolist()):
                if k != current:
                    current, held = k, deque()
                while held and held[0] <= t - window:
                    held.popleft()
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(t)
            yield pd.DataFrame({key: frame[key], seq: frame[seq], "accepted": out})

    return requests.select(key, ts, seq).repartition(key).sortWithinPartitions(key, ts, seq).mapInPandas(run, f"{key} {kind}, {seq} long, accepted boolean")


def health(beats: DataFrame, now: Column, degraded: float, unhealthy: float, offline: float) -> DataFrame:
    """node, last_seen, status by the age of the last heartbeat (node, ts)."""
    age = now - F.col("last_seen")
    status = F.when(age > offline, "offline").when(age > unhealthy, "unhealthy").when(age > degraded, "degraded").otherwise("healthy")
    return beats.groupBy("node").agg(F.max("ts").alias("last_seen")).withColumn("status", status)


def histogram(samples: DataFrame, by: list[str], bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """Cumulative buckets of value, cut to whole numbers: by, bound, n."""
    whole = F.floor("value").cast("long")
    counts = samples.groupBy(*by).agg(*[F.count_if(whole <= b).alias(f"b{b}") for b in bounds])
    return counts.select(*by, F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("bound"), F.col(f"b{b}").alias("n")) for b in bounds])).alias("x")).select(*by, "x.bound", "x.n")


def request_metrics(requests: DataFrame, by: list[str], ok: Column, latency: str = "value") -> DataFrame:
    return requests.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.min(latency).alias("least"), F.max(latency).alias("greatest"), (F.round(F.avg(latency), 6) + 0.0).alias("mean"))


def counters(samples: DataFrame) -> DataFrame:
    """Sums of value by name and labels (a map, whatever the order of its keys)."""
    return samples.groupBy("name", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels")))).alias("labels")).agg((F.round(F.sum("value"), 4) + 0.0).alias("value"))


def alerts(gauges: DataFrame, rules: DataFrame) -> DataFrame:
    """name, value, rule of the rules (rule, name, kind, threshold) that gauges (name, value) set off."""
    fires = F.when(F.col("kind") == "above", F.col("value") > F.col("threshold")).when(F.col("kind") == "below", F.col("value") < F.col("threshold")).otherwise(F.abs(F.col("value") - F.col("threshold")) < 0.001)
    return gauges.join(rules, "name").where(fires).select("name", "value", "rule")


def rate_alerts(samples: DataFrame, seconds: int, most: float, by: list[str], ts: str = "ts") -> DataFrame:
    """by, bucket (start, in microseconds) and rate (per second) of the spans of time in which a key has more than `most` samples a second."""
    start = F.expr(f"({ts} div {seconds * 1_000_000}L) * {seconds * 1_000_000}L").alias("bucket")
    return samples.groupBy(*by, start).agg(F.round(F.count("*") / seconds, 6).alias("rate")).where(F.col("rate") > most)


def exposition(metrics: DataFrame) -> DataFrame:
    """One line of text, name{labels} value, for each metric (name, labels as a map or none, value)."""
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), pairs(F.col("labels")), F.lit("}"))).otherwise("") if "labels" in metrics.columns else F.lit("")
    return metrics.select(F.concat(F.col("name"), labels, F.lit(" "), F.col("value").cast("string")).alias("line"))


def decision_statistics(decisions: DataFrame, least: float = 0.7) -> DataFrame:
    """One row on decisions (action, confidence): n, mean, least, greatest, the share at or above `least`, and the number of actions."""
    c = F.col("confidence")
    return decisions.agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("least"), F.max(c).alias("greatest"), F.round(F.avg((c >= least).cast("int")), 6).alias("sure"), F.count_distinct("action").alias("actions"))


def decision_history(decisions: DataFrame, n: int, order: str, wanted: dict) -> DataFrame:
    """Of the last n decisions, those with the values wanted."""
    last = decisions.orderBy(F.desc(order)).limit(n)
    for name, value in wanted.items():
        last = last.where(F.col(name) == value)
    return last


def audit(events: DataFrame, limit: int, order: str, user: str | None = None, action: str | None = None, failed: bool | None = None) -> DataFrame:
    """The newest audit events (user, action, success), of a user, an action or an outcome."""
    for name, value in (("user", user), ("action", action), ("success", None if failed is None else not failed)):
        if value is not None:
            events = events.where(F.col(name) == value)
    return events.orderBy(F.desc(order)).limit(limit)


def status_counts(nodes: DataFrame) -> DataFrame:
    """One row: nodes in all and by status."""
    return nodes.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("healthy", "degraded", "unhealthy", "offline")])


def span_durations(spans: DataFrame) -> DataFrame:
    """name, n, mean and greatest duration of spans (name, start, end); open ones are left out."""
    d = F.col("end") - F.col("start")
    return spans.where("end is not null").groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean"), F.max(d).alias("greatest"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), hits + misses), F.lit(0.0))


def tier_by_access(count: Column) -> Column:
    return F.when(count >= 100, "hot").when(count > 0, "warm").otherwise("cold")


def tier_by_age(days: Column) -> Column:
    return F.when(days < 7, "hot").when(days < 30, "warm").otherwise("cold")


def tier_by_both(count: Column, days: Column) -> Column:
    grade = lambda tier: F.when(tier == "hot", 1.0).when(tier == "warm", 0.5).otherwise(0.0)
    total = 0.6 * grade(tier_by_access(count)) + 0.4 * grade(tier_by_age(days))
    return F.when(total >= 0.75, "hot").when(total >= 0.25, "warm").otherwise("cold")


def tier_by_size(documents: DataFrame, hot_bytes: int, by: list[str], order: str, size: str = "size") -> DataFrame:
    """documents with tier: hot while the running size within `by`, in order, is within the limit; then warm."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return documents.withColumn("tier", F.when(F.sum(size).over(w) <= hot_bytes, "hot").otherwise("warm"))


def tier_statistics(documents: DataFrame, tier: str = "tier", size: str = "size") -> DataFrame:
    """tier, n, bytes; and a row 'total'."""
    return documents.rollup(tier).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes")).select(F.coalesce(F.col(tier), F.lit("total")).alias("tier"), "n", "bytes")


def migrations(documents: DataFrame, old: str, new: str) -> DataFrame:
    """How many documents change their tier, by old and new one."""
    return documents.where(F.col(old) != F.col(new)).groupBy(F.col(old).alias("old_tier"), F.col(new).alias("new_tier")).agg(F.count("*").alias("n"))


def option_scores(options: DataFrame) -> DataFrame:
    """options (id, priority, success_rate, cost) with score and risk; missing values count as neutral."""
    rate = F.coalesce("success_rate", F.lit(0.5))
    score = 0.4 * F.coalesce("priority", F.lit(0.0)) / 10 + 0.6 * rate - F.greatest(F.coalesce("cost", F.lit(0.0)), F.lit(0.0)) * 0.01
    return options.withColumn("score", F.round(score, 6)).withColumn("risk", F.when(rate < 0.5, "high").when(rate < 0.8, "medium").otherwise("low"))
