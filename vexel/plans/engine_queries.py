"""Queries of series, places, graphs, collections, governance and the relational operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vexel.functions import geo as G
from vexel.operators import filters, governance, graphs, places, series as ts, storage
from vexel.plans.base import GRAPH, LOG, POINTS, SERIES, change_log, graph, points, query, series, table, views

HOUR, DAY = 3_600_000_000, 86_400_000_000

# Series


@query(f"""WITH {SERIES} SELECT series, ts // {HOUR} * {HOUR} AS bucket, round(avg(value), 6) AS mean, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max, count(*)::DOUBLE AS count,
arg_min(value, seq) AS first, arg_max(value, seq) AS last, round(stddev_pop(value), 6) + 0.0 AS std FROM series GROUP BY 1, 2""")
def series_downsample(spark, d):
    return ts.downsample(series(spark, d), HOUR, ["mean", "sum", "min", "max", "count", "first", "last", "std"])


@query(f"WITH {SERIES} SELECT series, ts // {DAY} * {DAY} AS bucket, round(avg(value), 6) AS mean FROM series WHERE ts BETWEEN 1704672000000000 AND 1705276800000000 GROUP BY 1, 2")
def series_range_downsample(spark, d):
    return ts.downsample(ts.between(series(spark, d), 1704672000000000, 1705276800000000), DAY, ["mean"])


@query(f"WITH {SERIES} SELECT series, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, min(ts) AS start_ts, max(ts) AS end_ts FROM series GROUP BY 1")
def series_statistics(spark, d):
    return ts.statistics(series(spark, d))


@query(f"""WITH {SERIES} SELECT series, seq, value, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 6) + 0.0 AS std, count(*) OVER w AS n, count(*) OVER w = 5 AS "full" FROM series WINDOW w AS (PARTITION BY series ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def series_rolling(spark, d):
    return ts.rolling(series(spark, d), 5)


@query(f"""WITH {SERIES}, l AS (SELECT series, list(seq ORDER BY seq) AS s, list(value ORDER BY seq) AS v FROM series GROUP BY 1),
r AS (SELECT series, s, v, range(1, len(v) + 1) AS i FROM l),
w AS (SELECT series, seq, value, row_number() OVER (PARTITION BY series ORDER BY seq) AS i FROM series)
SELECT a.series, a.seq, round(sum(CASE WHEN b.i = 1 THEN b.value ELSE 0.3::DOUBLE * b.value END * pow(0.7::DOUBLE, a.i - b.i)), 6) AS ema FROM w a JOIN w b ON a.series = b.series AND b.i <= a.i AND (b.i > a.i - 90) GROUP BY 1, 2""")
def series_moving_average(spark, d):
    """The SQL twin leaves weights below 1e-14 aside."""
    return ts.moving_average(series(spark, d), 0.3)


@query(f"WITH {SERIES} SELECT series, count(*) AS n FROM series WHERE ts >= 1705276800000000 GROUP BY 1")
def series_retention(spark, d):
    return ts.drop_older(series(spark, d), 1705276800000000).groupBy("series").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)
SELECT user_id, w AS window_no, count(*) AS n, round(sum(value), 4) AS total FROM n, unnest(range(greatest(ceil((n - 9) / 5.0), 0)::BIGINT, n // 5 + 1)) AS u(w) GROUP BY 1, 2""")
def count_windows(spark, d):
    w = ts.count_windows(table(spark, d, "events"), 10, 5, "event_id", ["user_id"])
    return w.groupBy("user_id", "window_no").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {LOG}, p AS (SELECT key, lsn AS probe, ts - 1 AS ts FROM log) SELECT p.key, p.probe, g.value AS as_of_value FROM p ASOF LEFT JOIN log g ON p.key = g.key AND p.ts >= g.ts")
def as_of_join(spark, d):
    log = change_log(spark, d)
    return ts.as_of(log.select("key", F.col("lsn").alias("probe"), (F.col("ts") - 1).alias("ts")), log, ["key"]).select("key", "probe", "as_of_value")


# Places

_KM = "round(2 * 6371.0::DOUBLE * atan2(sqrt(a), sqrt(1 - a)), 4)"


def _hav(a: str, b: str, c: str, e: str) -> str:
    x = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2))"
    return f"round(2 * 6371.0::DOUBLE * atan2(sqrt({x}), sqrt(1 - {x})), 4)"


_NYC = _hav("40.7128::DOUBLE", "(-74.006)::DOUBLE", "lat", "lon")


@query(f"WITH {POINTS} SELECT id, km FROM (SELECT id, {_NYC} AS km FROM points) WHERE km <= 1500")
def geo_radius(spark, d):
    return places.within_radius(points(spark, d), 40.7128, -74.006, 1500.0).select("id", "km")


@query(f"WITH {POINTS} SELECT id, {_NYC} AS km FROM points ORDER BY 2, 1 LIMIT 25")
def geo_nearest(spark, d):
    return places.nearest(points(spark, d), 40.7128, -74.006, 25).select("id", "km")


@query(f"WITH {POINTS} SELECT id, lat, lon FROM points WHERE lat BETWEEN -10 AND 35 AND lon BETWEEN 20 AND 120")
def geo_box(spark, d):
    return places.within_box(points(spark, d), (-10.0, 35.0, 20.0, 120.0))


@query(f"WITH {POINTS} SELECT id FROM points WHERE lat >= 0 AND lat < 40 AND lon < lat AND lon >= 0")
def geo_polygon(spark, d):
    return places.within_polygon(points(spark, d), [(0.0, 0.0), (40.0, 0.0), (40.0, 40.0)]).select("id")


@query(f"WITH {POINTS}, z AS (SELECT n_nationkey AS z, (n_nationkey % 5) * 30 - 75.5 AS y, (n_nationkey // 5) * 60 - 150.5 AS x FROM nation) SELECT id, z AS polygon_id FROM points, z WHERE lat > y AND lat < y + 40 AND lon > x AND lon < x + 50")
def geo_polygon_join(spark, d):
    y, x = ((F.col("n_nationkey") % 5) * 30 - 75.5).cast("double"), (F.floor(F.col("n_nationkey") / 5) * 60 - 150.5).cast("double")
    p = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    zones = table(spark, d, "nation").select(F.col("n_nationkey").alias("polygon_id"), F.array(p(y, x), p(y + 40, x), p(y + 40, x + 50), p(y, x + 50)).alias("ring"))
    return places.polygon_join(points(spark, d), zones).select("id", "polygon_id")


@query(f"WITH {POINTS}, s AS (SELECT s_suppkey AS k, CAST((s_suppkey * 41) % 170 - 85 AS DOUBLE) AS y, CAST((s_suppkey * 67) % 340 - 170 AS DOUBLE) AS x FROM supplier), p AS (SELECT id AS left_id, k AS right_id, {_hav('lat', 'lon', 'y', 'x')} AS km FROM points, s) SELECT * FROM p WHERE km <= 800")
def geo_radius_join(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 41) % 170 - 85).cast("double").alias("lat"), ((F.col("s_suppkey") * 67) % 340 - 170).cast("double").alias("lon"))
    return places.radius_join(points(spark, d), s, 800.0)


@query(f"WITH {POINTS}, t AS (SELECT *, greatest(0, least(1, (lat * 0 + (lon + 60) * 120) / 14400.0)) AS t FROM points) SELECT id, {_hav('lat', 'lon', '0::DOUBLE', '(-60 + t * 120)')} AS km FROM t")
def geo_line_distance(spark, d):
    return places.distance_to_line(points(spark, d), [(0.0, -60.0), (0.0, 60.0)]).select("id", "km")


@query("SELECT 1600.0::DOUBLE AS area, 0.0::DOUBLE AS min_lat, 40.0::DOUBLE AS max_lon, round(4 * 6371.0::DOUBLE * radians(40) / 4, 3) AS side_km")
def geo_measures(spark, d):
    ring, line = G.points((0, 0), (40, 0), (40, 40), (0, 40)), G.points((0, 0), (20, 0), (40, 0))
    return spark.range(1).select(G.polygon_area(ring).alias("area"), G.polygon_box(ring)["min_lat"].alias("min_lat"), G.polygon_box(ring)["max_lon"].alias("max_lon"), F.round(G.line_length(line), 3).alias("side_km"))


# Graphs


@query(f"WITH {GRAPH} SELECT src AS node, dst AS neighbour, n.label AS neighbour_label, edge_id, weight FROM edges JOIN nodes n ON n.id = dst")
def graph_neighbours(spark, d):
    return graphs.neighbours(*graph(spark, d))


@query(f"WITH {GRAPH} SELECT dst AS node, count(*) AS n, sum(weight) AS weight FROM edges GROUP BY 1")
def graph_incoming(spark, d):
    return graphs.neighbours(*graph(spark, d), incoming=True).groupBy("node").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(f"WITH RECURSIVE {GRAPH}, w AS (SELECT id AS start, id AS node, 0 AS hops, [id] AS p FROM nodes UNION ALL SELECT start, dst, hops + 1, list_append(p, dst) FROM w JOIN edges ON src = node WHERE hops < 3 AND NOT list_contains(p, dst)) SELECT start, node, hops::BIGINT AS hops, array_to_string(p, '>') AS path FROM w WHERE hops > 0")
def graph_walks(spark, d):
    nodes, edges = graph(spark, d)
    return graphs.walks(edges, nodes, 3)


@query(f"WITH RECURSIVE {GRAPH}, w AS (SELECT id AS start, id AS node, 0 AS hops FROM nodes UNION SELECT start, dst, hops + 1 FROM w JOIN edges ON src = node WHERE hops < 4) SELECT start, node, min(hops)::BIGINT AS hops FROM w GROUP BY 1, 2")
def graph_reachable(spark, d):
    nodes, edges = graph(spark, d)
    return graphs.reachable(edges, nodes, 4)


@query(f"""WITH RECURSIVE {GRAPH}, w AS (SELECT id AS start, id AS node, 0::DOUBLE AS weight, id::VARCHAR AS path, 0 AS hops FROM nodes WHERE label = 'supplier' UNION ALL SELECT start, dst, w.weight + e.weight, path || '>' || dst, hops + 1 FROM w JOIN edges e ON src = node WHERE hops < 25)
SELECT start, node, weight, path FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY weight, path) AS k FROM w) WHERE k = 1""")
def graph_shortest_paths(spark, d):
    nodes, edges = graph(spark, d)
    return graphs.shortest_paths(edges, nodes.where("label = 'supplier'"))


@query(f"WITH {GRAPH} SELECT label, count(*) AS n FROM (SELECT label FROM nodes UNION ALL SELECT label FROM edges) GROUP BY 1")
def graph_labels(spark, d):
    nodes, edges = graph(spark, d)
    return nodes.select("label").unionByName(edges.select("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH} SELECT edge_id FROM edges WHERE src NOT IN ('N0', 'N3') AND dst NOT IN ('N0', 'N3')")
def graph_delete_nodes(spark, d):
    nodes, edges = graph(spark, d)
    return graphs.delete_nodes(nodes, edges, nodes.where(F.col("id").isin("N0", "N3")))[1].select("edge_id")


# Collections

_NEW = "(SELECT s_suppkey AS c_custkey, s_name AS c_name, s_acctbal AS c_acctbal FROM supplier)"


def _new(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT * FROM {_NEW}")
def collection_upsert(spark, d):
    return storage.insert(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), _new(spark, d), "c_custkey")


@query("SELECT o_custkey AS c_custkey, CASE WHEN s_suppkey IS NULL THEN 'inserted' ELSE 'updated' END AS outcome FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN supplier ON s_suppkey = o_custkey")
def collection_upsert_report(spark, d):
    return storage.upsert_report(_new(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def collection_delete(spark, d):
    return storage.delete(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def collection_deleted(spark, d):
    return storage.deleted(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


@query("SELECT c_custkey, coalesce(s_name, c_name) AS c_name, coalesce(s_acctbal, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def collection_update(spark, d):
    return storage.update(table(spark, d, "customer"), _new(spark, d), "c_custkey").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query(f"WITH {LOG} SELECT key, arg_max(op, lsn) AS op, arg_max(value, lsn) AS value, max(lsn) AS lsn FROM log GROUP BY 1")
def collection_latest(spark, d):
    return storage.latest(change_log(spark, d), "key", "lsn").select("key", "op", "value", "lsn")


@query(f"WITH {LOG}, l AS (SELECT key, arg_max(op, lsn) AS op, arg_max(value, lsn) AS value FROM log GROUP BY 1) SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM l) UNION ALL SELECT key, value FROM l WHERE op <> 'delete'")
def change_data_apply(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return storage.apply_changes(base, change_log(spark, d), "key", "lsn")


@query(f"WITH {LOG} SELECT key, arg_max(op, lsn) AS op, arg_max(value, lsn) AS value FROM log WHERE ts <= 1705276800000000 GROUP BY 1")
def time_travel(spark, d):
    return storage.latest(change_log(spark, d).where(F.col("ts") <= 1705276800000000), "key", "lsn").select("key", "op", "value")


@query(f"WITH {LOG} SELECT lsn, op, value FROM log WHERE key = 7 AND lsn >= 100")
def key_history(spark, d):
    return change_log(spark, d).where(filters.all_of([filters.Filter("key", "eq", 7), filters.Filter("lsn", "gte", 100)])).select("lsn", "op", "value")


@query(f"WITH {LOG} SELECT lsn, op FROM log ORDER BY lsn DESC LIMIT 500")
def log_ring(spark, d):
    return storage.last_n(change_log(spark, d).select("lsn", "op"), 500, "lsn")


# Filters and governance


@query("SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) = 7")
def json_filter(spark, d):
    return table(spark, d, "events").where(filters.json_equals(F.col("props"), {"k": 7})).select("event_id")


@query("SELECT p_partkey FROM part WHERE p_size > 5 AND p_size <> 10 AND p_size <= 40 AND p_retailprice BETWEEN 950 AND 1500 AND p_brand IN ('Brand#11', 'Brand#23', 'Brand#32') AND contains(p_name, 'a')")
def typed_filters(spark, d):
    f = filters.Filter
    tests = [f("p_size", "gt", 5), f("p_size", "ne", 10), f("p_size", "lte", 40), f("p_retailprice", "between", (950, 1500)), f("p_brand", "in", ["Brand#11", "Brand#23", "Brand#32"]), f("p_name", "contains", "a")]
    return table(spark, d, "part").where(filters.all_of(tests)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size > 25 AND p_brand = 'Brand#11'")
def string_map_filters(spark, d):
    fields = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return table(spark, d, "part").where(filters.map_test(fields, "size", "gt", 25) & filters.map_test(fields, "brand", "eq", "Brand#11")).select("p_partkey")


_ST = "(SELECT o_orderkey AS id, (o_orderkey % 100)::DOUBLE AS x, (o_orderkey % 37)::DOUBLE AS y, (o_orderkey % 11)::DOUBLE AS z, (o_custkey % 365)::DOUBLE AS t FROM orders)"


@query(f"SELECT id FROM {_ST} WHERE sqrt(pow(x - 50, 2) + pow(y - 18, 2) + pow(z - 5, 2)) <= 15 AND abs(t - 100) <= 50")
def space_time_range(spark, d):
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select(k.alias("id"), (k % 100).cast("double").alias("x"), (k % 37).cast("double").alias("y"), (k % 11).cast("double").alias("z"), (F.col("o_custkey") % 365).cast("double").alias("t"))
    return p.where(filters.space_time_ball((50.0, 18.0, 5.0, 100.0), 15.0, 50.0)).select("id")


_ROLES = """u AS (SELECT c_custkey AS usr, 'r' || (c_custkey % 7) AS role FROM customer),
g AS (SELECT 'r' || (n_nationkey % 7) AS role, 'p' || (n_nationkey % 4) AS permission, CASE WHEN n_nationkey % 11 = 0 THEN 'deny' ELSE 'allow' END AS effect FROM nation),
h AS (SELECT 'r' || r_regionkey AS role, 'r' || (r_regionkey + 1) AS parent FROM region)"""


@query(f"""WITH {_ROLES}, e AS (SELECT usr, role FROM u UNION SELECT usr, parent FROM u JOIN h USING (role))
SELECT usr AS "user", permission, bool_or(effect = 'allow') AND NOT bool_or(effect = 'deny') AS allowed FROM e JOIN g USING (role) GROUP BY 1, 2""")
def role_permissions(spark, d):
    c, n, r = F.col("c_custkey"), F.col("n_nationkey"), F.col("r_regionkey")
    name = lambda x, p="r": F.concat(F.lit(p), x.cast("string"))
    users = table(spark, d, "customer").select(c.alias("user"), name(c % 7).alias("role"))
    grants = table(spark, d, "nation").select(name(n % 7).alias("role"), name(n % 4, "p").alias("permission"), F.when(n % 11 == 0, "deny").otherwise("allow").alias("effect"))
    return governance.effective_permissions(users, grants, table(spark, d, "region").select(name(r).alias("role"), name(r + 1).alias("parent")))


_POL = "p(priority, subject, resource, action, effect) AS (VALUES (1, 'u3', '*', 'purchase', 'deny'), (2, '*', 'r1', '*', 'allow'), (3, 'u5', '*', '*', 'allow'), (4, '*', '*', 'view', 'allow'))"


@query(f"""WITH {_POL}, q AS (SELECT event_id AS request_id, 'u' || (user_id % 10) AS subject, 'r' || (event_id % 3) AS resource, event_type AS action FROM events)
SELECT request_id, q.subject, q.resource, q.action, coalesce(arg_min(effect, priority) = 'allow', false) AS allowed FROM q LEFT JOIN p ON (p.subject IN ('*', q.subject)) AND (p.resource IN ('*', q.resource)) AND (p.action IN ('*', q.action)) GROUP BY 1, 2, 3, 4""")
def access_policies(spark, d):
    q = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("subject"), F.concat(F.lit("r"), F.col("event_id") % 3).alias("resource"), F.col("event_type").alias("action"))
    rules = [(1, "u3", "*", "purchase", "deny"), (2, "*", "r1", "*", "allow"), (3, "u5", "*", "*", "allow"), (4, "*", "*", "view", "allow")]
    return governance.match_policies(q, spark.createDataFrame(rules, "priority int, subject string, resource string, action string, effect string"))


@query()
def rate_limited(spark, d):
    log = change_log(spark, d)
    return governance.rate_limit(log, 3, DAY, "key", "ts", "lsn")


@query(f"WITH {LOG}, l AS (SELECT key AS node, max(ts) AS last_seen FROM log GROUP BY 1) SELECT node, last_seen, CASE WHEN 1706659200000000 - last_seen > {3 * DAY} THEN 'offline' WHEN 1706659200000000 - last_seen > {2 * DAY} THEN 'unhealthy' WHEN 1706659200000000 - last_seen > {DAY} THEN 'degraded' ELSE 'healthy' END AS status FROM l")
def node_health(spark, d):
    beats = change_log(spark, d).select(F.col("key").alias("node"), "ts")
    return governance.health(beats, F.lit(1706659200000000), DAY, 2 * DAY, 3 * DAY)


@query("SELECT event_type, b AS bound, count(*) FILTER (floor(value) <= b) AS n FROM events, unnest([1, 5, 10, 50, 100, 500, 1000, 5000]::BIGINT[]) AS u(b) GROUP BY 1, 2")
def histogram(spark, d):
    return governance.histogram(table(spark, d, "events"), ["event_type"])


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value < 100) AS succeeded, count(*) FILTER (value >= 100) AS failed, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def request_metrics(spark, d):
    return governance.request_metrics(table(spark, d, "events"), ["event_type"], F.col("value") < 100)


@query("SELECT event_type AS name, '{\"parity\":\"' || (user_id % 2) || '\"}' AS labels, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def labelled_counters(spark, d):
    s = table(spark, d, "events").select(F.col("event_type").alias("name"), F.create_map(F.lit("parity"), (F.col("user_id") % 2).cast("string")).alias("labels"), "value")
    return governance.counters(s)


@query("WITH g AS (SELECT event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY 1) SELECT name, value, 'high' AS rule FROM g WHERE name IN ('view', 'click', 'error') AND value > 20 UNION ALL SELECT name, value, 'low' FROM g WHERE name = 'signup' AND value < 200")
def gauge_alerts(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.max_by("value", "event_id").alias("value"))
    rules = [("high", n, "above", 20.0) for n in ("view", "click", "error")] + [("low", "signup", "below", 200.0)]
    return governance.alerts(g, spark.createDataFrame(rules, "rule string, name string, kind string, threshold double"))


_TIERS = """t AS (SELECT o_orderkey AS id, o_orderkey % 150 AS n, date_diff('day', o_orderdate, TIMESTAMP '1998-12-31') AS age, CAST(round_even(o_totalprice, 0) AS BIGINT) AS size FROM orders),
x AS (SELECT *, CASE WHEN n >= 100 THEN 'hot' WHEN n > 0 THEN 'warm' ELSE 'cold' END AS a, CASE WHEN age < 7 THEN 'hot' WHEN age < 30 THEN 'warm' ELSE 'cold' END AS b FROM t),
y AS (SELECT *, 0.6::DOUBLE * CASE a WHEN 'hot' THEN 1 WHEN 'warm' THEN 0.5 ELSE 0 END + 0.4::DOUBLE * CASE b WHEN 'hot' THEN 1 WHEN 'warm' THEN 0.5 ELSE 0 END AS s FROM x),
z AS (SELECT *, CASE WHEN s >= 0.75 THEN 'hot' WHEN s >= 0.25 THEN 'warm' ELSE 'cold' END AS c FROM y)"""


def _tiers(spark, d):
    o = table(spark, d, "orders")
    n, age = F.col("o_orderkey") % 150, F.datediff(F.lit("1998-12-31").cast("date"), F.to_date("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("id"), F.bround("o_totalprice").cast("long").alias("size"), governance.tier_by_access(n).alias("a"), governance.tier_by_age(age).alias("b"), governance.tier_by_both(n, age).alias("c"))


@query(f"WITH {_TIERS} SELECT id, a, b, c FROM z")
def storage_tiers(spark, d):
    return _tiers(spark, d).select("id", "a", "b", "c")


@query(f"WITH {_TIERS} SELECT coalesce(c, 'total') AS tier, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM z GROUP BY ROLLUP (c)")
def storage_tier_statistics(spark, d):
    return governance.tier_statistics(_tiers(spark, d), "c")


@query(f"WITH {_TIERS} SELECT a AS old_tier, c AS new_tier, count(*) AS n FROM z WHERE a <> c GROUP BY 1, 2")
def storage_migrations(spark, d):
    return governance.migrations(_tiers(spark, d), "a", "c")


# Relational operators, by SQL on views


def _sql(name: str, text: str, *tables: str, oracle: str | None = None):
    def run(spark, d):
        views(spark, d, *tables)
        return spark.sql(text)

    run.__name__ = name
    return query(oracle or text)(run)


_sql("sql_pricing", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS price, round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""", "lineitem")
_sql("sql_join_top", """SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""", "customer", "orders", "lineitem")
_sql("sql_join_regions", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""", "customer", "orders", "lineitem", "supplier", "nation", "region")
_sql("sql_semi_join", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority", "orders", "lineitem")
_sql("sql_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer", "orders")
_sql("sql_full_join", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY c_nationkey) x FULL OUTER JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY s_nationkey) y ON c_nationkey = s_nationkey", "customer", "supplier")
_sql("sql_interval_join", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY o_orderpriority", "orders", "lineitem")
_sql("sql_having", "SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_custkey HAVING count(*) > 12", "orders")
_sql("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
_sql("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
_sql("sql_grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())", "part")
_sql("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "lineitem")
_sql("sql_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag", "lineitem")
_sql("sql_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "customer", "supplier")
_sql("sql_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", "customer", "orders")
_sql("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", "customer", "orders")
_sql("sql_ranking", """SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS rank, CAST(dense_rank() OVER w AS BIGINT) AS dense, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS quarter,
lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)""", "orders")
_sql("sql_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 30", "customer")
_sql("sql_patterns", "SELECT p_partkey FROM part WHERE p_name LIKE '%an%' AND p_size IN (1, 5, 9) AND p_type IS NOT NULL", "part")
_sql("sql_correlated", "SELECT p_partkey, p_brand FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)", "part")


@query()
def approximate_aggregates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5, 10000).alias("median"))


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def dataframe_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS so_far FROM conversations")
def conversation_lengths(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.sum(F.length("text")).over(w).alias("so_far"))
