"""Queries of sources and sinks, the catalogue, streams, statements, hybrid search, named functions and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from vexel.functions import text as T
from vexel.functions import tuning
from vexel.functions import vector as V
from vexel.functions.registry import Registry
from vexel.operators import filters, fusion, governance, graphs, search, storage
from vexel.operators.catalog import Catalog
from vexel.operators.hybrid import HybridQuery
from vexel.operators.storage import scratch
from vexel.plans.base import GRAPH, LOG, SERIES, change_log, graph, micros, query, query_vector, series, table
from vexel.plans.search_queries import _BATCH, _D, _Q
from vexel.plans.statements import execute
from vexel.sources import files
from vexel.streaming import jobs

HOUR = 3_600_000_000

# Sources and sinks

_CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _round_trip(form: str):
    def run(spark, d):
        path = scratch(spark, form)
        files.export(table(spark, d, "customer"), path, form, per_file=400)
        return files.load(spark, path, form, _CUSTOMER)

    run.__name__ = f"export_{form}"
    query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")(run)


for _f in ("jsonl", "json", "csv", "parquet", "orc"):
    _round_trip(_f)


def _collection(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"))


@query("SELECT vec_id::VARCHAR AS id, 64 AS dimension, round(list_sum(embedding::DOUBLE[]), 5) + 0.0 AS total FROM embeddings")
def export_vectors_csv(spark, d):
    path = scratch(spark, "vectors")
    files.export(_collection(spark, d), path, "vectors_csv")
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return files.load(spark, path, "vectors_csv", "").select("id", "dimension", (F.round(total, 5) + 0.0).alias("total"))


@query("SELECT vec_id::VARCHAR AS id, '{\"label\":' || label || '}' AS metadata, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def export_vectors_json(spark, d):
    path = scratch(spark, "vectors")
    files.export(_collection(spark, d), path, "vectors_json", codec="gzip")
    return files.load(spark, path, "vectors_json", "id string, vector array<float>, metadata string").select("id", "metadata", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("SELECT md5(text) AS text_md5, lang, source FROM documents WHERE trim(text) <> ''")
def load_json_texts(spark, d):
    path = scratch(spark, "texts")
    table(spark, d, "documents").select(F.col("text").alias("body"), "lang", "source").write.json(path)
    loaded = files.load_texts(spark, path, "body", ("lang", "source", "absent"))
    return loaded.select(F.md5("text").alias("text_md5"), F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


@query("WITH l AS (SELECT n_regionkey AS key, arg_max(n_name, n_nationkey) AS value, max(n_nationkey) AS lsn FROM nation GROUP BY 1) SELECT key::BIGINT AS key, value FROM l WHERE lsn % 5 <> 0")
def log_replay(spark, d):
    log = files.Log(spark, scratch(spark, "log"), most=600)
    entries = [{"key": r.n_regionkey, "lsn": r.n_nationkey, "op": "delete" if r.n_nationkey % 5 == 0 else "put", "value": r.n_name} for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]
    for i in range(0, len(entries), 10):
        log.append(entries[i : i + 10])
    return log.replay("key long, lsn long, op string, value string", "key", "lsn").select("key", "value")


# The catalogue


def _catalog(spark, d, name="e", metric="cosine"):
    catalog = Catalog(spark, scratch(spark, "catalog"))
    catalog.create(name, 64, metric)
    catalog.insert(name, _collection(spark, d))
    return catalog


@query("SELECT vec_id::VARCHAR AS id, CASE WHEN label = 4 THEN '{\"label\":40}' ELSE '{\"label\":' || label || '}' END AS metadata FROM embeddings WHERE label <> 3 UNION ALL SELECT 'new', '{}'")
def catalog_changes(spark, d):
    """Insert, delete, upsert and partial update."""
    catalog = _catalog(spark, d)
    e = table(spark, d, "embeddings")
    catalog.delete("e", e.where("label = 3").select(F.col("vec_id").alias("id")))
    catalog.upsert("e", spark.createDataFrame([("new", [0.5] * 64)], "id string, vector array<float>"))
    catalog.update("e", e.where("label in (3, 4)").select(F.col("vec_id").cast("string").alias("id"), F.lit(None).cast("array<float>").alias("vector"), F.lit('{"label":40}').alias("metadata")))
    return catalog.read("e").select("id", "metadata")


@query("SELECT vec_id::VARCHAR AS id FROM embeddings")
def catalog_restore(spark, d):
    """Back to the version before a deletion, through a backup that is verified."""
    catalog = _catalog(spark, d)
    before = catalog.versions("e")[-1]
    catalog.delete("e", table(spark, d, "embeddings").where("label < 5").select(F.col("vec_id").alias("id")))
    catalog.restore("e", before)
    target = scratch(spark, "backup")
    catalog.backup("e", target)
    catalog.recover(target, "copy")
    return catalog.read("copy").select("id")


@query(f"SELECT vec_id::VARCHAR AS id, distance, round(1 - distance, 6) + 0.0 AS score FROM (SELECT vec_id, {_D['euclidean']} AS distance FROM embeddings, {_Q} ORDER BY 2, vec_id::VARCHAR LIMIT 10)")
def catalog_search(spark, d):
    return _catalog(spark, d, metric="euclidean").search("e", query_vector(spark, d), 10)


@query("SELECT 'e' AS name, count(*) AS count, 64::BIGINT AS dimension, 'cosine' AS metric, 'exact' AS index, CAST(sum(len(embedding)) * 4 AS BIGINT) AS bytes FROM embeddings")
def catalog_statistics(spark, d):
    return spark.createDataFrame([_catalog(spark, d).statistics("e")], "name string, count long, dimension long, metric string, index string, bytes long")


@query("SELECT vec_id::VARCHAR AS id, CASE WHEN label > 7 THEN 'far' ELSE '{\"label\":' || label || '}' END AS metadata FROM embeddings WHERE label <> 2 UNION ALL SELECT 'x', '{}'")
def statements(spark, d):
    """INSERT, UPDATE, DELETE, CREATE INDEX and SELECT as text."""
    catalog = _catalog(spark, d)
    execute(catalog, f"INSERT INTO e (id, vector, metadata) VALUES ('x', array_repeat(1F, 64), '{{}}')")
    execute(catalog, "UPDATE e SET metadata = 'far' WHERE get_json_object(metadata, '$.label') > 7")
    execute(catalog, "DELETE FROM e WHERE get_json_object(metadata, '$.label') = 2")
    execute(catalog, "CREATE INDEX by_id ON e (id)")
    return execute(catalog, "SELECT id, metadata FROM e")


# Streams


def _events(spark, d):
    """The table of events as a stream; times are instants."""
    folder = scratch(spark, "events")
    table(spark, d, "events").repartition(4).select("event_id", F.timestamp_micros(micros()).alias("at"), micros().alias("ts"), "user_id", "event_type", "value").write.parquet(folder)
    return jobs.files(spark, folder, "event_id long, at timestamp, ts long, user_id long, event_type string, value double", per_batch=2)


def _whole(spark, stream):
    sink = scratch(spark, "sink")
    jobs.drain_whole(stream, sink, scratch(spark, "position"))
    return spark.read.parquet(sink)


@query(f"WITH {SERIES} SELECT series AS event_type, ts // {HOUR} * {HOUR} AS start, count(*) AS n, round(sum(value), 4) AS total FROM series GROUP BY 1, 2")
def stream_windows(spark, d):
    w = jobs.windows(_events(spark, d), "at", "1 hour", None, "2 hours", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _whole(spark, w).select("event_type", F.unix_micros("start").alias("start"), "n", "total")


@query(f"WITH {SERIES} SELECT ts // {HOUR} * {HOUR} - i * {HOUR} AS start, count(*) AS n FROM series, unnest([0, 1]) AS u(i) GROUP BY 1")
def stream_sliding_windows(spark, d):
    w = jobs.windows(_events(spark, d), "at", "2 hours", "1 hour", "2 hours", [], F.count("*").alias("n"))
    return _whole(spark, w).select(F.unix_micros("start").alias("start"), "n")


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS ts FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < {6 * HOUR} THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g) SELECT user_id, min(ts) AS start, max(ts) + {6 * HOUR} AS "end", count(*) AS n FROM s GROUP BY user_id, no""")
def stream_sessions(spark, d):
    s = jobs.sessions(_events(spark, d), "at", "6 hours", "40 days", ["user_id"], F.count("*").alias("n"))
    return _whole(spark, s).select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, d):
    sink = scratch(spark, "sink")
    jobs.drain(jobs.once(_events(spark, d), "at", "40 days", ["user_id", "event_type"]).select("user_id", "event_type"), sink, scratch(spark, "position"))
    return spark.read.parquet(sink)


@query(f"WITH {LOG}, l AS (SELECT key, arg_max(op, lsn) AS op, arg_max(value, lsn) AS value, max(lsn) AS lsn FROM log GROUP BY 1) SELECT key::VARCHAR AS id, round(value, 2) AS value, (lsn % 100)::DOUBLE AS second FROM l WHERE op <> 'delete'")
def stream_changes(spark, d):
    """Database changes into vectors, and these into a collection."""
    folder = scratch(spark, "changes")
    log = change_log(spark, d)
    log.select("key", "op", "lsn", F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("second"), (F.col("lsn") % 100).cast("string"), F.lit("none"), F.lit("x")).alias("data")).repartition(4).write.parquet(folder)
    changes = jobs.files(spark, folder, "key long, op string, lsn long, data map<string, string>", per_batch=1)
    catalog = Catalog(spark, scratch(spark, "catalog"))
    catalog.create("c", 2)
    catalog.apply("c", spark.createDataFrame([("0", [0.0, 0.0], "{}", "insert", -1)], "id string, vector array<float>, metadata string, op string, lsn long"), "lsn")
    ordered = jobs.vector_changes(changes, ["value", "none", "second"])
    state = scratch(spark, "state")

    def merge(batch, number):
        # Batches of files are not in the order of the log: the last change of each key so far is kept beside the collection.
        path = f"{state}/{number}"
        before = spark.read.parquet(f"{state}/{number - 1}") if number else None
        every = batch if before is None else before.unionByName(batch)
        storage.latest(every, "id", "lsn").write.mode("overwrite").parquet(path)
        catalog.apply("c", spark.read.parquet(path), "lsn")

    jobs.drain_each(ordered, merge, scratch(spark, "position"))
    return catalog.read("c").select("id", F.round(F.col("vector")[0].cast("double"), 2).alias("value"), F.col("vector")[1].cast("double").alias("second"))


@query()
def stream_rate_limited(spark, d):
    """Held against the batch operator in the tests."""
    log = scratch(spark, "log")
    change_log(spark, d).repartition(1).write.parquet(log)
    sink = scratch(spark, "sink")
    jobs.drain(jobs.rate_limit(jobs.files(spark, log, "key long, op string, lsn long, ts long, value double"), 3, 24 * HOUR, "key", "ts", "lsn"), sink, scratch(spark, "position"))
    return spark.read.parquet(sink)


# Searches


@query(f"""WITH i AS (SELECT doc_id AS id, embedding, text, label, CAST((doc_id * 37) % 180 - 90 AS DOUBLE) AS lat, CAST((doc_id * 91) % 360 - 180 AS DOUBLE) AS lon, doc_id % 50 AS t FROM documents JOIN embeddings ON doc_id = vec_id),
h AS (SELECT id, {_D['cosine']} AS distance FROM i, {_Q} WHERE label <= 7 AND lat BETWEEN -60 AND 60 AND lon BETWEEN -150 AND 150 AND t >= 5)
SELECT id, round(1 / (60::DOUBLE + row_number() OVER (ORDER BY round(1 / (1 + distance), 6) DESC, id) - 1), 6) AS score, 'vector' AS sources FROM (SELECT * FROM h ORDER BY distance, id LIMIT 100) ORDER BY 2 DESC, 1 LIMIT 10""")
def hybrid_query(spark, d):
    i = table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    k = F.col("doc_id")
    items = i.select(k.alias("id"), F.col("embedding").alias("vector"), "text", "label", ((k * 37) % 180 - 90).cast("double").alias("lat"), ((k * 91) % 360 - 180).cast("double").alias("lon"), (k % 50).alias("t"))
    q = HybridQuery(vector=query_vector(spark, d)).where(filters.Filter("label", "lte", 7)).in_place("box", "within", (-60.0, 60.0, -150.0, 150.0)).in_time("t", start=5)
    return q.run(items)


@query(_BATCH.format("round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0").replace("embeddings a, embeddings b", "(SELECT * FROM embeddings WHERE vec_id % 5 <> 1) a, (SELECT * FROM embeddings WHERE vec_id % 7 <> 0) b"))
def knn_batch_with_gaps(spark, d):
    """Null vectors among the items and among the queries."""
    e = table(spark, d, "embeddings")
    gap = lambda n, r: e.withColumn("embedding", F.when(F.col("vec_id") % n != r, F.col("embedding")))
    return search.batch_knn(gap(5, 1).withColumnRenamed("vec_id", "query_id"), gap(7, 0), 10, "euclidean")


@query(_BATCH.format("round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0"))
def knn_batch_all_clusters(spark, d):
    e = table(spark, d, "embeddings")
    centroids = search.train_centroids(e, 8, 5)
    return search.batch_probe(e.withColumnRenamed("vec_id", "query_id"), search.assign(e, centroids), centroids, 10, 8)


_ST = "(SELECT o_orderkey AS id, (o_orderkey % 100)::DOUBLE AS x, (o_orderkey % 37)::DOUBLE AS y, (o_orderkey % 11)::DOUBLE AS z, (o_custkey % 365)::DOUBLE AS t FROM orders)"


def _space_time(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), *[(c % n).cast("double").alias(name) for name, c, n in (("x", k, 100), ("y", k, 37), ("z", k, 11), ("t", F.col("o_custkey"), 365))])


@query(f"SELECT id, round(0.5::DOUBLE * sqrt(pow(x - 50, 2) + pow(y - 18, 2) + pow(z - 5, 2)) + 2 * abs(t - 100), 6) AS distance FROM {_ST} ORDER BY 2, 1 LIMIT 20")
def space_time_nearest(spark, d):
    return _space_time(spark, d).select("id", F.round(filters.space_time_distance((50.0, 18.0, 5.0, 100.0), 0.5, 2.0), 6).alias("distance")).orderBy("distance", "id").limit(20)


@query(f"SELECT id FROM {_ST} WHERE x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 30 AND z BETWEEN 0 AND 9 AND t BETWEEN 100 AND 200")
def space_time_box(spark, d):
    return _space_time(spark, d).where(filters.space_time_box((10.0, 5.0, 0.0, 100.0), (40.0, 30.0, 9.0, 200.0))).select("id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30' AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def time_range_and_blocked(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    kept = o.where(filters.time_range("day", "1995-01-01 00:00:00", "1996-06-30 00:00:00"))
    return filters.not_blocked(kept, table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_custkey")), "o_custkey").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size = 7 OR starts_with(p_brand, 'Brand#2') OR regexp_matches(p_name, '^a')")
def any_filter(spark, d):
    f = filters.Filter
    return table(spark, d, "part").where(filters.any_of([f("p_size", "eq", 7), f("p_brand", "starts_with", "Brand#2"), f("p_name", "matches", "^a")])).select("p_partkey")


# Texts, vectors and named functions

_PARTS = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in T.SUSPECT) + "]"


@query(f"SELECT page_id, len(list_filter({_PARTS}, lambda p: contains(lower(html), p))) > 0 AS html, len(list_filter({_PARTS}, lambda p: contains(lower(url), p))) > 0 AS url FROM pages")
def injection_patterns(spark, d):
    return table(spark, d, "pages").select("page_id", T.suspicious(F.col("html")).alias("html"), T.suspicious(F.col("url")).alias("url"))


@query(r"""SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '''', '\'''), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) AS clean_md5 FROM conversations""")
def sanitized(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.sanitize(F.col("text"))).alias("clean_md5"))


@query("SELECT p_partkey, CAST(list_reduce(list_prepend(0, list_transform(range(1, 5), lambda i: greatest(instr('ACGT', upper(p_type)[i]) - 1, 0))), lambda a, b: a * 4 + b) AS BIGINT) AS number FROM part")
def kmer_numbers(spark, d):
    return table(spark, d, "part").select("p_partkey", T.kmer_index(F.substring("p_type", 1, 4)).alias("number"))


@query("SELECT conv_id, turn, 'As ' || role || ': ' || md5(text) || ' (' || turn || ')' AS prompt FROM conversations")
def prompts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.fill_template("As {role}: {digest} ({turn})", role=F.col("role"), digest=F.md5("text"), turn=F.col("turn")).alias("prompt"))


@query(r"SELECT c_custkey, regexp_matches(lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.org', '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') AS email, length(c_name) >= 8 AND regexp_matches(c_name, '[A-Z]') AND regexp_matches(c_name, '[a-z]') AND regexp_matches(c_name, '[0-9]') AS password, c_custkey BETWEEN 1 AND 10000 AS in_range FROM customer")
def more_validation(spark, d):
    name, key = F.col("c_name"), F.col("c_custkey")
    mail = F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"), F.lit(".org"))
    return table(spark, d, "customer").select("c_custkey", T.is_email(mail).alias("email"), T.is_strong_password(name).alias("password"), (T.is_dimension(key) & T.is_limit(key)).alias("in_range"))


@query(f"SELECT vec_id, CAST(trunc(list_distance(embedding::DOUBLE[], q) * 1000) AS BIGINT) AS thousandths FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 1000) AS e, embedding FROM embeddings), {_Q}")
def integer_distances(spark, d):
    q = F.lit([float(x) * 1000 for x in query_vector(spark, d)])
    return table(spark, d, "embeddings").select("vec_id", V.integer_l2(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 1000), q).alias("thousandths"))


@query("SELECT vec_id, list_max(list_transform(range(1, 65), lambda i: abs(embedding[i]::DOUBLE - (lo + trunc((embedding[i]::DOUBLE - lo) / (hi - lo) * 255) / 255 * (hi - lo))))) <= (hi - lo) / 255 AS near, round(lo + trunc((embedding[1]::DOUBLE - lo) / (hi - lo) * 255) / 255 * (hi - lo), 6) + 0.0 AS first FROM (SELECT vec_id, embedding, list_min(embedding::DOUBLE[]) AS lo, list_max(embedding::DOUBLE[]) AS hi FROM embeddings)")
def dequantized(spark, d):
    v = F.col("embedding").cast("array<double>")
    low, high = F.array_min(v), F.array_max(v)
    back = V.dequantize(V.quantize(v), low, high)
    worst = F.array_max(F.zip_with(v, back, lambda a, b: F.abs(a - b)))
    return table(spark, d, "embeddings").select("vec_id", (worst <= (high - low) / 255).alias("near"), (F.round(back[0], 6) + 0.0).alias("first"))


@query("SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS sigmoid, greatest(c_acctbal, 0) AS relu, round((c_acctbal + c_nationkey) / sqrt(c_acctbal * c_acctbal + c_nationkey * c_nationkey), 6) + 0.0 AS normalized, c_acctbal + 2 AS total, sha256(c_name) AS digest FROM customer")
def named_functions(spark, d):
    r, a = Registry(), F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(r.call("sigmoid", a / 1000), 6).alias("sigmoid"), r.call("relu", a).alias("relu"), (F.round(r.call("normalize", a, F.col("c_nationkey").cast("double")), 6) + 0.0).alias("normalized"), r.call("no such", a, F.lit(2), or_sum=True).alias("total"), F.sha2("c_name", 256).alias("digest"))


_N = ", ".join(f"({n})" for n in (1000, 50_000, 2_000_000))


@query(f"""SELECT n, n * (2 * m * 4 + 128 * 4 + 16) AS memory, m, greatest(1, CAST(floor(sqrt(n / 39.7::DOUBLE)) AS BIGINT)) AS nlist, 8::BIGINT AS parts, round(n * 128 / 1e6::DOUBLE + n * log2(n) / 1e7::DOUBLE, 6) AS seconds, 180::BIGINT AS ef, greatest(1, 100 * 9 // 10)::BIGINT AS nprobe, 4.0::DOUBLE AS ratio, 64.0::DOUBLE AS index_ratio, round(0.7 * 0.95::DOUBLE + 0.3::DOUBLE / 11, 6) AS record, 5::BIGINT AS budget_m
FROM (SELECT n::BIGINT AS n, CASE WHEN n < 10000 THEN 8 WHEN n < 1000000 THEN 16 ELSE 32 END::BIGINT AS m FROM (VALUES {_N}) t(n))""")
def index_tuning(spark, d):
    rows = []
    for n in (1000, 50_000, 2_000_000):
        g, i, q = tuning.recommend(n, 128)
        rows.append((n, g.memory_bytes(n, 128), g.m, i.nlist, q.m, round(tuning.build_seconds("graph", n, 128), 6), g.for_recall(0.9).ef_search, tuning.Inverted().for_recall(0.9).nprobe, tuning.Quantizer().parameter_ratio(), tuning.Quantizer().index_ratio(128), round(tuning.record_score(0.95, 10), 6), tuning.graph_for_memory(500).m))
    return spark.createDataFrame(rows, "n long, memory long, m long, nlist long, parts long, seconds double, ef long, nprobe long, ratio double, index_ratio double, record double, budget_m long")


# Governance and graphs


@query("SELECT count(*) AS n, round(avg(value / 500), 6) AS mean, min(value / 500) AS least, max(value / 500) AS greatest, round(avg(CASE WHEN value / 500 >= 0.7 THEN 1 ELSE 0 END), 6) AS sure, count(DISTINCT event_type) AS actions FROM events")
def decision_statistics(spark, d):
    return governance.decision_statistics(table(spark, d, "events").select(F.col("event_type").alias("action"), (F.col("value") / 500).alias("confidence")))


@query("SELECT event_id FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200) WHERE event_type = 'error'")
def decision_history(spark, d):
    return governance.decision_history(table(spark, d, "events"), 200, "event_id", {"event_type": "error"}).select("event_id")


@query("SELECT event_id FROM events WHERE user_id = 3 AND value < 100 ORDER BY event_id DESC LIMIT 5")
def audit_trail(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("user"), F.col("event_type").alias("action"), (F.col("value") >= 100).alias("success"))
    return governance.audit(e, 5, "event_id", user=3, failed=True).select("event_id")


@query(f"WITH {SERIES} SELECT series, ts // {24 * HOUR} * {24 * HOUR} AS bucket, round(count(*) / 86400.0::DOUBLE, 6) AS rate FROM series GROUP BY 1, 2 HAVING count(*) / 86400.0 > 0.0001")
def rate_alerts(spark, d):
    return governance.rate_alerts(series(spark, d), 86400, 0.0001, ["series"])


@query("SELECT event_type || '{parity=\"' || (user_id % 2) || '\"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 2")
def metrics_text(spark, d):
    m = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 2).alias("p")).agg(F.count("*").alias("value"))
    return governance.exposition(m.select(F.col("event_type").alias("name"), F.create_map(F.lit("parity"), F.col("p").cast("string")).alias("labels"), "value"))


@query("SELECT event_type, round(count(*) FILTER (value < 100) / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY 1")
def hit_rates(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") < 100).alias("h"), F.count_if(F.col("value") >= 100).alias("m"))
    return g.select("event_type", F.round(governance.hit_rate(F.col("h"), F.col("m")), 6).alias("rate"))


@query("SELECT o_orderkey, CASE WHEN sum(size) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) <= 300000 THEN 'hot' ELSE 'warm' END AS tier FROM (SELECT *, CAST(round_even(o_totalprice, 0) AS BIGINT) AS size FROM orders)")
def size_tiers(spark, d):
    o = table(spark, d, "orders").withColumn("size", F.bround("o_totalprice").cast("long"))
    return governance.tier_by_size(o, 300_000, ["o_custkey"], "o_orderkey").select("o_orderkey", "tier")


@query("SELECT s_suppkey AS id, round(0.4::DOUBLE * (s_nationkey % 10) / 10 + 0.6::DOUBLE * (s_suppkey % 11) / 10 - greatest(s_acctbal / 100, 0) * 0.01::DOUBLE, 6) AS score, CASE WHEN (s_suppkey % 11) / 10.0 < 0.5 THEN 'high' WHEN (s_suppkey % 11) / 10.0 < 0.8 THEN 'medium' ELSE 'low' END AS risk FROM supplier")
def option_scores(spark, d):
    o = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 10).cast("double").alias("priority"), (F.col("s_suppkey") % 11 / 10).alias("success_rate"), (F.col("s_acctbal") / 100).alias("cost"))
    return governance.option_scores(o).select("id", "score", "risk")


@query(f"WITH {LOG}, n AS (SELECT key, max(ts) AS t FROM log GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (1706659200000000 - t <= {24 * HOUR}) AS healthy, count(*) FILTER (1706659200000000 - t > {24 * HOUR} AND 1706659200000000 - t <= {48 * HOUR}) AS degraded, count(*) FILTER (1706659200000000 - t > {48 * HOUR} AND 1706659200000000 - t <= {72 * HOUR}) AS unhealthy, count(*) FILTER (1706659200000000 - t > {72 * HOUR}) AS offline FROM n")
def cluster_status(spark, d):
    beats = change_log(spark, d).select(F.col("key").alias("node"), "ts")
    return governance.status_counts(governance.health(beats, F.lit(1706659200000000), 24 * HOUR, 48 * HOUR, 72 * HOUR))


@query("SELECT o_orderpriority AS name, count(*) AS n, round(avg(d), 6) AS mean, max(d) AS greatest FROM (SELECT o_orderpriority, date_diff('day', o_orderdate, l_shipdate) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <> 2) GROUP BY 1")
def span_durations(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return governance.span_durations(j.select(F.col("o_orderpriority").alias("name"), F.lit(0).cast("long").alias("start"), F.when(F.col("l_linenumber") != 2, F.datediff("l_shipdate", "o_orderdate")).cast("long").alias("end")))


@query(f"WITH {GRAPH} SELECT edge_id FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE id <> 'N5') OR dst NOT IN (SELECT id FROM nodes WHERE id <> 'N5')")
def graph_dangling(spark, d):
    nodes, edges = graph(spark, d)
    return graphs.dangling(nodes.where("id <> 'N5'"), edges).select("edge_id")


@query("SELECT event_id, importance FROM (SELECT event_id, value / 500 AS importance FROM events) WHERE importance >= 0.7")
def consolidated(spark, d):
    return jobs.consolidate(table(spark, d, "events").select("event_id", (F.col("value") / 500).alias("importance")))


@query("SELECT event_id FROM events WHERE (event_id % 3 = 0 OR event_id + event_id % 1000 > 900) ORDER BY value DESC, event_id LIMIT 50")
def cache_content(spark, d):
    """Time to live and least recently used; values are distinct enough to rank by."""
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("written"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 1000).alias("ttl"), F.struct("value", -F.col("event_id")).alias("used"))
    return jobs.unexpired(e, F.lit(900), capacity=50).select("event_id")


@query("WITH a AS (SELECT doc_id AS id, quality::DOUBLE AS importance, 0.5::DOUBLE AS score FROM labels UNION ALL SELECT doc_id, toxic * 2.0::DOUBLE, 0.1::DOUBLE FROM labels) SELECT id, importance, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY importance DESC, score DESC) AS k FROM a) WHERE k = 1 ORDER BY importance DESC, id LIMIT 40")
def memory_recall(spark, d):
    m = table(spark, d, "labels")
    short = m.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("importance"), F.lit(0.5).alias("score"))
    return fusion.recall(short, m.select(F.col("doc_id").alias("id"), (F.col("toxic") * 2.0).alias("importance"), F.lit(0.1).alias("score")), 40)
