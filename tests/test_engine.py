"""What SQL twins cannot show: errors, gaps, recall, state, late rows, and functions against plain Python."""

import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vexel.functions import embedding as E
from vexel.functions import text as T
from vexel.functions import vector as V
from vexel.functions.registry import Registry, register_sql
from vexel.operators import bm25, governance, places, search
from vexel.operators.catalog import Catalog, expire
from vexel.operators.filters import Filter
from vexel.operators.hybrid import HybridQuery, place_filter
from vexel.plans import QUERIES
from vexel.plans.base import change_log, table
from vexel.plans.statements import execute
from vexel.sources import files
from vexel.streaming import jobs

SF = "/root/testdata/sf0.001"
FORM = "vec_id long, embedding array<float>"


def test_batch_search_with_gaps(spark):
    """Null vectors, NaN, zero vectors, ties, fewer items than k, and no items at all."""
    nan = float("nan")
    items = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [nan, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 0.0])], FORM)
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, None)], "query_id long, embedding array<float>")
    for metric, far in (("cosine", [(3, 1.0), (5, 1.0)]), ("euclidean", [(5, 1.0), (3, round(math.sqrt(2), 6))])):
        out = [(r.vec_id, r.distance) for r in search.batch_knn(queries, items, 9, metric).orderBy("rank").collect()]
        assert out[:4] == [(2, 0.0), (6, 0.0), *far] and out[4][0] == 4 and math.isnan(out[4][1]) and len(out) == 5
        one = [(r.vec_id, r.distance) for r in search.knn(items, [1.0, 0.0], 9, metric).collect()]
        assert [i for i, _ in one] == [i for i, _ in out]
    assert search.batch_knn(queries, items, 2, "euclidean").count() == 2
    assert search.batch_knn(queries, items.limit(0)).count() == search.batch_knn(queries.limit(0), items).count() == 0
    with pytest.raises(Exception, match="cannot be compared"):
        search.batch_knn(queries, spark.createDataFrame([(1, [1.0, 0.0, 0.0])], FORM)).collect()


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot", "manhattan"])
def test_batch_search_by_cells(spark, metric):
    """Against all pairs in plain numpy: ties in masses, far outliers, zeros, infinities, and cells that cut both sides; tasks hold whole cells, and no block is sent to every other."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(0, 2, (900, 4)), rng.normal(size=(900, 4)), [[1e6, 0, 0, 0], [1e6, 1e-3, 0, 0], [0, 0, 0, 0], [float("inf"), 0, 0, 0]]]).astype("float32")
    names = rng.permutation(len(v))
    e = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(names, v)], FORM).cache()
    ask = e.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    order = np.argsort(names)
    x = v[order].astype(float)
    with np.errstate(all="ignore"):
        size = lambda v: np.sqrt((v * v).sum(axis=-1))
        cosine = lambda a: np.where(size(a) * size(x) == 0, 1.0, 1 - (x * a).sum(axis=1) / (size(a) * size(x)))
        plain = {"manhattan": lambda a: np.abs(x - a).sum(axis=1), "euclidean": lambda a: size(x - a), "dot": lambda a: -(x * a).sum(axis=1), "cosine": cosine}[metric]
        d = np.round(np.stack([plain(a) for a in x[::7]]), 6) + 0.0
    want = {}
    for i, row in enumerate(d):
        best = np.lexsort((np.arange(len(row)), row))[:12]
        want |= {(7 * i, rank + 1): (int(j), "nan" if math.isnan(row[j]) else row[j]) for rank, j in enumerate(best)}
    centroids = x[:5]
    for found in (search.batch_knn(ask, e, 12, metric, block=100), search.batch_knn(ask, e, 12, metric), search.batch_probe(ask, search.assign(e, centroids), centroids, 12, 5, metric, block=300)):
        assert {(r.query_id, r["rank"]): (r.vec_id, "nan" if math.isnan(r.distance) else r.distance) for r in found.collect()} == want
        assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in found._jdf.queryExecution().toString()


def test_batch_text_search_against_all_scores(spark, monkeypatch):
    """As the ranks of all scores: many ties, null ids and texts, names for ids, several blocks of queries and of scores; and postings are shuffled only where an id repeats."""
    rng = np.random.default_rng(5)
    words = "a b c d e f g h the of".split()
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 12, 150)] * 2
    docs = spark.createDataFrame([*[(i, t) for i, t in enumerate(texts)], (None, "a b"), (-(1 << 63), None)], "doc_id long, text string").repartition(3)
    ask = spark.createDataFrame([(i, " ".join(rng.choice([*words, "unknown"], 4))) for i in range(40)] + [(None, "a a b"), (99, ""), (98, "unknown")], "query_id long, query string")
    form = lambda df: sorted(((r.query_id, str(r.doc_id), r.score, r["rank"]) for r in df.collect()), key=str)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    for d in (docs, docs.withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))):
        want = form(bm25.scores(d, ask).withColumn("rank", rank).where("rank <= 7"))
        got = bm25.batch_search(d, ask, 7)
        assert form(got) == want and "Join" not in got._jdf.queryExecution().toString()
        with monkeypatch.context() as m:
            m.setattr(bm25, "POSTINGS", 50)
            m.setattr(bm25, "SCORES", 30)
            assert form(bm25.batch_search(d, ask, 7)) == want
    twice = docs.union(docs.limit(20))
    assert form(bm25.batch_search(twice, ask, 7)) == form(bm25.scores(twice, ask).withColumn("rank", rank).where("rank <= 7"))
    assert bm25.batch_search(docs.limit(0), ask).count() == bm25.batch_search(docs, ask.limit(0)).count() == 0


def test_retrieved_texts_are_not_shuffled(spark):
    key, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")  # as for texts that are too many to be broadcast
    try:
        plan = QUERIES["retrieval_context"](spark, SF)._jdf.queryExecution().toString()
    finally:
        spark.conf.set(key, was)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_recall_of_approximate_searches(spark):
    e = table(spark, SF, "embeddings")
    exact = {(r.query_id, r.vec_id) for r in search.batch_knn(e.withColumnRenamed("vec_id", "query_id"), e, 10).collect()}
    centroids = search.train_centroids(e, 16, 10)
    probed = {(r.query_id, r.vec_id) for r in search.batch_probe(e.withColumnRenamed("vec_id", "query_id"), search.assign(e, centroids), centroids, 10, 12).collect()}
    assert len(exact & probed) >= 0.9 * len(exact)
    pq = search.ProductQuantizer().train(e)
    encoded = pq.encode(e)
    best = sum(pq.search(encoded, list(r.embedding), 10).first().vec_id == r.vec_id for r in e.orderBy("vec_id").limit(10).collect())
    assert best >= 9
    v = {r.vec_id: (np.array(r.embedding), np.array(r.approximate)) for r in pq.decode(encoded).collect()}
    assert np.mean([np.linalg.norm(a - b) for a, b in v.values()]) < 0.35


def test_marginal_relevance_is_greedy(spark):
    e = table(spark, SF, "embeddings")
    v = {r.vec_id: np.array(r.embedding, dtype=float) for r in e.collect()}
    hits = search.batch_knn(e.where("vec_id < 5").withColumnRenamed("vec_id", "query_id"), e, 20).withColumn("score", 1 - F.col("distance")).cache()
    got = {(r.query_id, r.position): r.vec_id for r in search.diversify(hits.join(e.select("vec_id", "embedding"), "vec_id"), 5).collect()}
    for q in range(5):
        left = {r.vec_id: r.score for r in hits.where(F.col("query_id") == q).collect()}
        taken = []
        while len(taken) < 5:
            near = lambda i: np.mean([v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) for j in taken]) if taken else 1.0
            best = max(left, key=lambda i: (round(0.5 * left[i] + 0.5 * (1 - near(i)), 9), left[i], -i))
            taken.append(best)
            del left[best]
        assert [got[q, p] for p in range(1, 6)] == taken


def test_approximate_aggregates(spark):
    exact = table(spark, SF, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.median("l_quantity").alias("median")).collect()
    got = {r.l_returnflag: r for r in QUERIES["approximate_aggregates"](spark, SF).collect()}
    assert all(abs(got[r.l_returnflag].parts / r.parts - 1) < 0.15 and abs(got[r.l_returnflag].median - r["median"]) <= 1 for r in exact)


def test_streamed_rate_limit_is_that_of_the_batch(spark):
    key = lambda rows: sorted((r.key, r.lsn, r.accepted) for r in rows)
    assert key(QUERIES["stream_rate_limited"](spark, SF).collect()) == key(governance.rate_limit(change_log(spark, SF), 3, 86_400_000_000, "key", "ts", "lsn").collect())


def test_late_rows_and_positions(spark, tmp_path):
    """A row behind the watermark is left out; a second run goes on where the first stopped."""
    source, sink, position = (str(tmp_path / n) for n in ("source", "sink", "position"))
    put = lambda rows: spark.createDataFrame(rows, "at string, n int").select(F.col("at").cast("timestamp").alias("at"), "n").coalesce(1).write.mode("append").parquet(source)
    run = lambda: jobs.drain(jobs.windows(jobs.files(spark, source, "at timestamp, n int"), "at", "10 minutes", None, "20 minutes", [], F.sum("n").alias("n")), sink, position)
    put([("2024-01-01 00:05:00", 1), ("2024-01-01 02:00:00", 2)])
    run()
    put([("2024-01-01 00:06:00", 100), ("2024-01-01 04:00:00", 4)])
    assert jobs.progress(run())["late"] == 1
    put([("2024-01-01 06:00:00", 6)])
    run()
    assert sorted(r.n for r in spark.read.parquet(sink).collect()) == [1, 2, 4]


def test_catalogue(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.create("a", 2)
    with pytest.raises(ValueError, match="exists"):
        c.create("a", 2)
    with pytest.raises(ValueError, match="no collection"):
        c.read("b")
    rows = lambda *x: spark.createDataFrame(list(x), "id string, vector array<float>, metadata string")
    with pytest.raises(ValueError, match="2 elements"):
        c.insert("a", rows(("x", [1.0, 0.0], "{}"), ("y", [1.0], "{}")))
    assert c.count("a") == 0 and c.names() == ["a"]
    assert c.upsert("a", rows(("x", [1.0, 0.0], "{}"), ("y", [0.9, 0.1], "{}"), ("z", [0.0, 1.0], "{}"))) == {"inserted": 3, "updated": 0}
    assert c.upsert("a", rows(("z", [0.0, 2.0], "{}"), ("w", [-1.0, 0.0], "{}"))) == {"inserted": 1, "updated": 1}
    assert [r.id for r in c.search("a", [1.0, 0.0], 2).collect()] == ["x", "y"]
    assert c.update("a", rows(("x", None, '{"k":1}'), ("nobody", None, "{}"))) == 1
    assert c.get("a", ["x"]).first()[1:] == ([1.0, 0.0], '{"k":1}')
    assert c.delete("a", spark.createDataFrame([("w",), ("nobody",)], "id string")) == 1 and c.count("a") == 3
    first = c.versions("a")[1]
    assert c.read("a", first).count() == 3 and len(c.keep("a", 2)) > 1 and len(c.versions("a")) == 2
    about = c.backup("a", f"file://{tmp_path}/b/one")
    assert about["count"] == 3 and c.verify(f"file://{tmp_path}/b/one")
    assert c.drop("a") and c.names() == [] and c.recover(f"file://{tmp_path}/b/one") == "a" and c.count("a") == 3
    rows(("q", [1.0, 1.0], "{}")).write.mode("append").parquet(f"file://{tmp_path}/b/one/rows")
    with pytest.raises(ValueError, match="damaged"):
        c.recover(f"file://{tmp_path}/b/one")
    assert expire(spark, f"file://{tmp_path}/b", 1, now=about["at"] + 10) == [] and expire(spark, f"file://{tmp_path}/b", 1, now=about["at"] + 90_000) == ["one"]
    c.create("i", 2, "euclidean", "inverted")
    c.insert("i", rows(*[(str(i), [float(i), 0.0], "{}") for i in range(50)]))
    assert c.search("i", [7.1, 0.0], 1).first().id == "7"


def test_statements(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    c.create("t", 2)
    assert execute(c, "INSERT INTO t (vector) VALUES (array(1F, 0F)), (array(0F, 1F));") == 2
    assert all(r.id.startswith("id_") for r in execute(c, "SELECT id FROM t").collect())
    assert execute(c, "UPDATE t SET vector = array(5F, 5F), metadata = '{\"a\": 1, \"b\": 2}' WHERE vector[0] = 1") == 1
    assert execute(c, "select metadata from t where vector[0] = 5").first().metadata == '{"a": 1, "b": 2}'
    assert execute(c, "CREATE INDEX i ON t (id)") is True and c.describe("t")["indexes"] == {"i": ["id"]}
    assert execute(c, "DELETE FROM t") == 2 and execute(c, "DROP TABLE t") is True
    for bad in ("GRANT ALL", "UPDATE t SET id = 'x'"):
        with pytest.raises(ValueError):
            execute(c, bad)


def test_hybrid_query(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], "red fox", 10.0, 10.0, "a"), (2, [0.9, 0.1], "blue fox", 50.0, 50.0, "a"), (3, [0.0, 1.0], "red dog", 11.0, 11.0, "b")], "id long, vector array<float>, text string, lat double, lon double, kind string")
    ids = lambda q: [r.id for r in q.run(items).collect()]
    q = HybridQuery(vector=[1.0, 0.0], text="red", method="weighted", weights={"vector": 0.1, "text": 10.0})
    assert ids(q) == [1, 3, 2]
    assert ids(q.where(Filter("kind", "eq", "b"))) == [3]
    assert ids(q.in_place("circle", "within", (10.0, 10.0, 500.0))) == [1, 3] and ids(q.in_place("circle", "disjoint", (10.0, 10.0, 500.0))) == [2]
    assert ids(HybridQuery(k=2)) == [1, 2]
    with pytest.raises(ValueError):
        place_filter("blob", "within", ())


def test_across_the_date_line(spark):
    """Against all pairs, with points on both sides of the date line and near a pole."""
    rng = np.random.default_rng(1)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-89, 89, 300), rng.uniform(175, 185, 300)))]
    pts = [(i, a, b - 360 if b > 180 else b) for i, a, b in pts]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")

    def km(a, b):
        p, q, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[2] - a[2])
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
        return round(2 * 6371.0 * math.atan2(math.sqrt(x), math.sqrt(1 - x)), 4)

    want = {(a[0], b[0]) for a in pts for b in pts if km(a, b) <= 300}
    assert {(r.left_id, r.right_id) for r in places.radius_join(df, df, 300.0).collect()} == want
    centre = (0, 10.0, 179.5)
    assert {r.id for r in places.within_radius(df, 10.0, 179.5, 900.0).collect()} == {p[0] for p in pts if km(centre, p) <= 900}


def test_radius_join_of_shared_places(spark):
    """Every pair as often as its rows, null ids too, many at one place, at a pole and at longitudes beyond 180; nothing is deduplicated."""
    at = lambda *rows: spark.createDataFrame(list(rows), "id long, lat double, lon double")
    left, right = at((1, 10.0, 20.0), (1, 10.0, 20.0), (None, 10.0, 20.0), (2, 89.9, 0.0), (3, 0.0, 350.0), (4, None, 0.0)), at((7, 10.0, 20.5), (8, 89.9, 180.0), (9, 0.0, -10.0))
    assert sorted(((r.left_id, r.right_id) for r in places.radius_join(left, right, 100.0).collect()), key=str) == [(1, 7), (1, 7), (2, 8), (3, 9), (None, 7)]
    many = spark.range(3000).select("id", F.lit(1.0).alias("lat"), F.lit(180.0).alias("lon"))
    pairs = places.radius_join(many, many.where("id < 1500"), 5.0)
    assert pairs.count() == pairs.distinct().count() == 3000 * 1500
    assert "HashAggregate(keys=[left_id" not in pairs._jdf.queryExecution().toString()


def test_policies_by_join_and_by_row(spark):
    rng = np.random.default_rng(2)
    pick = lambda *x: str(rng.choice(x))
    rules = [(i, pick("*", "a", "b"), pick("*", "x", "y"), pick("*", "r", "w"), pick("allow", "deny")) for i in range(40)]
    asked = [(i, pick("a", "b", "c"), pick("x", "y", "z"), pick("r", "w")) for i in range(60)]
    r = spark.createDataFrame(asked, "request_id long, subject string, resource string, action string")
    p = spark.createDataFrame(rules, "priority long, subject string, resource string, action string, effect string")
    fits = lambda rule, q: all(a in ("*", b) for a, b in zip(rule[1:4], q[1:]))
    want = {q[0]: next((rule[4] == "allow" for rule in rules if fits(rule, q)), False) for q in asked}
    for few in (1000, 0):
        assert {x.request_id: x.allowed for x in governance.match_policies(r, p, few).collect()} == want


def test_hash_embeddings(spark):
    texts = ["", "a", "héllo wörld", "x" * 100_000, "  ", None, "漢字" * 40_000]

    def djb(values):
        h = 5381
        for x in values:
            h = (h * 33 + x) % (1 << 64)
        return h

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r.i: r for r in df.select("i", E.text_hash(F.col("t")).alias("h"), E.embed_text(F.col("t"), 16).alias("e")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].h is None and got[i].e is None
            continue
        h = djb(map(ord, t))
        assert int(got[i].h) == h
        raw = np.array([((h + j) % 1000) / 1000 for j in range(16)]) if t.strip() else np.zeros(16)
        assert np.allclose(got[i].e, raw / (np.linalg.norm(raw) or 1))
    frames = [bytes([1, 2, 3]), b"", bytes(range(256))]
    video = spark.createDataFrame([(frames,), ([],)], "f array<binary>").select(E.embed_video(F.col("f"), 10).alias("e")).collect()
    raw = np.array([((djb(frames[i // 3]) + i) % 1000) / 1000 if i < 9 else 0 for i in range(10)])
    assert np.allclose(video[0].e, raw / np.linalg.norm(raw)) and not any(video[1].e)
    rng = np.random.default_rng(3)
    cloud = rng.uniform(0, 0.6, (40, 3))
    got = np.array(spark.createDataFrame([(cloud.tolist(),)], "p array<array<double>>").select(E.embed_points(F.col("p"), 70).alias("e")).first().e)
    extent = cloud.max(axis=0) - cloud.min(axis=0)
    parts = [*((cloud[:10] - cloud.mean(axis=0)) / extent).T, [(np.linalg.norm(cloud - p, axis=1) < 0.1).sum() / 40 for p in cloud[:10]], *[[x / extent.sum()] * 10 for x in extent]]
    assert np.allclose(got, np.concatenate(parts) / np.linalg.norm(np.concatenate(parts)))
    grid = spark.createDataFrame([(bytes([0, 1, 0, 0, 0, 0, 0, 1]),)], "g binary").select(E.embed_voxels(F.col("g"), (2, 2, 2), 14).alias("a"), E.embed_points(F.array(F.array(*map(F.lit, (1.0, 0.0, 0.0))), F.array(*map(F.lit, (1.0, 1.0, 1.0)))), 14).alias("b")).first()
    assert np.allclose(grid.a, grid.b)
    sound = struct.pack("<8h", *range(0, 8000, 1000))
    routed = spark.createDataFrame([("text", "a", None), ("audio", None, sound), ("other", "a", sound)], "k string, t string, d binary").select(E.route(F.col("k"), F.col("t"), F.col("d"), dim=4).alias("e")).collect()
    assert np.allclose(routed[1].e, np.arange(0, 8000, 1000).reshape(4, 2).mean(axis=1) / 32768) and routed[2].e is None and len(routed[0].e) == 4


def test_text_functions(spark):
    vocabulary = {"[CLS]": 0, "[SEP]": 1, "[UNK]": 2, "hello": 3, "w": 4, "o": 5, "!": 6}
    one = spark.createDataFrame([("Hello wo!x",)], "t string").select(T.word_pieces(F.col("t"), vocabulary).alias("ids"), T.suspicious(F.lit("it's fine")).alias("no"), T.suspicious(F.lit("a {{b}}")).alias("yes")).first()
    assert one.ids == [0, 3, 4, 5, 6, 2, 1] and not one.no and one.yes
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    r = spark.createDataFrame([([0.5, -1.25],)], "v array<float>").select(V.encrypt(F.col("v"), key).alias("e"), V.decrypt(V.encrypt(F.col("v"), key), key).alias("d"), V.decrypt(F.lit(b"nothing of the kind at all here"), key).alias("n"), V.delta_decode(V.delta_encode(F.col("v"))).alias("x"), V.random_vector(5, F.lit(7)).alias("a"), V.random_vector(5, F.lit(7)).alias("b")).first()
    assert r.d == [0.5, -1.25] and r.n is None and b"0.5" not in bytes(r.e) and r.x == [0.5, -1.25] and r.a == r.b and all(0 <= x < 1 for x in r.a)


def test_registry(spark):
    r = Registry()
    r.register("even", lambda x: x % 2 == 0, "filter")
    assert r.where(spark.range(6), "even", F.col("id")).count() == 3 and r.names("vector") == ["elementwise_add", "elementwise_mul"]
    v = spark.range(1).select(r.call("elementwise_mul", F.lit([1.0, 2.0]), F.lit([3.0, 4.0])).alias("v")).first().v
    assert v == [3.0, 8.0]
    with pytest.raises(ValueError, match="no function"):
        r.get("none")
    register_sql(spark, "doubled", "x double", "x * 2")
    assert spark.sql("SELECT doubled(4) AS y").first().y == 8.0


def test_files(spark, tmp_path):
    root = f"file://{tmp_path}/f"
    store = files.Files(spark, root)
    store.write("a/one.txt", "some text".encode())
    store.write("a/page.html", b"<p>Big &amp; <b>bold</b></p><script>x()</script>")
    store.write("a/b/data.csv", b'text,lang,extra\n"x ""y""",en,1\n  ,en,2\n')
    store.write("a/rows.json", b'[{"text": "r1", "lang": "fr"}, {"text": ""}]')
    store.write("a/pic.png", b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 4))
    store.write("a/bad.png", b"nothing")
    with wave.open(str(tmp_path / "f/a/s.wav"), "wb") as w:
        w.setparams((1, 2, 8000, 0, "NONE", ""))
        w.writeframes(b"\0\0" * 5)
    assert store.exists("a/one.txt") and store.read("a/one.txt") == b"some text" and "b" in store.names("a")
    assert not store.move("a/one.txt", "a/page.html") and store.names("none") == []
    texts = {r.text: r.metadata for r in files.load_texts(spark, f"{root}/a", "text", ("lang",)).collect()}
    assert texts == {"some text": {}, 'x "y"': {"lang": "en"}, "r1": {"lang": "fr"}}
    assert files.load_texts(spark, f"{root}/a", suffixes=(".md",)).count() == 0
    parsed = {r.path.rsplit("/", 1)[-1]: (r.kind, r.text, r.error is None) for r in files.parse_documents(spark, f"{root}/a").collect()}
    assert parsed["page.html"] == ("html", "Big & bold", True) and parsed["pic.png"] == ("image", "3 x 4", True) and parsed["bad.png"][2] is False
    assert parsed["s.wav"] == ("audio", "1 channels, 8000 Hz, 5 frames", True)
    files.export(spark.range(10), f"{root}/out", "csv", per_file=3)
    assert len([n for n in store.names("out") if n.endswith(".csv")]) >= 4
    odd = spark.createDataFrame([('a "q"', None, "x;y"), ("", "line\nfeed", ",")], "a string, b string, c string")
    files.export(odd, f"{root}/odd", "json")
    assert sorted(map(str, files.load(spark, f"{root}/odd", "json", "a string, b string, c string").collect())) == sorted(map(str, odd.collect()))
    with pytest.raises(ValueError):
        files.export(odd, root, "xml")
    log = files.Log(spark, f"{root}/log", most=60)
    for i in range(5):
        log.append([{"k": i % 2, "n": i, "op": "put"}])
    assert log.segments() > 1 and {(r.k, r.n) for r in log.replay("k int, n int, op string", "k", "n").collect()} == {(0, 4), (1, 3)}
    messages = spark.createDataFrame([('{"kind": "imu", "header": {"stamp": {"sec": 5, "nanosec": 500000000}, "frame_id": "b"}, "data": {"x": 1}}',), ("broken",), ('{"kind": "imu"}',)], "value string")
    assert [tuple(r) for r in files.sensor_records(messages).collect()] == [("imu", 5.5, "b", '{"x":1}')]
