"""Queries of vector search, text search, fusion and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vexel.functions import embedding as E
from vexel.functions import text as T
from vexel.functions import vector as V
from vexel.operators import bm25, fusion, search
from vexel.operators.filters import Filter, all_of
from vexel.operators.storage import checkpoint
from vexel.plans.base import TOKENS, query, query_vector, table

#: Hits up to which they are broadcast.
FEW = 1_000_000

_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_D = {
    "cosine": "round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) + 0.0",
    "euclidean": "round(list_distance(embedding::DOUBLE[], q), 6) + 0.0",
    "dot": "round(-list_inner_product(embedding::DOUBLE[], q), 6) + 0.0",
    "manhattan": "round(list_sum(list_transform(range(1, len(q) + 1), lambda i: abs(embedding[i]::DOUBLE - q[i]))), 6) + 0.0",
}


def _knn_sql(metric: str, where: str = "true") -> str:
    return f"SELECT vec_id, {_D[metric]} AS distance FROM embeddings, {_Q} WHERE {where} ORDER BY 2, 1 LIMIT 10"


def _knn(metric):
    return lambda spark, d: search.knn(table(spark, d, "embeddings"), query_vector(spark, d), 10, metric).select("vec_id", "distance")


for _m in _D:
    _f = _knn(_m)
    _f.__name__ = f"knn_{_m}"
    query(_knn_sql(_m))(_f)


@query(_knn_sql("cosine", "label = 3"))
def knn_filter_before(spark, d):
    return search.knn(table(spark, d, "embeddings"), query_vector(spark, d), 10, where=all_of([Filter("label", "eq", 3)])).select("vec_id", "distance")


@query(f"SELECT vec_id, distance FROM (SELECT vec_id, label, {_D['cosine']} AS distance FROM embeddings, {_Q} ORDER BY 3, 1 LIMIT 20) WHERE label <= 5 ORDER BY 2, 1 LIMIT 10")
def knn_filter_after(spark, d):
    return search.knn(table(spark, d, "embeddings"), query_vector(spark, d), 10, where=F.col("label") <= 5, filter_mode="post").select("vec_id", "distance")


@query(f"SELECT vec_id, label, distance, round(1 - distance, 6) + 0.0 AS score, round(1 / (1 + distance), 6) AS inverse FROM (SELECT vec_id, label, {_D['euclidean']} AS distance FROM embeddings, {_Q} ORDER BY 3, 1 LIMIT 10)")
def knn_with_metadata(spark, d):
    e = table(spark, d, "embeddings")
    hits = search.knn(e.select("vec_id", "embedding"), query_vector(spark, d), 10, "euclidean").select("vec_id", "distance")
    return e.select("vec_id", "label").join(F.broadcast(hits), "vec_id").select("vec_id", "label", "distance", (F.round(V.score_linear(F.col("distance")), 6) + 0.0).alias("score"), F.round(V.score_inverse(F.col("distance")), 6).alias("inverse"))


_BATCH = """SELECT query_id, vec_id, distance, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {0} AS distance,
row_number() OVER (PARTITION BY a.vec_id ORDER BY {0}, b.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank <= 10"""


@query(_BATCH.format("round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0"))
def knn_batch_euclidean(spark, d):
    e = table(spark, d, "embeddings")
    return search.batch_knn(e.withColumnRenamed("vec_id", "query_id"), e, 10, "euclidean")


@query(_BATCH.format("round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0"))
def knn_batch_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return search.batch_knn(e.withColumnRenamed("vec_id", "query_id"), e, 10, "cosine")


@query(f"SELECT vec_id, {_D['cosine']} AS distance FROM embeddings, {_Q} WHERE {_D['cosine']} <= 0.8")
def vector_range(spark, d):
    return search.within(table(spark, d, "embeddings"), query_vector(spark, d), 0.8).select("vec_id", "distance")


@query("SELECT p_partkey, round(abs(p_retailprice - 1234.5), 6) AS distance FROM part ORDER BY 2, 1 LIMIT 10")
def nearest_scalar(spark, d):
    return search.nearest_scalars(table(spark, d, "part"), F.col("p_retailprice"), 1234.5, 10, "p_partkey").select("p_partkey", "distance")


@query()
def inverted_file_search(spark, d):
    """k-NN over three quarters of the clusters, which the tests hold to a recall of 0.9 on these vectors."""
    e = table(spark, d, "embeddings")
    centroids = search.train_centroids(e, 16, 10)
    return search.probe(search.assign(e, centroids), centroids, query_vector(spark, d), 10, 12).select("vec_id", "distance")


@query(_knn_sql("cosine"))
def inverted_file_all_clusters(spark, d):
    e = table(spark, d, "embeddings")
    centroids = search.train_centroids(e, 8, 5)
    return search.probe(search.assign(e, centroids), centroids, query_vector(spark, d), 10, 8).select("vec_id", "distance")


@query()
def product_quantization_codes(spark, d):
    e = table(spark, d, "embeddings")
    return search.ProductQuantizer().train(e).encode(e).select("vec_id", F.concat_ws(",", F.col("codes").cast("array<string>")).alias("codes"))


@query()
def product_quantization_search(spark, d):
    e = table(spark, d, "embeddings")
    pq = search.ProductQuantizer().train(e)
    return pq.search(pq.encode(e), query_vector(spark, d), 10).select("vec_id", "distance")


@query()
def marginal_relevance(spark, d):
    e = table(spark, d, "embeddings")
    hits = search.batch_knn(e.withColumnRenamed("vec_id", "query_id"), e, 20).join(e.select("vec_id", "embedding"), "vec_id").withColumn("score", 1 - F.col("distance"))
    return search.diversify(hits, 5)


_V = "embedding::DOUBLE[]"


@query(f"""SELECT vec_id, round(sqrt(list_inner_product({_V}, {_V})), 6) AS norm, round(list_inner_product({_V}, q), 6) + 0.0 AS dot, round(list_cosine_similarity({_V}, q), 6) + 0.0 AS cosine,
round(list_sum(list_transform(range(1, len(q) + 1), lambda i: embedding[i]::DOUBLE * q[i] + embedding[i]::DOUBLE + q[i])), 6) + 0.0 AS combined FROM embeddings, {_Q}""")
def vector_functions(spark, d):
    e, q = table(spark, d, "embeddings"), F.lit([float(x) for x in query_vector(spark, d)])
    v = F.col("embedding")
    total = F.aggregate(V.add(V.multiply(v, q), V.add(v, q)), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(V.norm(v), 6).alias("norm"), (F.round(V.dot(v, q), 6) + 0.0).alias("dot"), (F.round(V.cosine_similarity(v, q), 6) + 0.0).alias("cosine"), (F.round(total, 6) + 0.0).alias("combined"))


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform({_V}, lambda x: x * x))), 6) AS before, round(sqrt(list_sum(list_transform({_V}, lambda x: pow(x / sqrt(list_inner_product({_V}, {_V})), 2)))), 6) AS after FROM embeddings")
def normalized_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("before"), F.round(V.norm(V.normalize(F.col("embedding"))), 6).alias("after"))


@query(f"""SELECT vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (embedding[i] >= 0) <> (q[i] >= 0) THEN 1 ELSE 0 END)) AS BIGINT) AS hamming,
round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] >= 0 AND q[i] >= 0 THEN 1 ELSE 0 END)) / list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] >= 0 OR q[i] >= 0 THEN 1 ELSE 0 END)), 6) AS jaccard FROM embeddings, {_Q}""")
def bit_vectors(spark, d):
    a, b = V.binarize(F.col("embedding")), V.binarize(F.lit([float(x) for x in query_vector(spark, d)]))
    return table(spark, d, "embeddings").select("vec_id", V.hamming(a, b).alias("hamming"), F.round(V.bit_jaccard(a, b), 6).alias("jaccard"))


@query(f"SELECT vec_id, array_to_string(list_transform({_V}, lambda x: CAST(trunc((x - list_min({_V})) / (list_max({_V}) - list_min({_V})) * 255) AS INTEGER)), ',') AS codes FROM embeddings")
def quantized(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.concat_ws(",", V.quantize(F.col("embedding")).cast("array<string>")).alias("codes"))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(2, 65), lambda i: abs(embedding[i]::DOUBLE - embedding[i - 1]::DOUBLE))), 6) AS variation, true AS restored FROM embeddings")
def delta_coding(spark, d):
    v, x = F.col("embedding"), V.delta_encode(F.col("embedding"))
    same = V.euclidean(v, V.delta_decode(x)) < 1e-9
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(F.slice(x, 2, 63), F.lit(0.0), lambda a, y: a + F.abs(y)), 6).alias("variation"), same.alias("restored"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, ascii(l_returnflag) AS v FROM lineitem),
g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, v) AS i FROM f),
h AS (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey, v ORDER BY i) AS island FROM g),
r AS (SELECT l_orderkey, v, min(i) AS first, count(*) AS n FROM h GROUP BY l_orderkey, v, island)
SELECT l_orderkey, string_agg(v || ':' || n, ',' ORDER BY first) AS runs FROM r GROUP BY l_orderkey""")
def run_length_coding(spark, d):
    one = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.ascii("l_returnflag").alias("v")))).alias("x"))
    runs = V.run_lengths(F.transform("x", lambda s: s["v"]))
    return one.select("l_orderkey", F.concat_ws(",", F.transform(runs, lambda r: F.concat(r["value"].cast("string"), F.lit(":"), r["n"].cast("string")))).alias("runs"))


@query("SELECT vec_id, true AS restored FROM embeddings")
def encrypted_vectors(spark, d):
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    return table(spark, d, "embeddings").select("vec_id", (V.decrypt(V.encrypt(F.col("embedding"), key), key) == F.col("embedding")).alias("restored"))


@query("SELECT count(*) AS n, 64::BIGINT AS dimension, CAST(sum(len(embedding)) * 4 AS BIGINT) AS bytes FROM embeddings")
def collection_statistics(spark, d):
    from vexel.operators.storage import describe

    return describe(table(spark, d, "embeddings"))


_T = f"t AS (SELECT doc_id, lang, text, {TOKENS.format('text')} AS w FROM documents)"
_TF = f"""{_T}, st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM t),
tf AS (SELECT doc_id, term, len(w) AS dl, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM t) GROUP BY doc_id, term, len(w)),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
_BM = "round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 4) + 0.0"
_WORDS = "the and tion of the"


def _one(words: str) -> str:
    return "q(query_id, term, times) AS (VALUES " + ", ".join(f"(0, '{w}', {words.split().count(w)})" for w in dict.fromkeys(words.split())) + ")"


@query(f"SELECT doc_id, CAST(len({TOKENS.format('text')}) AS BIGINT) AS n, CAST(len(list_distinct({TOKENS.format('text')})) AS BIGINT) AS n_distinct FROM documents")
def document_tokens(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"WITH {_TF} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, st")
def term_statistics(spark, d):
    return bm25.term_statistics(table(spark, d, "documents")).withColumn("idf", F.round("idf", 6))


_SCORED = f"WITH {_TF}, {_one(_WORDS)}, s AS (SELECT doc_id, {_BM} AS score FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY doc_id)"


@query(f"{_SCORED} SELECT doc_id, coalesce(score, 0) AS score FROM t LEFT JOIN s USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 20")
def text_search(spark, d):
    return bm25.search(table(spark, d, "documents"), _WORDS, 20)


@query(f"{_SCORED} SELECT doc_id, coalesce(score, 0) AS score FROM t LEFT JOIN s USING (doc_id) WHERE lang = 'fr' ORDER BY 2 DESC, 1 LIMIT 20")
def text_search_filtered(spark, d):
    return bm25.search(table(spark, d, "documents"), _WORDS, 20, where=F.col("lang") == "fr")


_BATCH_TEXT = f"""WITH {_TF}, q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, doc_id, {_BM} AS score FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query(f"{_BATCH_TEXT} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def text_search_batch(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return bm25.batch_search(table(spark, d, "documents"), q, 10)


def _lists(spark, d):
    """Hits of the query vector and of the query words, of ids that both tables have."""
    vec = search.knn(table(spark, d, "embeddings"), query_vector(spark, d), 50).select(F.col("vec_id").alias("id"), F.round(1 - F.col("distance"), 6).alias("score"))
    txt = bm25.search(table(spark, d, "documents"), _WORDS, 50).select(F.col("doc_id").alias("id"), "score")
    return vec, txt


def _hits(spark, d):
    vec, txt = _lists(spark, d)
    return fusion.ranked(vec, "vector", 0.7).unionByName(fusion.ranked(txt, "text", 0.3))


_LISTS = f"""{_SCORED}, vec AS (SELECT vec_id AS id, round(1 - distance, 6) AS score FROM ({_knn_sql('cosine').replace('LIMIT 10', 'LIMIT 50')})),
txt AS (SELECT doc_id AS id, coalesce(score, 0) AS score FROM t LEFT JOIN s USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 50)"""
_HITS = f"""{_LISTS}, hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, 'vector' AS source, 0.7::DOUBLE AS weight FROM vec
UNION ALL SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1, 'text', 0.3::DOUBLE FROM txt)"""
_SOURCES = "string_agg(DISTINCT source, ',' ORDER BY source) AS sources"
_RANGE = "(max(score) OVER () - min(score) OVER ())"


@query(f"{_HITS} SELECT id, round(sum(1 / (60::DOUBLE + rank)), 6) AS score, {_SOURCES} FROM hits GROUP BY id ORDER BY 2 DESC, 1 LIMIT 20")
def fusion_reciprocal_rank(spark, d):
    return fusion.top(fusion.reciprocal_rank(_hits(spark, d)), 20)


@query(f"{_HITS} SELECT id, round(sum(score * weight), 6) + 0.0 AS score, {_SOURCES} FROM hits GROUP BY id ORDER BY 2 DESC, 1 LIMIT 20")
def fusion_weighted_sum(spark, d):
    return fusion.top(fusion.weighted_sum(_hits(spark, d)), 20)


@query(f"{_HITS}, n AS (SELECT *, (score - min(score) OVER ()) / {_RANGE} AS x FROM hits) SELECT id, round(sum(x * weight), 6) + 0.0 AS score, {_SOURCES} FROM n GROUP BY id ORDER BY 2 DESC, 1 LIMIT 20")
def fusion_normalized(spark, d):
    return fusion.top(fusion.normalized_sum(_hits(spark, d)), 20)


@query(f"{_HITS} SELECT id, round(sum(score * weight) * count(*), 6) + 0.0 AS score, {_SOURCES} FROM hits GROUP BY id ORDER BY 2 DESC, 1 LIMIT 20")
def fusion_comb_mnz(spark, d):
    return fusion.top(fusion.comb_mnz(_hits(spark, d)), 20)


@query(f"{_LISTS} SELECT id, coalesce(v.score, 0) AS left_score, coalesce(x.score, 0) AS right_score, round(0.7::DOUBLE * coalesce(v.score, 0) + 0.3::DOUBLE * coalesce(x.score, 0), 6) + 0.0 AS score FROM vec v FULL JOIN txt x USING (id)")
def hybrid_merge(spark, d):
    return fusion.merge(*_lists(spark, d))


_COARSE = f"""{_HITS}, c AS (SELECT *, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS x FROM hits WINDOW w AS (PARTITION BY source)),
coarse AS (SELECT id, source, score AS raw_score, round(x, 6) + 0.0 AS coarse FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, source) AS k FROM c) WHERE k = 1 ORDER BY 4 DESC, 1 LIMIT 500)"""


@query(f"{_COARSE} SELECT * FROM coarse")
def coarse_ranking(spark, d):
    return fusion.coarse_rank(_hits(spark, d))


@query(rf"""{_COARSE}, f AS (SELECT id, coarse, round(0.1::DOUBLE * len(list_filter(['the', 'and', 'tion', 'of', 'the'], lambda x: list_contains(regexp_split_to_array(text, '\s+'), x))) / 5 + 0.4::DOUBLE * coarse, 6) + 0.0 AS rerank FROM coarse JOIN documents ON doc_id = id)
SELECT id, coarse, rerank, round(CASE WHEN rerank <= 0 THEN coarse ELSE 0.3::DOUBLE * coarse + 0.7::DOUBLE * rerank END, 6) + 0.0 AS score FROM f ORDER BY 4 DESC, 1 LIMIT 50""")
def two_stage_ranking(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return fusion.two_stage(_hits(spark, d), docs, _WORDS)


@query(rf"""{_BATCH_TEXT}, h AS (SELECT query_id, rank, text, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN documents USING (doc_id) WHERE rank <= 10),
p AS (SELECT query_id, rank, text[1 : 4000 - before] AS part FROM h WHERE before < 4000)
SELECT query_id, md5(string_agg(part, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM p GROUP BY query_id""")
def retrieval_context(spark, d):
    docs = table(spark, d, "documents")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = checkpoint(bm25.batch_search(docs, q, 10))
    # Else all texts would be shuffled to meet a few.
    near = F.broadcast(hits) if hits.count() <= FEW else hits
    return fusion.build_context(near.join(docs.select("doc_id", "text"), "doc_id")).select("query_id", F.md5("context").alias("context_md5"))


@query(r"""WITH h AS (SELECT doc_id, list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(text, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (h * 33 + c) % 18446744073709551616) AS h FROM documents),
v AS (SELECT doc_id, h, list_transform(range(0, 384), lambda i: ((h + i) % 1000)::DOUBLE / 1000) AS e FROM h)
SELECT doc_id, h::VARCHAR AS hash, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS first, round(e[384] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS last FROM v""")
def text_embeddings(spark, d):
    h = table(spark, d, "documents").select("doc_id", "text", E.text_hash(F.col("text")).alias("h"))
    e = h.select("doc_id", F.col("h").cast("string").alias("hash"), E.embed_text(F.col("text"), hash=F.col("h")).alias("e"))
    return e.select("doc_id", "hash", F.round(F.col("e")[0], 6).alias("first"), F.round(F.col("e")[383], 6).alias("last"))


@query("""SELECT doc_id, i AS index, i * 448 AS start, md5(substring(text, (i * 448 + 1)::INTEGER, 512)) AS chunk_md5 FROM documents, unnest(range(0, greatest(ceil((length(text) - 512) / 448.0), 0)::BIGINT + 1)) AS u(i) WHERE length(text) > 0""")
def document_chunks(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(T.chunks(F.col("text"), 512, 64)).alias("c"))
    return c.select("doc_id", F.col("c.index").cast("long").alias("index"), F.col("c.start").cast("long").alias("start"), F.md5("c.chunk").alias("chunk_md5"))


@query("SELECT p_type[i : i + 2] AS kmer, count(*) AS n FROM part, unnest(range(1, length(p_type) - 1)) AS u(i) GROUP BY 1")
def kmer_counts(spark, d):
    return table(spark, d, "part").select(F.explode(T.kmers(F.col("p_type"), 3)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, reverse(translate(upper(p_name), 'ATUGC', 'TAACG')) AS complement, coalesce(round(length(regexp_replace(upper(p_name), '[^GC]', '', 'g')) / nullif(length(regexp_replace(upper(p_name), '[^ACGT]', '', 'g')), 0), 6), 0) AS gc FROM part")
def sequence_functions(spark, d):
    return table(spark, d, "part").select("p_partkey", T.reverse_complement(F.col("p_name")).alias("complement"), F.round(T.gc_content(F.col("p_name")), 6).alias("gc"))


@query(r"""SELECT c_custkey, regexp_matches(c_name, '^[A-Za-z_][A-Za-z0-9_]*$') AND length(c_name) <= 128 AS identifier, contains(lower(c_mktsegment), 'in') AS has_in, length(c_name) BETWEEN 1 AND 256 AND regexp_matches(replace(c_name, '#', '-'), '^[A-Za-z0-9_.:-]+$') AS vector_id FROM customer""")
def input_validation(spark, d):
    name = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", T.is_identifier(name).alias("identifier"), F.lower("c_mktsegment").contains("in").alias("has_in"), T.is_vector_id(F.replace(name, F.lit("#"), F.lit("-"))).alias("vector_id"))


@query("SELECT page_id, ((page_id * 7919) % 4294967296) BETWEEN 167772160 AND 184549375 AS private FROM pages")
def address_ranges(spark, d):
    n = F.pmod(F.col("page_id") * 7919, F.lit(4294967296))
    ip = F.concat_ws(".", *[(F.floor(n / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0)])
    return table(spark, d, "pages").select("page_id", T.in_cidr(ip, "10.0.0.0/8").alias("private"))
