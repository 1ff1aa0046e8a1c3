"""Every query of the engine against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from vexel.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = con.execute(ORACLES[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(float(x) if type(x).__name__ == "Decimal" else x) for x in (r[names.index(c)] for c in columns)) for r in out.fetchall()), key=repr)
    assert got == want


def test_rate_limit_by_hand(spark):
    from vexel.operators.governance import rate_limit

    rows = [("a", t, i) for i, t in enumerate((0, 1, 2, 9, 10, 11, 12))] + [("b", 5, 100)]
    out = {r.seq: r.accepted for r in rate_limit(spark.createDataFrame(rows, "key string, ts long, seq long"), 2, 10).collect()}
    assert out == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 100: True}


def test_golden_values(spark):
    from pyspark.sql import functions as F

    from vexel.functions import geo as G
    from vexel.functions import vector as V

    a, b = F.lit([1.0, 2.0, 3.0]), F.lit([4.0, 5.0, 6.0])
    r = spark.range(1).select(
        V.dot(a, b).alias("dot"),
        V.euclidean(F.lit([0.0, 0.0, 0.0]), F.lit([3.0, 4.0, 0.0])).alias("l2"),
        V.manhattan(F.lit([0.0, 0.0, 0.0]), a).alias("l1"),
        V.cosine_distance(F.lit([0.0, 0.0, 0.0]), a).alias("zero"),
        G.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km"),
        V.expand_runs(V.run_lengths(F.lit([1, 1, 1, 2, 2, 3, 3, 3, 3]))).alias("runs"),
    ).first()
    assert (r.dot, r.l2, r.l1, r.zero) == (32.0, 5.0, 6.0, 1.0) and 111 < r.km < 112
    assert r.runs == [1, 1, 1, 2, 2, 3, 3, 3, 3]


def test_vectors_of_the_wrong_length_raise(spark):
    from vexel.operators.search import knn

    with pytest.raises(Exception, match="expected 2 dimensions"):
        knn(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>"), [1.0, 0.0], 1).collect()


def test_shortest_path_by_hand(spark):
    from vexel.operators.graphs import shortest_paths

    edges = spark.createDataFrame([("e1", "A", "B", 1.0), ("e2", "B", "C", 1.0), ("e3", "A", "C", 5.0)], "edge_id string, src string, dst string, weight double")
    out = {r.node: (r.weight, r.path) for r in shortest_paths(edges, spark.createDataFrame([("A",)], "id string")).collect()}
    assert out["C"] == (2.0, "A>B>C")
