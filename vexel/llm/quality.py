"""Quality rules: robust multivariate outliers among documents of one language and source.

Each document has a vector of transformed text statistics.  Per (lang, source), location and
scatter are minimum-covariance-determinant estimates.  Several starts (coordinate-wise
quartiles; mean and covariance; mean's correlations on the quartiles' scales) take two
concentration steps each; a step keeps the COVER share of documents with the least Mahalanobis distances
and estimates anew.  The start with the least determinant goes on until no step makes a
determinant smaller by more than CLOSE.  A document is rejected when its squared distance,
after the usual consistency factor, is beyond the cutoff.

Groups of any size are estimated alike: an estimate is drawn towards that of the group's
language, and that towards the estimate over all documents, as if SHRINK documents of the
wider group had been seen (the posterior of a normal-inverse-Wishart prior); thousands of
documents outweigh it, a handful do not.

Estimates rest on all documents: a step is one aggregation over the statistics, whose partial
results are per group and distance bin, never rows gathered in one place.  Distances are
sorted into bins of 1/BINS octave; of the bin in which the share is reached, all documents
count with the weight that makes the share exact.

Defined results: a null or empty text (or one without words) has no statistics and is
rejected, with a null distance; null lang or source is a value like any other.  Statistics without
spread get a floor of variance, so that ties and groups of one document never divide by zero.
Repeated rows count and are judged each; an empty table gives no rows.  Extra columns, whatever their names, are kept in the stage
and ignored in the query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexel.llm.common import SPACE, Rows, cut, lean, read, runs, small, span_hash, text_slices, trim

FEATURES = ("word_length", "symbols", "upper", "digits", "distinct", "adjacent_repeats", "line_words")
P = len(FEATURES)
#: Share of documents that the concentration steps keep; bins of an octave of distance.
COVER, BINS = 0.75, 16
#: Documents of the wider group that an estimate is drawn towards, and the fall of a determinant's logarithm that is none.
SHRINK, CLOSE = 5.0 * P, 0.01
#: Estimates are broadcast to the documents up to so many groups (of some 300 bytes); beyond, they are joined by shuffle.
BROADCAST_GROUPS = 50_000
#: Cutoff of the squared distance, as a multiple of the chi-square quantile at 0.999 with P degrees of freedom.
CUTOFF = 2.0
#: Least standard deviation of each statistic, on its transformed scale.
FLOOR = (0.04, 0.04, 0.04, 0.08, 0.05, 0.04, 0.25)
#: Words of the prior that pulls the shares in short texts towards usual values, and those values.
PRIOR, USUAL = 30.0, {"symbols": 0.03, "upper": 0.03, "digits": 0.0, "distinct": 0.9, "repeats": 0.01}


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the regularised incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= x / (a + n)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 1e-9, 200.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return lo


_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1  # upper case
_CLASS[48:58] = 2  # digits
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3  # symbols
_CLASS[[33, 39, 44, 45, 46, 58, 59, 63]] = 4  # usual punctuation: ! ' , - . : ; ?


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x FEATURES; nan for rows without words."""
    n = len(offsets) - 1
    starts, ends = runs(data, offsets, ~SPACE)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first).astype(float)
    row = np.repeat(np.arange(n), np.diff(first))
    kinds = _CLASS[data]
    # Latin capitals with accents: C3 80 to C3 9E.
    kinds[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] = 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1)
        np.cumsum(mask, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    chars = per_row((data & 0xC0) != 0x80) - per_row(SPACE[data])
    upper, digits, odd, bangs = per_row(kinds == 1), per_row(kinds == 2), per_row(kinds == 3), per_row(data == 33)
    token = span_hash(data, starts, ends)
    order = np.lexsort((token, row))
    new = np.ones(len(token), dtype=bool)
    if len(token):
        new[1:] = (token[order][1:] != token[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n).astype(float)
    same = np.zeros(len(token), dtype=bool)
    if len(token):
        same[1:] = (token[1:] == token[:-1]) & (row[1:] == row[:-1])
    repeats = np.bincount(row[same], minlength=n).astype(float)
    lines = per_row(data == 10) + 1
    per_char = PRIOR * 5

    def share(x: np.ndarray, of: np.ndarray, usual: float, prior: float) -> np.ndarray:
        return np.arcsin(np.sqrt(np.clip((x + usual * prior) / (of + prior), 0, 1)))

    with np.errstate(divide="ignore", invalid="ignore"):
        # A text of n words has about HEAPS(n) distinct ones; the share is taken against that.
        expected = np.minimum(count, 4.0 * np.power(np.maximum(count, 1), 0.7))
        out = np.column_stack([
            np.log((chars + per_char) / (count + PRIOR)),
            share(odd + bangs, chars, USUAL["symbols"] / 5, per_char),
            share(upper, chars, USUAL["upper"], per_char),
            share(digits, chars, USUAL["digits"], per_char),
            np.log((distinct + USUAL["distinct"] * PRIOR) / (expected + PRIOR)),
            share(repeats, count, USUAL["repeats"], PRIOR),
            np.log((count + PRIOR) / (lines + PRIOR / 40)),
        ])
    out[count == 0] = np.nan
    return out


def _flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of the texts that have some, and which these are."""
    parts = [statistics(data, offsets) for _, data, offsets in text_slices(text)]
    table = np.concatenate(parts) if parts else np.zeros((0, P))
    some = ~np.isnan(table[:, 0])
    return table[some], some


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, l, v) of the rows (g, l, text) that have statistics."""
    for batch in batches:
        table, some = _flat(batch.column(2))
        at = pa.array(np.flatnonzero(some))
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(table) + 1) * P).astype(np.int32)), pa.array(table.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lists], ["g", "l", "v"])


def _vector() -> Column:
    @F.arrow_udf("array<double>")
    def stats(text: pa.Array) -> pa.Array:
        table, some = _flat(text)
        offsets = np.zeros(len(some) + 1, dtype=np.int32)
        np.cumsum(np.where(some, P, 0), out=offsets[1:])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()))
        trim()
        return pa.compute.if_else(pa.array(some), lists, pa.scalar(None, pa.list_(pa.float64())))

    return stats


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_PARAMS = [f"m{i}" for i in range(P)] + [f"q{i}_{j}" for i, j in _PAIRS]
_MOMENTS = {**{f"s{i}": f"v[{i}]" for i in range(P)}, **{f"t{i}_{j}": f"v[{i}] * v[{j}]" for i, j in _PAIRS}}


def _square(table: np.ndarray) -> np.ndarray:
    """Symmetric matrices from their upper halves, a row each."""
    out = np.empty((len(table), P, P))
    for k, (i, j) in enumerate(_PAIRS):
        out[:, i, j] = out[:, j, i] = table[:, k]
    return out


def _half(matrices: np.ndarray) -> np.ndarray:
    return np.column_stack([matrices[:, i, j] for i, j in _PAIRS]) if len(matrices) else np.zeros((0, len(_PAIRS)))


def _numbers(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])


def _rows(keys: list[pa.Array], mean: np.ndarray, scatter: np.ndarray) -> pa.RecordBatch:
    """(key, s, m.., q.., d): location, precision and logarithm of the determinant."""
    table = np.column_stack([mean, _half(np.linalg.inv(scatter)), np.linalg.slogdet(scatter)[1]])
    return pa.RecordBatch.from_arrays([*keys, *[pa.array(np.ascontiguousarray(x)) for x in table.T]], ["key", "s", *_PARAMS, "d"])


_FORM = "key string, s int, " + ", ".join(f"{c} double" for c in [*_PARAMS, "d"])
_FLOOR2 = np.diag(np.array(FLOOR) ** 2)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, n, sums of moments, quartiles a.., m.., b..): the three starts."""
    for batch in batches:
        n = _numbers(batch, ["n"])
        mean = _numbers(batch, [f"s{i}" for i in range(P)]) / n
        scatter = _square(_numbers(batch, [f"t{i}_{j}" for i, j in _PAIRS]) / n) - mean[:, :, None] * mean[:, None, :] + _FLOOR2
        a, m, b = (_numbers(batch, [f"{x}{i}" for i in range(P)]) for x in "amb")
        scale = np.maximum((b - a) / 1.349, FLOOR)
        spread = np.sqrt(np.einsum("kii->ki", scatter))
        ratio = scale / spread
        for s, (at, matrix) in enumerate(((m, np.einsum("ki,ij->kij", scale**2, np.eye(P))), (mean, scatter), (m, scatter * ratio[:, :, None] * ratio[:, None, :]))):
            yield _rows([batch.column("key"), pa.array([s] * batch.num_rows, pa.int32())], at, matrix)


def consistency(cover: float) -> float:
    """At the normal distribution the covered share understates the scatter by this factor."""
    return cover / chi2_cdf(chi2_quantile(cover, P), P + 2)


def _estimates(cover: float, shrink: float):
    """Of (key, s, n, sums of moments, the wider group's m.. and q..): the new estimates."""
    factor = consistency(cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = _numbers(batch, ["n"])
            mean = _numbers(batch, [f"s{i}" for i in range(P)]) / n
            scatter = (_square(_numbers(batch, [f"t{i}_{j}" for i, j in _PAIRS]) / n) - mean[:, :, None] * mean[:, None, :]) * factor
            wide = _numbers(batch, [f"m{i}" for i in range(P)])
            prior = np.linalg.inv(_square(_numbers(batch, [f"q{i}_{j}" for i, j in _PAIRS])))
            off, n3 = mean - wide, n[:, :, None]
            out = (n3 * scatter + shrink * prior + n3 * shrink / (n3 + shrink) * off[:, :, None] * off[:, None, :]) / (n3 + shrink) + _FLOOR2
            yield _rows([batch.column("key"), batch.column("s")], (n * mean + shrink * wide) / (n + shrink), out)

    return run


def _distance(vector: str = "v", mark: str = "") -> Column:
    """The squared distance, as one SQL expression: thousands of Column calls would cost more than the job."""
    x = [f"({vector}[{i}] - {mark}m{i})" for i in range(P)]
    return F.expr(" + ".join(f"{1 if i == j else 2} * {mark}q{i}_{j} * {x[i]} * {x[j]}" for i, j in _PAIRS))


def _concentrate(table: DataFrame, params: DataFrame, wider: DataFrame, cover: float, shrink: float) -> DataFrame:
    """One step for every (key, s) of params. wider: (key, up), the wider group of each group; '^' is what all documents are drawn towards."""
    near = table.join(params, "key").withColumn("bin", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-9))) * BINS))
    bins = near.groupBy("key", "s", "bin").agg(F.count("*").alias("n"), *[F.expr(f"sum({e}) as {c}") for c, e in _MOMENTS.items()])
    group = Window.partitionBy("key", "s")
    before = F.sum("n").over(group.orderBy("bin")) - F.col("n")
    weighted = bins.withColumn("w", F.least(F.lit(1.0), (cover * F.sum("n").over(group) - before) / F.col("n"))).where("w > 0")
    total = weighted.groupBy("key", "s").agg(*[F.expr(f"sum(w * {c}) as {c}") for c in ("n", *_MOMENTS)])
    above = params.select(F.col("key").alias("up"), "s", *_PARAMS)
    new = total.join(wider, "key").join(above, ["up", "s"]).drop("up").mapInArrow(_estimates(cover, shrink), _FORM)
    return new.unionByName(params.where("key = '^'"))


def _group(lang: Column, source: Column) -> Column:
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(part(lang), F.lit("/"), part(source))


def estimate(stats: DataFrame, cover: float = COVER, shrink: float = SHRINK, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(key, m.., q..): the estimates of every group g of stats (g, l, v). Groups, languages and all documents are estimated side by side."""
    keys = F.array(F.lit("*"), F.concat(F.lit("l"), "l"), F.concat(F.lit("g"), "g"))
    names = stats.select("g", "l").distinct()
    wider = names.select(F.explode(F.array(*[F.struct(a.alias("key"), b.alias("up")) for a, b in ((F.lit("*"), F.lit("^")), (F.concat(F.lit("l"), "l"), F.lit("*")), (F.concat(F.lit("g"), "g"), F.concat(F.lit("l"), "l")))])).alias("x")).select("x.*").distinct()
    wider = cut(wider)
    few = wider.count() <= broadcast_groups
    hint = F.broadcast if few else (lambda df: df)
    table = stats.select(F.explode(keys).alias("key"), "v")
    # Quartiles from histograms of 1/512, counted once by group and added up for the wider groups.
    counts = stats.select("g", "l", F.posexplode("v").alias("f", "x")).groupBy("g", "l", "f", F.floor(F.col("x") * 512).alias("bin")).agg(F.count("*").alias("n"))
    counts = counts.select(F.explode(keys).alias("key"), "f", "bin", "n").groupBy("key", "f", "bin").agg(F.sum("n").alias("n"))
    each = Window.partitionBy("key", "f")
    run = counts.withColumn("c", F.sum("n").over(each.orderBy("bin"))).withColumn("t", F.sum("n").over(each))
    at = lambda q: F.min(F.when(F.col("c") >= q * F.col("t"), (F.col("bin") + 0.5) / 512))
    quartiles = run.groupBy("key", "f").agg(at(0.25).alias("a"), at(0.5).alias("m"), at(0.75).alias("b"))
    quartiles = quartiles.groupBy("key").agg(*[F.expr(f"max(case when f = {i} then {x} end) as {x}{i}") for x in "amb" for i in range(P)])
    sums = table.groupBy("key").agg(F.count("*").cast("double").alias("n"), *[F.expr(f"sum({e}) as {c}") for c, e in _MOMENTS.items()])
    first = cut(sums.join(quartiles, "key").mapInArrow(_starts, _FORM))
    # All documents are drawn towards their own quartiles.
    params = cut(first.unionByName(first.where("key = '*' and s = 0").drop("s", "key").select(F.lit("^").alias("key"), F.explode(F.array(*[F.lit(s) for s in range(3)])).alias("s"), *_PARAMS, "d")))
    for _ in range(2):
        params = cut(_concentrate(table, hint(params), hint(wider), cover, shrink))
    best = params.groupBy("key").agg(F.min_by(F.struct(*_PARAMS, "d"), F.struct("d", "s")).alias("x")).select("key", F.lit(0).alias("s"), "x.*")
    params = cut(best)
    while True:
        new = cut(_concentrate(table, hint(params), hint(wider), cover, shrink))
        fall = new.alias("a").join(hint(params).alias("b"), "key").agg(F.max(F.col("b.d") - F.col("a.d"))).first()[0]
        params = new
        if fall is None or not fall > CLOSE:
            return params.select("key", *_PARAMS)


def assess(docs: DataFrame, cover: float = COVER, cutoff: float = CUTOFF, shrink: float = SHRINK, broadcast_groups: int = BROADCAST_GROUPS) -> tuple[Rows, DataFrame]:
    """docs under safe names, and these with __vx_distance (squared, null where there is none) and __vx_reject. Statistics are taken in two passes over the texts, so that no text is shuffled."""
    rows = Rows(docs)
    lang, source, text = rows["lang"].cast("string"), rows["source"].cast("string"), rows["text"]
    tongue = F.coalesce(F.concat(F.lit(":"), lang), F.lit("-"))
    stats = cut(rows.df.select(_group(lang, source).alias("g"), tongue.alias("l"), text.alias("text")).mapInArrow(lean(_measure), "g string, l string, v array<double>"))
    params = estimate(stats, cover, shrink, broadcast_groups).where("key like 'g%'")
    params = cut(params.select(F.substring("key", 2, 1 << 30).alias("__vx_g"), *[F.col(c).alias(f"__vx_{c}") for c in _PARAMS]))
    joined = rows.df.withColumn("__vx_v", _vector()(text)).withColumn("__vx_g", _group(lang, source)).join(small(params, broadcast_groups), "__vx_g", "left")
    limit = cutoff * chi2_quantile(0.999, P)
    judged = joined.withColumn("__vx_distance", _distance("__vx_v", "__vx_"))
    return rows, judged.select(*rows.inner, "__vx_distance", (F.col("__vx_v").isNull() | F.coalesce(F.col("__vx_distance") > limit, F.lit(False))).alias("__vx_reject"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, distance (squared, 3 decimals) and rejected, for every document."""
    rows, judged = assess(read(spark, sf_dir, "documents"))
    return judged.select(rows["doc_id"].alias("doc_id"), F.round("__vx_distance", 3).alias("distance"), F.col("__vx_reject").alias("rejected"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those rejected."""
    rows, judged = assess(docs)
    return rows.back(judged.where(~F.col("__vx_reject")))
