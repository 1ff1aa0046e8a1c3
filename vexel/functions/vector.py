"""Vector functions as Columns: distances, norms, arithmetic, bit vectors and scalar codecs.

Elements are widened to DOUBLE before they are multiplied.  A zero vector has similarity 0 to
everything, hence cosine distance 1; vectors of unequal length have similarity 0 and null for
every other measure (searches raise instead, see `vexel.operators.search`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(_wide(v), lambda x: x * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), 0.0).otherwise(dot(a, b) / length)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine_similarity(a, b)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_wide(a), _wide(b), lambda x, y: F.abs(x - y)))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


#: Distances by name; smaller is nearer.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine_distance, "euclidean": euclidean, "dot": dot_distance, "manhattan": manhattan}


def metric(name: str) -> Callable[[Column, Column], Column]:
    """The distance of that name; unknown names raise."""
    key = name.lower().replace("product", "").replace("_", "")
    if key not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {sorted(METRICS)}")
    return METRICS[key]


def normalize(v: Column) -> Column:
    """v at unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, _wide(v)).otherwise(F.transform(_wide(v), lambda x: x / n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(_wide(a), _wide(b), lambda x, y: x + y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(_wide(a), _wide(b), lambda x, y: x * y)


def parse_vector(text: Column) -> Column:
    """'1, 2, 3' as an array of floats; null where a part is no number."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def random_vector(dim: int, seed: Column) -> Column:
    """dim numbers of [0, 1), determined by the seed."""
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.pmod(F.xxhash64(seed, i), F.lit(1 << 53)).cast("double") / float(1 << 53))


def score_linear(distance: Column) -> Column:
    return 1.0 - distance


def score_inverse(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def binarize(v: Column, threshold: float = 0.0) -> Column:
    """Bits x >= threshold, packed from the lowest bit into BIGINT words of 32 bits each."""
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 32).cast("int"))
    bit = lambda x, i: F.when(x >= threshold, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(F.transform(F.slice(v, w * 32 + 1, 32), bit), F.lit(0).cast("long"), lambda total, x: total + x)
    return F.when(F.size(v) > 0, F.transform(words, word)).otherwise(F.array().cast("array<bigint>"))


def _bits(a: Column, b: Column, how: str) -> Column:
    join = {"xor": lambda x, y: x.bitwiseXOR(y), "and": lambda x, y: x.bitwiseAND(y), "or": lambda x, y: x.bitwiseOR(y)}[how]
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(join(x, y)).cast("long")), F.lit(0).cast("long"), lambda total, x: total + x)


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two packed bit vectors."""
    return _bits(a, b, "xor")


def bit_jaccard(a: Column, b: Column) -> Column:
    """Shared over united bits; 1 where both are empty."""
    union = _bits(a, b, "or")
    return F.when(union == 0, 1.0).otherwise(_bits(a, b, "and") / union)


def integer_l2(a: Column, b: Column) -> Column:
    """Euclidean distance, cut to a whole number."""
    return euclidean(a, b).cast("long")


def quantize(v: Column, bits: int = 8) -> Column:
    """Codes 0..2^bits - 1 between the least and the greatest element; a constant vector has zeros."""
    if not 1 <= bits <= 8:
        raise ValueError("bits must be 1 to 8")
    wide, top = _wide(v), float((1 << bits) - 1)
    low, high = F.array_min(wide), F.array_max(wide)
    return F.when(high == low, F.transform(wide, lambda x: F.lit(0))).otherwise(F.transform(wide, lambda x: ((x - low) / (high - low) * top).cast("int")))


def dequantize(codes: Column, low: Column | None = None, high: Column | None = None, bits: int = 8) -> Column:
    """Codes as numbers of 0..1, or of low..high if these are given."""
    unit = F.transform(codes, lambda x: x / float((1 << bits) - 1))
    return unit if low is None else F.transform(unit, lambda x: low + x * (high - low))


def delta_encode(v: Column) -> Column:
    """The first element, then differences."""
    wide = _wide(v)
    return F.transform(wide, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(wide, i - 1)))


def delta_decode(deltas: Column) -> Column:
    """Running sums."""
    start = F.array().cast("array<double>")
    return F.aggregate(deltas, start, lambda out, x: F.concat(out, F.array(x + F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0.0)))))


def run_lengths(values: Column, most: int = 255) -> Column:
    """Runs of equal neighbours as structs (value, n), none longer than `most`."""
    v = values.cast("array<bigint>")
    starts = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | ~F.get(v, i).eqNullSafe(F.get(v, i - 1)))
    runs = F.transform(starts, lambda s, j: F.struct(F.get(v, s).alias("value"), (F.coalesce(F.get(starts, j + 1), F.size(v)) - s).alias("n")))
    pieces = lambda r: F.transform(F.sequence(F.lit(0), F.floor((r["n"] - 1) / most).cast("int")), lambda c: F.struct(r["value"].alias("value"), F.least(F.lit(most), r["n"] - c * most).alias("n")))
    return F.when(F.size(v) > 0, F.flatten(F.transform(runs, pieces))).otherwise(F.array().cast("array<struct<value:bigint,n:int>>"))


def expand_runs(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["n"])))


def encrypt(v: Column, key: Column) -> Column:
    """AES-GCM of the vector's text form."""
    return F.aes_encrypt(F.concat_ws(",", v.cast("array<string>")), key, F.lit("GCM"))


def decrypt(data: Column, key: Column) -> Column:
    """The vector again; null where the key or the data are wrong."""
    return parse_vector(F.try_aes_decrypt(data, key, F.lit("GCM")).cast("string"))
