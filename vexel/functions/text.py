"""Text functions as Columns: tokens, chunks, k-mers, sequences, validators and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens: anything but letters, numbers and the underscore.
SEPARATOR = r"[^\p{L}\p{N}_]+"
#: Parts of SQL, of script and of templates, in alphabetical order.
SUSPECT = tuple(sorted("'; -- /* */ xp_ sp_ exec execute union select insert update delete drop create alter truncate javascript: onerror= onload= <script </script> ${ #{ {{".split()))


def tokens(text: Column) -> Column:
    """Lower-case tokens; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda x: x != "")


def match_ratio(query: Column, text: Column, fold: bool = True) -> Column:
    """Share of the query's words (by white space, each counted) that are words of the text."""
    split = lambda c: F.filter(F.split(F.lower(c) if fold else c, r"\s+"), lambda x: x != "")
    q, d = split(query), split(text)
    return F.size(F.filter(q, lambda t: F.array_contains(d, t))) / F.greatest(F.size(q), F.lit(1))


def sanitize(text: Column) -> Column:
    r"""Backslashes, quotes and control characters written as escapes."""
    out = text
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def suspicious(text: Column) -> Column:
    """Whether the text holds a part that injections are made of."""
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(p) for p in SUSPECT]), lambda p: low.contains(p))


def is_identifier(text: Column) -> Column:
    return text.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & (F.length(text) <= 128)


def is_vector_id(text: Column) -> Column:
    return F.length(text).between(1, 256) & text.rlike(r"^[A-Za-z0-9_.:-]+$")


def is_email(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def is_strong_password(text: Column) -> Column:
    return (F.length(text) >= 8) & text.rlike("[A-Z]") & text.rlike("[a-z]") & text.rlike("[0-9]")


def is_dimension(n: Column) -> Column:
    return n.between(1, 10_000)


def is_limit(n: Column) -> Column:
    return n.between(1, 10_000)


def chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Structs (index, start, chunk) of `size` characters; the last is the first that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    part = lambda i: F.struct(i.alias("index"), (i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk"))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), part))


def kmers(sequence: Column, k: int) -> Column:
    """All parts of k characters, in order."""
    n = F.length(sequence)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(sequence, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_index(kmer: Column, alphabet: str = "ACGT") -> Column:
    """The k-mer as a number to the base of the alphabet; letters beyond it count as 0."""
    place = lambda c: F.greatest(F.instr(F.lit(alphabet), c) - 1, F.lit(0))
    return F.aggregate(F.filter(F.split(F.upper(kmer), ""), lambda c: c != ""), F.lit(0).cast("long"), lambda total, c: total * len(alphabet) + place(c))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(F.upper(sequence), "ATUGC", "TAACG"))


def gc_content(sequence: Column) -> Column:
    """Share of G and C among A, C, G and T; 0 where there are none."""
    count = lambda letters: F.length(F.regexp_replace(F.upper(sequence), f"[^{letters}]", ""))
    return F.coalesce(F.try_divide(count("GC"), count("ACGT")), F.lit(0.0))


def fill_template(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by a Column's text."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def word_pieces(text: Column, vocabulary: dict[str, int], unknown: str = "[UNK]") -> Column:
    """Identifiers of words and marks between the start and end tokens, from a vocabulary that is small enough to stand in the plan; words it lacks fall back to their characters, then to `unknown`."""
    table = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), F.lit(1))
    known = lambda w: F.map_contains_key(table, w)
    ids = F.flatten(F.transform(parts, lambda w: F.when(known(w), F.array(F.try_element_at(table, w))).otherwise(F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(vocabulary[unknown]))))))
    edge = lambda name: F.array(F.lit(vocabulary[name]))
    return F.concat(edge("[CLS]"), ids, edge("[SEP]"))


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null where it is none."""
    parts = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("long"))
    ok = (F.size(parts) == 4) & ~F.exists(parts, lambda x: x.isNull() | (x < 0) | (x > 255))
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda total, x: total * 256 + x))


def in_cidr(ip: Column, cidr: str) -> Column:
    base, _, bits = cidr.partition("/")
    size = 1 << (32 - int(bits or 32))
    a, b, c, d = map(int, base.split("."))
    low = (((a * 256 + b) * 256 + c) * 256 + d) // size * size
    return ip_number(ip).between(low, low + size - 1)
