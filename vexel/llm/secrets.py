"""Secret scans through a trigram index.

Each rule's regular expression is analysed into a Boolean query over the three-letter strings
(of lower-case bytes) that any match must hold.  Every slice of a partition is indexed: the
postings of a trigram are the rows that hold it.  A rule's query is answered by intersections
and unions of postings, and only rows that are left are searched with the expression itself.
A rule without mandatory trigrams is searched for in all rows.  The index lives with its
slice, like a segment of a search engine, so nothing is shuffled.

Defined results: null and empty texts hold no secrets; matches of a rule are the leftmost,
not overlapping, in order of place and numbered from 1; rules are independent, so one place
can match several; repeated rows are reported each; a null id stays null, and ids keep their
type.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vexel.llm.common import Rows, form, lean, read, text_slices

#: Written in the common part of Python's and RE2's syntax; letters and digits are ASCII ones. Values have no greatest length.
#: (A url's scheme has one, which cuts no secret: a longer run of letters still matches from its last 21 on.)
RULES: dict[str, str] = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----",
    "json_web_token": r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "assigned_secret": r"(?i)\b(?:password|passwd|secret|token|api[_-]?key)[\"']?[ \t]*[:=][ \t]*[\"']?[0-9a-z_+/=.~-]{8,}",
    "url_password": r"[A-Za-z][0-9A-Za-z+.-]{1,20}://[0-9A-Za-z_.~%-]{1,}:[0-9A-Za-z_.~%!$&*+-]{1,}@",
    "long_hex": r"\b[0-9a-f]{32,}\b",
}

ALL = ("all",)
_MOST = 48


def _and(*qs: tuple) -> tuple:
    parts = sorted({p for q in qs for p in (q[1] if q[0] == "and" else [q]) if p != ALL}, key=repr)
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(qs: list[tuple]) -> tuple:
    parts = sorted({p for q in qs for p in (q[1] if q[0] == "or" else [q])}, key=repr)
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _trigrams(strings: set[str]) -> tuple:
    """What a text holds if it holds one of the strings."""
    if any(len(s) < 3 for s in strings):
        return ALL
    return _or([_and(*[("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in strings])


class _Part:
    """What is known of the matches of a part of an expression: the strings they are, if few; their possible first and last letters; a query."""

    def __init__(self, exact: set[str] | None, prefix: set[str], suffix: set[str], query: tuple = ALL):
        self.exact, self.prefix, self.suffix, self.query = exact, prefix, suffix, query

    @staticmethod
    def of(strings: set[str]) -> _Part:
        return _Part(strings, strings, strings)

    def loosened(self) -> _Part:
        if self.exact is None:
            return self
        return _Part(None, {s[:2] for s in self.exact}, {s[-2:] for s in self.exact}, _and(self.query, _trigrams(self.exact)))


ANY = _Part(None, {""}, {""})


def _then(x: _Part, y: _Part) -> _Part:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= _MOST:
        return _Part.of({a + b for a in x.exact for b in y.exact})
    ends = x.exact if x.exact is not None else x.suffix
    begins = y.exact if y.exact is not None else y.prefix
    across = _trigrams({a[-2:] + b[:2] for a in ends for b in begins}) if len(ends) * len(begins) <= _MOST else ALL
    u, v = x.loosened(), y.loosened()
    prefix = {(a + b)[:2] for a in x.exact for b in begins} if x.exact is not None and len(x.exact) * len(begins) <= _MOST else u.prefix
    suffix = {(a + b)[-2:] for a in ends for b in y.exact} if y.exact is not None and len(ends) * len(y.exact) <= _MOST else v.suffix
    return _Part(None, prefix, suffix, _and(u.query, v.query, across))


def _parts(nodes, fold: bool) -> _Part:
    out = _Part.of({""})
    for op, value in nodes:
        out = _then(out, _part(str(op), value, fold))
    return out


def _part(op: str, value, fold: bool) -> _Part:
    if op == "LITERAL":
        c = chr(value)
        return _Part.of({c.lower()}) if c.isascii() else ANY
    if op == "IN":
        letters: set[str] = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                letters.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 12:
                letters |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return ANY
        return _Part.of(letters) if len(letters) <= 12 and all(c.isascii() for c in letters) else ANY
    if op == "AT":
        return _Part.of({""})
    if op == "SUBPATTERN":
        return _parts(value[3], fold)
    if op == "BRANCH":
        branches = [_parts(b, fold) for b in value[1]]
        if all(b.exact is not None for b in branches) and sum(len(b.exact) for b in branches) <= _MOST:
            return _Part.of(set().union(*[b.exact for b in branches]))
        loose = [b.loosened() for b in branches]
        return _Part(None, set().union(*[b.prefix for b in loose]), set().union(*[b.suffix for b in loose]), _or([b.query for b in loose]))
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        part = _parts(inner, fold)
        if not least:
            if most == 1 and part.exact is not None:
                return _Part.of(part.exact | {""})
            return ANY
        if least == most == 1:
            return part
        if part.exact is not None and least == most and len(part.exact) ** least <= _MOST:
            out = part
            for _ in range(least - 1):
                out = _then(out, part)
            return out
        return part.loosened()
    return ANY


def trigram_query(pattern: str) -> tuple:
    """The Boolean query of an expression: ("all",), ("tri", abc), ("and", ...) or ("or", ...)."""
    return _parts(re._parser.parse(pattern, re.ASCII), False).loosened().query


def _mentioned(q: tuple) -> set[str]:
    return {q[1]} if q[0] == "tri" else set() if q == ALL else set().union(*[_mentioned(x) for x in q[1]])


_FOLD = np.arange(256, dtype=np.int32)
_FOLD[65:91] += 32


class Scanner:
    def __init__(self, rules: dict[str, str]):
        self.rules = {name: re.compile(p, re.ASCII) for name, p in rules.items()}
        self.queries = {name: trigram_query(p) for name, p in rules.items()}
        self.ids = {t: i + 1 for i, t in enumerate(sorted(set().union(*map(_mentioned, self.queries.values()))))}
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.ids.items():
            self.table[int.from_bytes(t.encode(), "big")] = i

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Rows that hold the trigram, by its number."""
        n = len(offsets) - 1
        folded = _FOLD[data]
        found = self.table[(folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]]
        at = np.flatnonzero(found)
        rows = np.searchsorted(offsets, at, "right") - 1
        both = np.unique(found[at].astype(np.int64) * n + rows)
        cut_at = np.searchsorted(both, np.arange(len(self.ids) + 2) * n)
        return [both[a:b] - i * n for i, (a, b) in enumerate(zip(cut_at, cut_at[1:]))]

    def rows(self, q: tuple, postings: list[np.ndarray], n: int) -> np.ndarray:
        if q == ALL:
            return np.arange(n)
        if q[0] == "tri":
            return postings[self.ids[q[1]]]
        parts = [self.rows(x, postings, n) for x in q[1]]
        out = parts[0]
        for p in sorted(parts[1:], key=len):
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
        return out

    def scan(self, text: pa.Array) -> Iterator[tuple[int, str, int, str]]:
        """(row, rule, number, match)."""
        for at, data, offsets in text_slices(text):
            n = len(offsets) - 1
            postings = self.postings(data, offsets) if len(data) > 2 else [np.zeros(0, np.int64)] * (len(self.ids) + 1)
            raw = data.tobytes()
            for name, expression in self.rules.items():
                for row in self.rows(self.queries[name], postings, n).tolist():
                    for number, m in enumerate(expression.finditer(raw[offsets[row] : offsets[row + 1]].decode()), 1):
                        yield at + row, name, number, m.group()


def find_secrets(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """One row for each match: doc_id, rule, n, secret."""
    rules = rules or RULES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            found = list(scanner.scan(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.string())],
                ["doc_id", "rule", "n", "secret"],
            )

    rows = Rows(docs)
    return rows.df.select(rows["doc_id"].alias("doc_id"), rows["text"].alias("text")).mapInArrow(lean(run), form(doc_id=rows.kind("doc_id"), rule="string", n="long", secret="string"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of all rules in all documents."""
    return find_secrets(read(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    one = [f"SELECT doc_id, '{name}' AS rule, regexp_extract_all(text, '{quoted(p)}') AS l FROM documents" for name, p in RULES.items()]
    return "SELECT doc_id, rule, CAST(n AS BIGINT) AS n, secret FROM (SELECT doc_id, rule, unnest(generate_series(1, len(l))) AS n, unnest(l) AS secret FROM (" + " UNION ALL ".join(one) + "))"


SQL = _sql()
