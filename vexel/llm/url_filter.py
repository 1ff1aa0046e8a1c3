"""URL filters by a tree of path templates.

The path of a URL, without query and fragment, runs down a tree of its host, which is as deep
as the deepest path in the table; its levels are worked through one after the other.  A segment that
is a number, a date, a long hexadecimal string or a word with digits stands for its kind.  At
a node with more than BRANCHES children, of which most lead to few pages, the children
become one wildcard.  Then, from the leaves up, children whose labelled share of bad pages does not
differ from that of all children together (by a z-test of proportions, or for want of labels)
become one wildcard too.  A template is rejected when its share of good labelled pages,
smoothed by WEIGHT pages of the overall share, is below PURITY.

A page's label is that of the document whose id is the last number in its path; a page is
good when quality is 1 and toxic is 0.  Levels are aggregated over distinct templates, so one
busy host is many partial sums and not one task.

Defined results: a null or unparsable URL has the host '' and, with no path, the template
'/'; stars and braces in a path are written %2A, %7B and %7D, so that none is taken for a
wildcard; ids keep their type; a label that is null in quality or toxic counts as none, and of repeated labels of an id the worst counts; a template
without labels has the overall share; with no labels at all nothing is rejected and purity is
null; an empty table gives no rows.  Repeated pages count each.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import Rows, cut, read

BRANCHES, FEW, Z, WEIGHT, PURITY = 20, 4.0, 1.96, 5.0, 0.6
#: The SQL twin cannot loop: it is written out for paths of so many segments. The operator has no such bound.
SQL_LEVELS = 8

#: Kinds of variable segments, tried in this order; the expressions hold in Java and in RE2.
KINDS = (
    ("{n}", r"^[0-9]+$"),
    ("{n}.ext", r"^[0-9]+\.[a-z0-9]{1,5}$"),
    ("{date}", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("{hex}", r"^[0-9a-f]{12,}$|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"),
    ("{id}", r"^[^/]*[0-9][^/]*$"),
)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_LAST = r"([0-9]{1,18})[^0-9]*$"


def _kind(seg: str, match: str) -> str:
    """SQL for the kind of a segment; match is a format of a regular-expression test."""
    return "CASE " + " ".join(f"WHEN {match.format(s=seg, p=p)} THEN '{k}'" for k, p in KINDS) + f" ELSE {seg} END"


#: Marks of the templates, as they stand in paths and as they are written there.
_MARKS = (("*", "%2a"), ("{", "%7b"), ("}", "%7d"))


def _lower(path: str) -> str:
    """SQL for a path in lower case, without marks."""
    out = f"lower({path})"
    for mark, plain in _MARKS:
        out = f"replace({out}, '{mark}', '{plain}')"
    return out


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, seg (segments of the lexical template), lab and bad (0 or 1) of every page."""
    page, label = Rows(pages), Rows(labels)
    url = page["url"]
    parsed = page.df.select(
        page["page_id"].alias("page_id"),
        F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit("")).alias("path"),
    )
    kind = _kind("x", "{s} rlike '{p}'").replace("\\.", "\\\\.")
    seg = F.expr(f"transform(filter(split({_lower('path')}, '/'), x -> x <> ''), x -> {kind})")
    typed = parsed.select("page_id", "host", F.expr("try_cast(regexp_extract(path, '" + _LAST + "', 1) as bigint)").alias("doc"), seg.alias("seg"))
    # One row for each id; labels that are null in a part are none.
    known = label.df.select(label["doc_id"].cast("long").alias("doc"), label["quality"].alias("quality"), label["toxic"].alias("toxic"))
    known = known.where("quality is not null and toxic is not null and doc is not null").groupBy("doc").agg(F.max(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0).otherwise(1)).alias("bad"))
    return typed.join(known, "doc", "left").select("page_id", "host", "seg", F.col("bad").isNotNull().cast("long").alias("lab"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"))


def generalise(table: DataFrame) -> DataFrame:
    """Of distinct lexical templates (host, seg, n, lab, bad): with path, the generalised segments. A level is two joins on the nodes above it; paths that end higher up pass by."""
    deepest = table.agg(F.max(F.size("seg"))).first()[0] or 0
    out = table.withColumn("path", F.col("seg"))
    columns = ["host", "seg", "n", "lab", "bad", "path"]

    def replaced(k: int, marked: DataFrame, keys: int) -> DataFrame:
        """out, with a star at level k of paths whose first `keys` segments are marked."""
        short = out.where(F.size("path") < k)
        here = out.where(F.size("path") >= k).withColumn("node", F.slice("path", 1, keys)).join(marked.withColumn("hit", F.lit(True)), ["host", "node"], "left")
        star = F.when(F.col("hit"), F.expr(f"transform(path, (x, i) -> if(i = {k - 1}, '*', x))")).otherwise(F.col("path"))
        new = short.select(columns).union(here.withColumn("path", star).select(columns))
        return cut(new) if k % 2 == 0 else new

    for k in range(1, deepest + 1):
        below = out.where(F.size("path") >= k).withColumn("node", F.slice("path", 1, k - 1))
        wide = below.groupBy("host", "node").agg(F.countDistinct(F.col("path")[k - 1]).alias("kids"), F.sum("n").alias("all")).where((F.col("kids") > BRANCHES) & (F.col("all") < FEW * F.col("kids")))
        out = replaced(k, wide.select("host", "node"), k - 1)
    for k in range(deepest, 0, -1):
        below = out.where(F.size("path") >= k).select("host", F.slice("path", 1, k - 1).alias("up"), F.slice("path", 1, k).alias("node"), "lab", "bad")
        kids = below.groupBy("host", "up", "node").agg(F.sum("lab").alias("cl"), F.sum("bad").alias("cb"))
        top = kids.groupBy("host", "up").agg(F.sum("cl").alias("pl"), F.sum("cb").alias("pb"), F.count("*").alias("kids")).where("kids > 1")
        share = "(cast(pb as double) / pl)"
        differs = f"cl > 0 and pb > 0 and pb < pl and abs(cast(cb as double) / cl - {share}) > {Z}D * sqrt({share} * (1D - {share}) / cl)"
        out = replaced(k, kids.join(top, ["host", "up"]).where(f"not ({differs})").select("host", "node"), k)
    return out


def judge(pages: DataFrame, labels: DataFrame, weight: float = WEIGHT, purity: float = PURITY) -> DataFrame:
    """page_id, host, template, purity (4 decimals), rejected of every page."""
    each = cut(templates(pages, labels))
    tree = cut(generalise(each.groupBy("host", "seg").agg(F.count("*").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))))
    good = tree.agg(F.try_divide(F.sum(F.col("lab") - F.col("bad")), F.sum("lab")).alias("good"))
    pure = tree.groupBy("host", "path").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(good)).select("host", "path", F.expr(f"try_divide(cast(lab - bad as double) + {weight}D * good, cast(lab as double) + {weight}D)").alias("p"))
    leaf = tree.select("host", "seg", "path").join(pure, ["host", "path"])
    return each.join(leaf, ["host", "seg"]).select("page_id", "host", F.concat(F.lit("/"), F.array_join("path", "/")).alias("template"), F.round("p", 4).alias("purity"), F.coalesce(F.col("p") < purity, F.lit(False)).alias("rejected"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgement of every page."""
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def _sql() -> str:
    t, g = [f"t{k}" for k in range(1, SQL_LEVELS + 2)], [f"g{k}" for k in range(1, SQL_LEVELS + 2)]
    same = lambda a, b, names: " AND ".join(f"{a}.{n} IS NOT DISTINCT FROM {b}.{n}" for n in names)
    ctes = [
        f"u AS (SELECT page_id, coalesce(lower(regexp_extract(url, '{_HOST}', 1)), '') AS host, coalesce(regexp_extract(url, '{_PATH}', 1), '') AS path FROM pages)",
        "s AS (SELECT *, list_filter(string_split(" + _lower("path") + ", '/'), lambda x: x <> '') AS seg FROM u)",
        "k AS (SELECT doc_id AS doc, max(CASE WHEN quality = 1 AND toxic = 0 THEN 0 ELSE 1 END) AS bad FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1)",
        "v AS (SELECT page_id, host, try_cast(regexp_extract(path, '" + _LAST + "', 1) AS BIGINT) AS doc, " + ", ".join(_kind(f"seg[{i}]", "regexp_matches({s}, '{p}')") + f" AS t{i}" for i in range(1, SQL_LEVELS + 1)) + f", CASE WHEN len(seg) > {SQL_LEVELS} THEN '**' END AS t{SQL_LEVELS + 1} FROM s)",
        f"e AS (SELECT page_id, host, {', '.join(t)}, CASE WHEN bad IS NULL THEN 0 ELSE 1 END AS lab, coalesce(bad, 0) AS bad FROM v LEFT JOIN k USING (doc))",
        f"x0 AS (SELECT host, {', '.join(t)}, {', '.join(f'{a} AS {b}' for a, b in zip(t, g))}, count(*) AS n, sum(lab) AS lab, sum(bad) AS bad FROM e GROUP BY ALL)",
    ]
    last, number = "x0", 0
    for k in range(1, SQL_LEVELS + 1):
        node = ["host", *g[: k - 1]]
        number += 1
        ctes.append(f"n{number} AS (SELECT {', '.join(node)} FROM {last} WHERE g{k} IS NOT NULL GROUP BY ALL HAVING count(DISTINCT g{k}) > {BRANCHES} AND sum(n) < {FEW} * count(DISTINCT g{k}))")
        ctes.append(f"x{number} AS (SELECT a.* REPLACE (CASE WHEN b.host IS NOT NULL AND a.g{k} IS NOT NULL THEN '*' ELSE a.g{k} END AS g{k}) FROM {last} a LEFT JOIN n{number} b ON {same('a', 'b', node)})")
        last = f"x{number}"
    for k in range(SQL_LEVELS, 0, -1):
        node = ["host", *g[: k - 1]]
        number += 1
        ctes.append(f"c{number} AS (SELECT {', '.join([*node, f'g{k}'])}, sum(lab) AS cl, sum(bad) AS cb FROM {last} WHERE g{k} IS NOT NULL GROUP BY ALL)")
        ctes.append(f"p{number} AS (SELECT {', '.join(node)}, sum(cl) AS pl, sum(cb) AS pb FROM c{number} GROUP BY ALL HAVING count(*) > 1)")
        share = "(pb::DOUBLE / pl)"
        ctes.append(f"m{number} AS (SELECT a.* FROM c{number} a JOIN p{number} b ON {same('a', 'b', node)} WHERE NOT coalesce(cl > 0 AND pb > 0 AND pb < pl AND abs(cb::DOUBLE / cl - {share}) > {Z}::DOUBLE * sqrt({share} * (1 - {share}) / cl), false))")
        ctes.append(f"x{number} AS (SELECT a.* REPLACE (CASE WHEN b.host IS NOT NULL THEN '*' ELSE a.g{k} END AS g{k}) FROM {last} a LEFT JOIN m{number} b ON {same('a', 'b', [*node, f'g{k}'])})")
        last = f"x{number}"
    ctes.append(f"o AS (SELECT sum(lab - bad)::DOUBLE / sum(lab) AS good FROM {last})")
    ctes.append(f"r AS (SELECT host, {', '.join(g)}, '/' || concat_ws('/', {', '.join(g)}) AS template, (sum(lab - bad)::DOUBLE + {WEIGHT}::DOUBLE * any_value(good)) / (sum(lab)::DOUBLE + {WEIGHT}::DOUBLE) AS p FROM {last}, o GROUP BY ALL)")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT e.page_id, e.host, r.template, round(r.p, 4) AS purity, coalesce(r.p < {PURITY}::DOUBLE, false) AS rejected FROM e JOIN {last} a ON {same('e', 'a', ['host', *t])} JOIN r ON {same('a', 'r', ['host', *g])}"


SQL = _sql()
