"""Cross-site boilerplate lines by distinct-site spread.

Each line's hash gathers a HyperLogLog sketch of the sites it is on; sketches
merge by aggregation. A line whose estimate is clearly at or over `min_sites`
is boilerplate, clearly below is not, and one inside the sketch's error band
gets an exact distinct count. Boilerplate lines are removed from every text.

Every boilerplate line goes, whatever its share of the text. Only a text of such
lines alone that is on another site as well, sign for sign, stays whole: it is a
copy of a document, which near-dedup looks after, and not a page with furniture.

Scale: lines are 128-bit hashes, combined map-side, so a line that is on a
third of all documents is one row per task. Removed positions are worked out
per distinct text and joined back by the text's hash; both joins are plain
exchanges that AQE may split or broadcast.

Nulls and odd cases: null text counts as no line and comes back null, an empty
one empty; a null site is a site of its own; blank lines are never removed;
lines compare without white space at their ends; repeated rows keep one row
each; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise, require

LG_K = 10
#: Three standard errors of the sketch, and a little.
BAND = 3 * 1.04 / 2 ** (LG_K / 2) + 0.01
BLANK = " \t\n\r\x0b\x0c"


def _key(x: Column) -> list[Column]:
    return [F.xxhash64(x), F.xxhash64(F.lit(1), x)]


def lines_of(text: Column) -> Column:
    """The text's lines without white space at the ends, blanks included."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)))


def boilerplate(docs: DataFrame, min_sites: int = 10, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(h1, h2) of lines that are on min_sites sites or more."""
    require(docs, text_col, site_col)
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n"))
    line = docs.select(site.alias("site"), F.explode(lines_of(F.col(text_col))).alias("line")).where("line <> ''")
    keyed = line.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), "site")
    spread = keyed.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("*").alias("n"))
    # a line on min_sites sites comes min_sites times at least
    spread = spread.where(F.col("n") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - BAND))
    spread = materialise(spread, "spread", narrow=True)
    sure = F.col("sites") > min_sites * (1 + BAND)
    near = spread.where(~sure).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    pairs = keyed.join(near, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left_semi").select("h1", "h2", "site")
    exact = pairs.distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return spread.where(sure).select("h1", "h2").union(exact.select("h1", "h2"))


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(row struct of docs' columns, text, n_lines, n_removed), one row per row of docs."""
    bad = boilerplate(docs, min_sites, text_col, site_col)
    text = F.col(text_col)
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n"))
    lines = docs.select(*[k.alias(n) for k, n in zip(_key(text), ("t1", "t2"), strict=True)], F.xxhash64(site).alias("site"), F.posexplode(lines_of(text)).alias("at", "line")).where("line <> ''")
    hashed = lines.select("t1", "t2", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))
    b = bad.toDF("b1", "b2")
    hits = hashed.join(b, (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")), "left_semi").select("t1", "t2", "site", "at")
    # copies of one text bring the same positions; collect_set keeps as many as the text has lines
    per_text = hits.groupBy("t1", "t2").agg(F.sort_array(F.collect_set("at")).alias("at"), (F.min("site") < F.max("site")).alias("copied")).toDF("r1", "r2", "at", "copied")
    # a flag for each line up to the last one removed, so that a look at one costs the same however many there are
    gap = lambda x, i: F.concat(F.array_repeat(F.lit(False), F.when(i == 0, x).otherwise(x - F.get("at", i - 1) - 1)), F.array(F.lit(True)))
    per_text = materialise(per_text.select("r1", "r2", "copied", F.size("at").alias("n_bad"), F.flatten(F.transform("at", gap)).alias("bad")), "removed-lines")
    rows = docs.select(F.struct("*").alias("row"), *[k.alias(n) for k, n in zip(_key(text), ("t1", "t2"), strict=True)])
    joined = rows.join(per_text, (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")), "left")
    own = F.col("row").getField(text_col)
    good = F.filter(F.split(own, "\n", -1), lambda x, i: ~F.coalesce(F.get("bad", i), F.lit(False)))
    some = joined.select("row", "n_bad", "copied", own.alias("own"), F.when(F.col("bad").isNull(), own).otherwise(F.array_join(good, "\n")).alias("kept"))
    whole = F.col("n_bad").isNull() | (F.col("copied") & (F.btrim("kept", F.lit(BLANK)) == ""))
    n_lines = F.size(F.filter(lines_of(F.col("own")), lambda x: x != ""))
    return some.select(
        "row",
        F.when(whole, F.col("own")).otherwise(F.col("kept")).alias("text"),
        F.when(F.col("own").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(F.col("n_bad")).cast("long").alias("n_removed"),
    )


def op9(docs: DataFrame) -> DataFrame:
    return remove_boilerplate(docs.select("doc_id", "source", "text")).select("row.doc_id", "n_lines", "n_removed", "text")


#: The same by exact distinct counts.
SQL = r"""
WITH l AS (SELECT DISTINCT source, trim(x.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
           FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) x),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= 10),
d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
p AS (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
q AS (SELECT k, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM p),
g AS (SELECT k, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b IS NULL) AS kept,
             count(*) FILTER (WHERE t <> '') AS n_lines, count(*) FILTER (WHERE b IS NOT NULL) AS n_removed
      FROM (SELECT q.*, b.line AS b FROM q LEFT JOIN b ON q.t = b.line) z GROUP BY k),
c AS (SELECT text, count(DISTINCT coalesce('s' || source, 'n')) > 1 AS copied FROM documents GROUP BY text),
s AS (SELECT d.doc_id, d.text, coalesce(g.kept, '') AS kept, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, copied AND trim(coalesce(g.kept, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS whole
      FROM d LEFT JOIN g USING (k) LEFT JOIN c ON d.text IS NOT DISTINCT FROM c.text)
SELECT doc_id, n_lines, CASE WHEN n_removed = 0 OR whole THEN 0 ELSE n_removed END AS n_removed, CASE WHEN n_removed = 0 OR whole THEN text ELSE kept END AS text FROM s
"""
