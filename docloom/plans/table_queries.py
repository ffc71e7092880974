"""Queries of the table-region, list, clip and route operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import tables as B
from docloom.plans.office_queries import CELLS, FULL, SQL_CELLS
from docloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.replace(" div ", " // ")
        return fn

    return keep


#: sheets with more and more columns without data
SPARSE = (*CELLS[:3], "CASE WHEN o_orderkey % 8 < o_orderkey div 200 % 9 OR (o_orderkey div 200 % 2 = 0 AND o_orderkey % 200 div 8 < 14) THEN NULL ELSE o_orderstatus END AS value", "o_custkey % 5 < 2 AS merged")


@query(f"""WITH cells AS (SELECT {', '.join(SPARSE)} FROM orders),
s AS (SELECT sheet, count(DISTINCT row) AS n_rows, count(DISTINCT CASE WHEN {FULL} THEN col END) AS data_cols, 1 - count(DISTINCT CASE WHEN {FULL} THEN row END) / count(DISTINCT row) AS row_ratio, 1 - count(DISTINCT CASE WHEN {FULL} THEN col END) / count(DISTINCT col) AS col_ratio, avg(CASE WHEN merged THEN 1.0 ELSE 0.0 END) AS m FROM cells GROUP BY sheet)
SELECT sheet, row_ratio, col_ratio, row_ratio < 0.5 AND col_ratio < CASE WHEN n_rows <= 10 AND m > 0.3 AND data_cols >= 3 THEN 0.8 ELSE 0.5 END AS valid FROM s""")
def bordered_validity(spark, sf_dir):
    return B.valid_bordered(table(spark, sf_dir, "orders").selectExpr(*SPARSE))


WIDE = ("o_orderkey div 240 AS sheet", "o_orderkey % 12 AS col", "CASE WHEN o_orderkey % 12 IN (3, 4) OR (o_orderkey div 240 % 2 = 0 AND o_orderkey % 12 IN (8, 9, 10)) THEN NULL ELSE o_orderstatus END AS value")


@query(f"""WITH c AS (SELECT {', '.join(WIDE)} FROM orders), p AS (SELECT sheet, col, max(CASE WHEN {FULL} THEN 1 ELSE 0 END) AS full_ FROM c GROUP BY sheet, col),
f AS (SELECT *, min(CASE WHEN full_ = 1 THEN col END) OVER s AS c1, max(CASE WHEN full_ = 1 THEN col END) OVER s AS c2, count(*) OVER s AS n FROM p WINDOW s AS (PARTITION BY sheet)),
r AS (SELECT sheet, col, col - row_number() OVER (PARTITION BY sheet ORDER BY col) AS k FROM f WHERE n >= 9 AND full_ = 0 AND col BETWEEN c1 AND c2)
SELECT sheet, CAST((min(col) + max(col)) div 2 AS bigint) AS split FROM r GROUP BY sheet, k HAVING max(col) > min(col)""")
def horizontal_split(spark, sf_dir):
    return B.column_splits(table(spark, sf_dir, "orders").selectExpr(*WIDE))


STRONG = ("o_orderkey div 200 AS sheet", "o_orderkey % 200 div 8 AS row", "CASE WHEN o_orderkey div 8 % 7 = 5 THEN NULL ELSE o_orderstatus END AS value", "o_orderkey div 8 % 6 = 2 AND o_custkey % 5 > 0 AS strong")


@query(f"""WITH c AS (SELECT {', '.join(STRONG)} FROM orders), r AS (SELECT sheet, row, max(CASE WHEN {FULL} THEN 1 ELSE 0 END) AS full_, avg(CASE WHEN strong THEN 1.0 ELSE 0.0 END) >= 0.5 AS strong FROM c GROUP BY sheet, row),
k AS (SELECT *, full_ = 1 AND strong AS opens, sum(CASE WHEN (full_ = 1 AND strong) OR full_ = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet ORDER BY row ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT sheet, min(row) AS r1, max(row) AS r2 FROM k GROUP BY sheet, k HAVING bool_or(opens)""")
def row_boundary_regions(spark, sf_dir):
    return B.strong_regions(table(spark, sf_dir, "orders").selectExpr(*STRONG))


NOTES = ("o_orderkey div 200 AS sheet", "o_orderkey % 200 div 8 AS row", "CASE WHEN o_orderkey % 200 div 8 < o_orderkey div 200 % 5 THEN '※' || o_orderstatus WHEN o_orderkey % 200 div 8 > 20 THEN NULL ELSE o_orderstatus END AS value", "o_orderkey % 200 div 8 = 22 AND o_custkey % 3 = 0 AS side")


@query(f"WITH c AS (SELECT {', '.join(NOTES)} FROM orders) SELECT sheet, min(row) AS r1, max(row) AS r2 FROM c WHERE ({FULL} AND NOT regexp_matches(value, '※|注意|注記|備考|説明')) OR side GROUP BY sheet HAVING max(row) > min(row)")
def annotation_trim(spark, sf_dir):
    return B.trim_regions(table(spark, sf_dir, "orders").selectExpr(*NOTES))


@query(f"""WITH {SQL_CELLS}, t AS (SELECT sheet, row, col, trim(value) AS text FROM cells WHERE {FULL}), g AS (SELECT sheet, row, col FROM (SELECT DISTINCT sheet, row FROM t) JOIN (SELECT DISTINCT sheet, col FROM t) USING (sheet)),
r AS (SELECT sheet, row, '| ' || string_agg(coalesce(text, ''), ' | ' ORDER BY col) || ' |' AS line, count(*) AS n FROM g LEFT JOIN t USING (sheet, row, col) GROUP BY sheet, row HAVING count(*) >= 2),
f AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row) AS k FROM (SELECT *, lag(line) OVER (PARTITION BY sheet ORDER BY row) AS before FROM r) WHERE before IS NULL OR before <> line)
SELECT sheet, string_agg(CASE WHEN k = 1 THEN line || chr(10) || '|' || repeat(' --- |', n::int) ELSE line END, chr(10) ORDER BY row) AS md FROM f GROUP BY sheet""")
def table_without_header(spark, sf_dir):
    return B.headless_tables(table(spark, sf_dir, "orders").selectExpr(*CELLS))


BLOCKS = (
    "user_id AS page", "event_id AS seq", "CAST(event_id % 9 * 8 AS double) AS x", "CAST(event_id div 3 % 1000 * 25 + event_id % 3 * 10 AS double) AS y",
    "CASE event_id % 7 WHEN 0 THEN 'list_item' WHEN 1 THEN 'list_item' WHEN 2 THEN 'heading' ELSE 'paragraph' END AS kind", "event_type || event_id % 11 AS text",
)


@query(f"""WITH b AS (SELECT {', '.join(BLOCKS)} FROM events),
f AS (SELECT *, coalesce(kind = 'paragraph' AND y - lag(y) OVER w <= 15 AND (x - last_value(CASE WHEN kind = 'list_item' THEN x END IGNORE NULLS) OVER (PARTITION BY page ORDER BY seq ROWS UNBOUNDED PRECEDING) BETWEEN 5 AND 60 OR length(text) <= 8), false) AS follows FROM b WINDOW w AS (PARTITION BY page ORDER BY seq)),
k AS (SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM f),
h AS (SELECT *, first_value(kind) OVER (PARTITION BY page, k ORDER BY seq) AS head FROM k)
SELECT page, min(seq) AS seq, arg_min(kind, seq) AS kind, string_agg(text, '' ORDER BY seq) AS text FROM h GROUP BY page, k, CASE WHEN head = 'list_item' THEN 0 ELSE seq END""")
def list_continuations(spark, sf_dir):
    return B.join_list_items(table(spark, sf_dir, "events").selectExpr(*BLOCKS))


@query(f"""WITH b AS (SELECT {', '.join(BLOCKS[:5])} FROM events),
f AS (SELECT *, coalesce(kind IN ('heading', 'list_item') AND lag(kind) OVER w IN ('heading', 'list_item') AND y - lag(y) OVER w <= 3000 AND abs(x - lag(x) OVER w) <= 40, false) AS linked FROM b WINDOW w AS (PARTITION BY page ORDER BY seq)),
k AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT page, seq, x, y, CASE WHEN bool_or(kind = 'list_item') OVER (PARTITION BY page, k) THEN 'list_item' ELSE kind END AS kind FROM k""")
def heading_demotion(spark, sf_dir):
    return B.demote_headings(table(spark, sf_dir, "events").selectExpr(*BLOCKS[:5]), 3000.0, 40.0)


CLIP = "l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS id, CAST(l_suppkey % 50 * 10 AS double) AS y0, CAST(l_suppkey % 50 * 10 + l_quantity AS double) AS y1"
MARKS = "l_orderkey AS page, CAST(l_partkey % 600 AS double) AS y, CASE WHEN l_linenumber % 2 = 0 THEN 'caption' ELSE 'body' END AS kind"


@query(f"""WITH b AS (SELECT DISTINCT {CLIP} FROM lineitem), l AS (SELECT {MARKS} FROM lineitem),
f AS (SELECT b.page, id, y0, y1, min(y) FILTER (kind = 'caption' AND y >= y1) AS below, max(y) FILTER (kind = 'body' AND y <= y0) AS above FROM b LEFT JOIN l ON b.page = l.page GROUP BY b.page, id, y0, y1),
t AS (SELECT page, id, greatest(y0 - 20, coalesce(above + 5, y0 - 20), 0.0) AS top, least(y1 + 20, coalesce(below - 5, y1 + 20)) AS bottom FROM f)
SELECT page, id, top, greatest(bottom, top + 50) AS bottom FROM t""")
def figure_clip(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return B.clip_boxes(li.selectExpr(*CLIP.split(", ")).distinct(), li.selectExpr(*MARKS.split(", ")))


@query("SELECT o_orderkey AS page, CASE WHEN o_custkey % 6 = 0 THEN 'scan' WHEN o_custkey % 3 > 0 OR o_custkey % 5 = 0 THEN 'structured' ELSE 'render' END AS route FROM orders")
def page_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), B.page_route(F.expr("o_custkey % 6 = 0"), F.expr("o_custkey % 3"), F.expr("CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END")).alias("route"))


@query("SELECT p_size AS sheet, p_partkey AS id, CAST(greatest(p_partkey % 40 + 1 - CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END, 1) AS bigint) AS r1, CAST(p_partkey % 20 + 1 AS bigint) AS c1, CAST(p_partkey % 40 + 3 AS bigint) AS r2, CAST(p_partkey % 20 + 5 AS bigint) AS c2 FROM part")
def drawing_ranges(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_size AS sheet", "p_partkey AS id", "p_partkey % 40 AS row0", "p_partkey % 20 AS col0", "p_partkey % 40 + 2 AS row1", "p_partkey % 20 + 4 AS col1", "CASE WHEN p_partkey % 3 = 0 THEN -5 ELSE 5 END AS adjust")
    return B.anchor_ranges(d)


@query("""WITH s AS (SELECT p_size AS sheet, p_partkey AS id, '{"id":' || p_partkey || ',"name":"' || p_name || '","kind":"' || p_type || '","x":' || p_partkey % 97 || ',"y":' || p_partkey % 89 || ',"w":10,"h":20' || CASE WHEN p_partkey % 2 = 0 THEN ',"text":"' || p_brand || '"' ELSE '' END || '}' AS one FROM part)
SELECT sheet, '[' || string_agg(one, ',' ORDER BY id) || ']' AS json FROM s GROUP BY sheet""")
def shape_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_size AS sheet", "p_partkey AS id", "p_name AS name", "p_type AS kind", "p_partkey % 97 AS x", "p_partkey % 89 AS y", "10 AS w", "20 AS h", "CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS text")
    return B.shape_json(d)


LOCALE = "CASE n_nationkey % 7 WHEN 0 THEN 'en_US.UTF-8' WHEN 1 THEN 'C' WHEN 2 THEN 'POSIX' WHEN 3 THEN '' WHEN 4 THEN 'ja_JP' WHEN 5 THEN 'EN' END"


@query(f"SELECT n_nationkey, CASE WHEN lower(regexp_extract(coalesce({LOCALE}, ''), '^[A-Za-z]*')) = 'en' THEN 'en' ELSE 'ja' END AS lang FROM nation")
def label_language(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", B.language_of(F.expr(LOCALE)).alias("lang"))


READ = "l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS seq, CAST(l_suppkey % 10 * 6 AS double) AS y, l_returnflag || l_linenumber AS text"


@query(f"""WITH r AS (SELECT DISTINCT {READ} FROM lineitem), p AS (SELECT page, list({{'y': y, 'text': text}} ORDER BY seq, y, text) AS parts FROM r GROUP BY page)
SELECT page, list_reduce(parts, lambda a, b: CASE WHEN abs(b.y - a.y) <= 10 THEN {{'y': a.y, 'text': a.text || '  ' || b.text}} ELSE {{'y': b.y, 'text': a.text || chr(10) || chr(10) || b.text}} END).text AS text FROM p""")
def ocr_line_combine(spark, sf_dir):
    return B.combine_lines(table(spark, sf_dir, "lineitem").selectExpr(*READ.split(", ")).distinct())
