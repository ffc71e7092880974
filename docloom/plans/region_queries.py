"""Queries of the region, closure and page operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import readable_ja
from docloom.operators import regions as R
from docloom.plans.office_queries import CELLS
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


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*CELLS)


LINED = (*CELLS[:4], "o_custkey % 4 < 3 AS has_left", "o_custkey % 3 = 1 AS has_top")
FILLED = "value IS NOT NULL AND trim(value) <> ''"
#: Rectangles in the order of their first cells; a cell inside an earlier one starts none. o: (sheet, k, r1, r2, c1, c2) by k.
TAKE = """r AS (SELECT DISTINCT sheet, CAST(0 AS bigint) AS k, CAST([] AS struct(r1 bigint, r2 bigint, c1 bigint, c2 bigint)[]) AS got FROM o
 UNION ALL SELECT r.sheet, o.k, CASE WHEN len(list_filter(r.got, lambda q: o.r1 BETWEEN q.r1 AND q.r2 AND o.c1 BETWEEN q.c1 AND q.c2)) = 0 THEN list_append(r.got, {'r1': o.r1, 'r2': o.r2, 'c1': o.c1, 'c2': o.c2}) ELSE r.got END FROM r JOIN o ON o.sheet = r.sheet AND o.k = r.k + 1),
g AS (SELECT sheet, q.r1 AS r1, q.r2 AS r2, q.c1 AS c1, q.c2 AS c2 FROM (SELECT sheet, unnest(got) AS q FROM (SELECT sheet, arg_max(got, k) AS got FROM r GROUP BY sheet)))"""


@query(f"""WITH RECURSIVE c AS (SELECT {', '.join(LINED)} FROM orders), w AS (SELECT a.sheet, a.row, a.col, max(b.col) AS c2 FROM c a JOIN c b ON a.sheet = b.sheet AND a.row = b.row AND b.has_left AND b.col >= a.col WHERE a.has_left AND a.has_top GROUP BY 1, 2, 3 HAVING count(*) >= 2),
n AS (SELECT w.sheet, w.row, w.col, w.c2, i.i, (SELECT count(*) FROM c WHERE c.sheet = w.sheet AND c.row = i.i AND c.has_left AND c.col BETWEEN w.col AND w.c2) AS n FROM w JOIN (SELECT unnest(range(0, 27)) AS i) i ON i.i > w.row),
d AS (SELECT sheet, row, col, c2, min(i) - 1 AS r2 FROM n WHERE n < 2 GROUP BY 1, 2, 3, 4),
o AS (SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY row, col) AS k, CAST(row AS bigint) AS r1, CAST(r2 AS bigint) AS r2, CAST(col AS bigint) AS c1, CAST(c2 AS bigint) AS c2 FROM d), {TAKE},
f AS (SELECT g.sheet, r1, r2, c1, c2, count(DISTINCT row) AS full_rows, count(DISTINCT col) AS full_cols FROM g LEFT JOIN c ON c.sheet = g.sheet AND row BETWEEN r1 AND r2 AND col BETWEEN c1 AND c2 AND {FILLED} GROUP BY 1, 2, 3, 4, 5)
SELECT sheet, r1, r2, c1, c2 FROM f WHERE (r2 > r1 OR c2 - c1 >= 2) AND c2 > c1 AND r2 - r1 + 1 - full_rows < 0.5 * (r2 - r1 + 1) AND c2 - c1 + 1 - full_cols < 0.5 * (c2 - c1 + 1)""")
def bordered_regions(spark, sf_dir):
    return R.bordered_regions(table(spark, sf_dir, "orders").selectExpr(*LINED).withColumnsRenamed({"has_left": "left", "has_top": "top"}))


@query(f"""WITH RECURSIVE c AS (SELECT {', '.join(CELLS[:4])} FROM orders), v AS (SELECT *, row - row_number() OVER (PARTITION BY sheet, col ORDER BY row) AS down, col - row_number() OVER (PARTITION BY sheet, row ORDER BY col) AS across FROM c WHERE value IS NOT NULL),
x AS (SELECT *, max(row) OVER (PARTITION BY sheet, col, down) AS r2, max(col) OVER (PARTITION BY sheet, row, across) AS c2 FROM v),
o AS (SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY row, col) AS k, CAST(row AS bigint) AS r1, CAST(r2 AS bigint) AS r2, CAST(col AS bigint) AS c1, CAST(c2 AS bigint) AS c2 FROM x WHERE trim(value) <> ''), {TAKE},
m AS (SELECT g.sheet, r1, r2, c1, c2, row, count(*) AS n FROM g JOIN c ON c.sheet = g.sheet AND row BETWEEN r1 AND r2 AND col BETWEEN c1 AND c2 AND {FILLED} GROUP BY 1, 2, 3, 4, 5, 6)
SELECT sheet, r1, r2, c1, c2 FROM m WHERE c2 > c1 GROUP BY 1, 2, 3, 4, 5 HAVING count(*) FILTER (n >= 2) >= 0.3 * (r2 - r1 + 1)""")
def discrete_regions(spark, sf_dir):
    return R.discrete_regions(_cells(spark, sf_dir))


MARKS = ("user_id AS page", "event_id AS id", "CAST(event_id % 40 * 5 AS double) AS x0", "CAST(event_id % 40 * 5 + 10 AS double) AS x1", "CAST(event_id % 7 * 6 AS double) AS y", "CAST(4 + event_id % 9 AS double) AS size", "event_type AS text")


@query(f"""WITH RECURSIVE e AS (SELECT {', '.join(MARKS)} FROM events),
p AS (SELECT page, list(id ORDER BY id) AS ids, list(x0 ORDER BY id) AS x0, list(x1 ORDER BY id) AS x1, list(y ORDER BY id) AS y, list(size ORDER BY id) AS size, list(text ORDER BY id) AS text FROM e GROUP BY page),
r AS (SELECT page, 0 AS k, CAST([] AS bigint[]) AS gone, text FROM p
 UNION ALL SELECT page, k, CASE WHEN j IS NULL THEN gone ELSE list_append(gone, j) END, CASE WHEN j IS NULL THEN text ELSE list_transform(text, lambda t, i: CASE WHEN i = k THEN rtrim(t) || '<sup>' || trim(text[j]) || '</sup>' ELSE t END) END
 FROM (SELECT r.page, r.k + 1 AS k, r.gone, r.text, CASE WHEN list_contains(r.gone, r.k + 1) THEN NULL ELSE list_filter(range(1, len(p.ids) + 1), lambda j: j <> r.k + 1 AND NOT list_contains(r.gone, j) AND abs(p.y[r.k + 1] - p.y[j]) < 10 AND p.size[j] < 7.0 AND length(trim(r.text[j])) BETWEEN 1 AND 15 AND abs(p.x1[r.k + 1] - p.x0[j]) < 10)[1] END AS j FROM r JOIN p ON p.page = r.page WHERE r.k < len(p.ids)))
SELECT l.page, p.ids[i] AS id, l.text[i] AS text FROM (SELECT page, gone, text, unnest(range(1, len(text) + 1)) AS i FROM (SELECT page, arg_max(gone, k) AS gone, arg_max(text, k) AS text FROM r GROUP BY page)) l JOIN p ON p.page = l.page WHERE NOT list_contains(gone, i)""")
def superscript_merge(spark, sf_dir):
    return R.superscripts(table(spark, sf_dir, "events").selectExpr(*MARKS), 10.0)


@query("""WITH RECURSIVE l AS (SELECT s_nationkey AS sheet, s_suppkey AS a, s_suppkey * 7 % 100 AS b FROM supplier), e AS (SELECT * FROM l UNION SELECT sheet, b, a FROM l),
r AS (SELECT s_nationkey AS sheet, min(s_suppkey) AS id FROM supplier GROUP BY 1 UNION SELECT r.sheet, e.b FROM r JOIN e ON e.sheet = r.sheet AND e.a = r.id) SELECT DISTINCT sheet, id FROM r""")
def connector_closure(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return R.connector_closure(s.selectExpr("s_nationkey AS sheet", "s_suppkey AS a", "s_suppkey * 7 % 100 AS b"), s.groupBy(F.col("s_nationkey").alias("sheet")).agg(F.min("s_suppkey").alias("id")))


@query("SELECT l_orderkey AS page, max(l_linenumber - 1) = 0 AND count(*) = 1 AND max(l_quantity / 50.0) >= 0.8 AS is_scan FROM lineitem GROUP BY 1")
def scan_page_test(spark, sf_dir):
    return R.scan_pages(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_quantity AS area", "50.0D AS page_area", "l_linenumber - 1 AS n_text"))


TABLES = ("l_orderkey AS page", "CAST(l_linenumber * 100000000 + l_partkey * 100 + l_quantity AS bigint) AS id", "CAST(l_partkey % 100 AS double) AS x0", "CAST(l_partkey % 100 + 2 * l_quantity AS double) AS x1", "CAST(l_suppkey % 20 * 20 AS double) AS y0", "CAST(l_suppkey % 20 * 20 + 15 AS double) AS y1")


@query(f"""WITH t AS (SELECT {', '.join(TABLES)} FROM lineitem), f AS (SELECT *, CASE WHEN y0 - lag(y1) OVER w <= 10 AND least(x1, lag(x1) OVER w) - greatest(x0, lag(x0) OVER w) > 0.5 * least(x1 - x0, lag(x1) OVER w - lag(x0) OVER w) THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY page ORDER BY y0, id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY y0, id ROWS UNBOUNDED PRECEDING) AS t FROM f) SELECT page, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM g GROUP BY page, t""")
def ruled_table_merge(spark, sf_dir):
    return R.merge_ruled_tables(table(spark, sf_dir, "lineitem").selectExpr(*TABLES))


@query("""WITH b AS (SELECT p_partkey % 100 AS page, p_partkey AS box, p_size * 10 AS x0, p_size * 10 + 80 AS x1, p_partkey % 37 * 10 AS y0, p_partkey % 37 * 10 + 90 AS y1 FROM part),
l AS (SELECT l_suppkey AS page, CAST(l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey * 100 + l_quantity AS bigint) AS id, l_partkey % 600 AS x, l_orderkey % 400 AS y, strftime(l_shipdate, '%Y-%m-%d') AS text FROM lineitem)
SELECT b.page, box, list(text ORDER BY y, x, id, text) AS texts FROM b JOIN l ON l.page = b.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY b.page, box""")
def figure_text(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS page", "CAST(l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey * 100 + l_quantity AS bigint) AS id", "l_partkey % 600 AS x", "l_orderkey % 400 AS y", "date_format(l_shipdate, 'yyyy-MM-dd') AS text")
    boxes = table(spark, sf_dir, "part").selectExpr("p_partkey % 100 AS page", "p_partkey AS box", "p_size * 10 AS x0", "p_size * 10 + 80 AS x1", "p_partkey % 37 * 10 AS y0", "p_partkey % 37 * 10 + 90 AS y1")
    return R.text_in_boxes(lines, boxes)


SHAPES = ("c_nationkey * 100 + c_custkey % 50 AS sheet", "c_custkey AS id", "c_custkey * 7 % 60 AS r1", "c_custkey * 7 % 60 + c_custkey % 4 AS r2")


@query(f"""WITH s AS (SELECT {', '.join(SHAPES)} FROM customer), c AS (SELECT *, coalesce(r1 - max(r2) OVER (PARTITION BY sheet ORDER BY r1, r2, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 >= 2, false) AS cut, max(r2 - r1 + 1) OVER (PARTITION BY sheet) >= 0.75 * (max(r2) OVER (PARTITION BY sheet) - min(r1) OVER (PARTITION BY sheet) + 1) AS wide FROM s)
SELECT sheet, id, r1, r2, CASE WHEN wide THEN 0 ELSE max(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY sheet ORDER BY r1, r2, id ROWS UNBOUNDED PRECEDING) END AS cluster FROM c""")
def shape_clusters(spark, sf_dir):
    return R.shape_clusters(table(spark, sf_dir, "customer").selectExpr(*SHAPES))


@query("""WITH l AS (SELECT source AS doc, doc_id AS seq, CASE WHEN doc_id % 9 = 0 THEN 'これは' ELSE text END AS text FROM documents), m AS (SELECT doc, max(seq) FILTER (text = 'これは') AS last FROM l GROUP BY doc) SELECT l.doc, seq, text FROM l JOIN m ON l.doc = m.doc AND seq <= last""")
def trim_trailing_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("source AS doc", "doc_id AS seq", "CASE WHEN doc_id % 9 = 0 THEN 'これは' ELSE text END AS text")
    return R.trim_unreadable(d, readable_ja(F.col("text")))


@query(f"""WITH c AS (SELECT {', '.join(CELLS[:4])} FROM orders), m AS (SELECT sheet AS region, count(DISTINCT row) AS rows, count(DISTINCT col) AS cols, count(*) AS n, avg(length(value)) AS mean, avg(CASE WHEN value LIKE '%/%/%' THEN 1.0 ELSE 0.0 END) AS paths FROM c WHERE trim(coalesce(value, '')) <> '' GROUP BY 1)
SELECT region, CASE WHEN rows = 1 AND n > 1 THEN false WHEN cols = 1 THEN true WHEN paths > 0.25 THEN true WHEN mean > 60 AND rows <= 8 THEN true ELSE false END AS is_text FROM m""")
def plain_text_region(spark, sf_dir):
    return R.is_plain_text(_cells(spark, sf_dir).withColumnRenamed("sheet", "region"))


@query("""WITH v AS (SELECT vec_id, list_transform(range(0, 240), lambda i: CASE WHEN (i + vec_id) % 80 < 4 + vec_id % 9 THEN 0.0 ELSE greatest(CAST(embedding[1 + i % len(embedding)] AS double), 0.06) END) AS ink FROM embeddings),
p AS (SELECT vec_id, unnest(range(0, 240)) AS i, unnest(ink) AS x, list_max(ink) AS top FROM v), q AS (SELECT vec_id, i, x < 0.05 * top AS low FROM p),
s AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id, low ORDER BY i) AS run, low FROM q),
g AS (SELECT vec_id, min(i) AS a, max(i) + 1 AS b FROM s WHERE low GROUP BY vec_id, run HAVING count(*) >= 5 AND max(i) < 239),
e AS (SELECT vec_id, coalesce(lag(b) OVER (PARTITION BY vec_id ORDER BY a), 0) AS top, a AS bottom FROM g UNION ALL SELECT v.vec_id, coalesce(max(b), 0), 240 FROM v LEFT JOIN g ON g.vec_id = v.vec_id GROUP BY v.vec_id)
SELECT vec_id, CASE WHEN count(*) FILTER (bottom - top >= 20) > 1 THEN string_agg(top || '-' || bottom, ',' ORDER BY top) FILTER (bottom - top >= 20) ELSE '0-240' END AS lines FROM e GROUP BY vec_id""")
def split_text_lines(spark, sf_dir):
    ink = F.expr("transform(sequence(0, 239), i -> CASE WHEN (i + vec_id) % 80 < 4 + vec_id % 9 THEN 0.0D ELSE greatest(cast(embedding[i % size(embedding)] AS double), 0.06D) END)")
    lines = R.split_lines(F.col("ink"))
    return table(spark, sf_dir, "embeddings").select("vec_id", ink.alias("ink")).select("vec_id", F.array_join(F.transform(lines, lambda x: F.concat(x["top"].cast("string"), F.lit("-"), x["bottom"].cast("string"))), ",").alias("lines"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '- ' || doc_id || ' -' ELSE 'Page ' || doc_id END AS t, doc_id % 100 * 8.0 AS y FROM documents) SELECT doc_id, doc_id % 5 = 0 OR (y < 96 OR y > 720) AS furniture FROM d""")
def header_footer_test(spark, sf_dir):
    from docloom.functions.text import furniture

    t, y = F.expr("CASE WHEN doc_id % 5 = 0 THEN '- ' || doc_id || ' -' ELSE 'Page ' || doc_id END"), F.expr("doc_id % 100 * 8.0D")
    return table(spark, sf_dir, "documents").select("doc_id", R.is_furniture(t, furniture(t), F.array(F.lit("Page <NUM>")), y, F.lit(800.0)).alias("furniture"))
