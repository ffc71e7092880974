"""Queries of the sheet, chart, event-stream, heading and slide operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import charts as C
from docloom.operators import events as E
from docloom.operators import grid as X
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


#: orders as the cells of sheets of 25 rows and 8 columns
CELLS = (
    "o_orderkey div 200 AS sheet", "o_orderkey % 200 div 8 AS row", "o_orderkey % 8 AS col",
    "CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 7 = 1 THEN ':' WHEN o_custkey % 11 = 2 THEN ' ' ELSE o_orderstatus || o_custkey % 5 END AS value",
    "o_custkey % 13 = 3 AS styled", "o_custkey % 4 = 1 AS border",
)
SQL_CELLS = f"cells AS (SELECT {', '.join(CELLS)} FROM orders)"
FULL = "value IS NOT NULL AND trim(value) <> ''"


def cells(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*CELLS)


@query(f"WITH {SQL_CELLS} SELECT sheet, min(row) AS r1, max(row) AS r2, min(col) AS c1, max(col) AS c2 FROM cells WHERE ({FULL}) OR styled GROUP BY sheet")
def data_bounds(spark, sf_dir):
    return X.data_bounds(cells(spark, sf_dir))


@query(f"""WITH {SQL_CELLS}, r AS (SELECT sheet, row, min(col) AS c1, max(col) AS c2 FROM cells WHERE {FULL} GROUP BY sheet, row HAVING count(DISTINCT col) >= 5), i AS (SELECT *, row - row_number() OVER (PARTITION BY sheet ORDER BY row) AS k FROM r)
SELECT sheet, min(row) AS r1, max(row) AS r2, min(c1) AS c1, max(c2) AS c2 FROM i GROUP BY sheet, k HAVING max(row) - min(row) + 1 >= 3""")
def row_runs_tables(spark, sf_dir):
    return X.row_runs(cells(spark, sf_dir), least_cells=5)


@query(f"WITH {SQL_CELLS}, r AS (SELECT sheet, row, bool_or(trim(value) IN (':', '：')) AS colon FROM cells GROUP BY sheet, row) SELECT sheet, count(*) AS n_rows, count(*) FILTER (colon) AS colon_rows, count(*) FILTER (colon) >= 0.5 * count(*) AS is_list FROM r GROUP BY sheet")
def colon_list_filter(spark, sf_dir):
    return X.colon_lists(cells(spark, sf_dir))


@query(f"WITH {SQL_CELLS} SELECT sheet, col, count(*) AS n, avg(CASE WHEN {FULL} THEN 1.0 ELSE 0.0 END) AS filled, avg(CASE WHEN border THEN 1.0 ELSE 0.0 END) AS bordered FROM cells GROUP BY sheet, col")
def density_profile(spark, sf_dir):
    return X.density(cells(spark, sf_dir))


MERGES = ("p_partkey % 75 AS sheet", "p_partkey div 75 % 5 * 5 AS r1", "p_partkey div 75 % 5 * 5 + p_size % 4 AS r2", "p_partkey div 75 div 5 % 2 * 4 AS c1", "p_partkey div 75 div 5 % 2 * 4 + p_size % 3 AS c2")
SQL_MERGES = f"merges AS (SELECT sheet, r1, min(r2) AS r2, c1, min(c2) AS c2 FROM (SELECT {', '.join(MERGES)} FROM part) GROUP BY sheet, r1, c1)"


@query(f"""WITH {SQL_CELLS}, {SQL_MERGES} SELECT c.sheet, c.row, c.col, CASE WHEN c.value IS NULL OR trim(c.value) = '' THEN coalesce(f.value, c.value) ELSE c.value END AS value FROM cells c
LEFT JOIN merges m ON c.sheet = m.sheet AND c.row BETWEEN m.r1 AND m.r2 AND c.col BETWEEN m.c1 AND m.c2 LEFT JOIN cells f ON f.sheet = m.sheet AND f.row = m.r1 AND f.col = m.c1""")
def merged_cell_expand(spark, sf_dir):
    merges = table(spark, sf_dir, "part").selectExpr(*MERGES).groupBy("sheet", "r1", "c1").agg(F.min("r2").alias("r2"), F.min("c2").alias("c2"))
    return X.expand_merged(cells(spark, sf_dir), merges)


@query(f"""WITH {SQL_CELLS}, refs AS (SELECT p_partkey AS ref_id, p_partkey % 75 AS sheet, p_size % 20 AS r1, p_size % 20 + 3 AS r2, p_partkey % 5 + 1 AS c1, p_partkey % 5 + 3 AS c2 FROM part)
SELECT ref_id, list(coalesce(value, '-') ORDER BY row, col) AS values FROM refs r JOIN cells c ON c.sheet = r.sheet AND c.row BETWEEN r.r1 AND r.r2 AND c.col BETWEEN r.c1 AND r.c2 GROUP BY ref_id""")
def cell_range_resolve(spark, sf_dir):
    ref = F.expr("concat(p_partkey % 75, '!$', substring('ABCDEFGH', p_partkey % 5 + 1, 1), '$', p_size % 20, ':$', substring('ABCDEFGH', p_partkey % 5 + 3, 1), '$', p_size % 20 + 3)")
    refs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref_id"), X.parse_range(ref).alias("r")).select("ref_id", F.col("r.sheet").cast("long").alias("sheet"), "r.r1", "r.r2", "r.c1", "r.c2")
    return X.resolve_ranges(cells(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit("-"))), refs)


@query(f"""WITH {SQL_CELLS}, regions AS (SELECT DISTINCT p_partkey % 75 AS sheet, p_size % 3 AS region, p_size % 3 * 8 + 4 AS r1 FROM part), t AS (SELECT sheet, row, value AS text, border AS bold FROM cells WHERE {FULL})
SELECT sheet, region, text AS title FROM (SELECT g.sheet, region, text, row_number() OVER (PARTITION BY g.sheet, region ORDER BY row <> r1 - 1, NOT bold, row >= r1, length(text), abs(r1 - row), row, text) AS k FROM regions g JOIN t ON t.sheet = g.sheet AND t.row BETWEEN r1 - 10 AND r1 + 4) WHERE k = 1""")
def title_rank(spark, sf_dir):
    regions = table(spark, sf_dir, "part").selectExpr("p_partkey % 75 AS sheet", "p_size % 3 AS region", "p_size % 3 * 8 + 4 AS r1").distinct()
    texts = cells(spark, sf_dir).where(FULL).selectExpr("sheet", "row", "value AS text", "border AS bold")
    return X.best_titles(regions, texts)


@query(f"""WITH {SQL_CELLS}, r AS (SELECT sheet, row, 5 + sheet % 7 AS start, avg(CASE WHEN border THEN 1.0 ELSE 0.0 END) AS borders, avg(CASE WHEN {FULL} THEN 1.0 ELSE 0.0 END) AS filled FROM cells GROUP BY sheet, row),
k AS (SELECT a.sheet, a.row, h.h AS height, avg(b.borders) + 0.5 * max(CASE WHEN b.row = a.row THEN b.borders ELSE 0 END) AS s, avg(b.filled) AS f FROM r a, (SELECT unnest([1, 2, 3]) AS h) h, r b WHERE a.row BETWEEN a.start - 2 AND a.start + 2 AND b.sheet = a.sheet AND b.row BETWEEN a.row AND a.row + h.h - 1 GROUP BY a.sheet, a.row, h.h)
SELECT sheet, row AS header_row, height FROM (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY round(s, 9) DESC, round(f, 9) DESC, row, height) AS n FROM k) WHERE n = 1""")
def header_row_argmax(spark, sf_dir):
    rows = cells(spark, sf_dir).groupBy("sheet", "row").agg(F.avg(F.col("border").cast("int")).alias("borders"), F.avg(F.expr(f"CASE WHEN {FULL} THEN 1.0D ELSE 0.0D END")).alias("filled"))
    return X.best_headers(rows.withColumn("start", F.expr("5 + sheet % 7")))


@query(f"""WITH {SQL_CELLS}, v AS (SELECT sheet AS region, col div 3 AS grp, col, value, count(*) AS k FROM cells WHERE {FULL} GROUP BY sheet, col, value), p AS (SELECT region, grp, col, count(*) AS d, max(k) AS top, sum(k) AS n FROM v GROUP BY region, grp, col)
SELECT region, grp, col FROM (SELECT *, row_number() OVER (PARTITION BY region, grp ORDER BY d DESC, round(top / n, 9), n DESC, col) AS r FROM p) WHERE r = 1""")
def column_priority(spark, sf_dir):
    return X.column_priority(cells(spark, sf_dir).selectExpr("sheet AS region", "col div 3 AS grp", "col", "value"))


@query(f"""WITH {SQL_CELLS}, texts AS (SELECT sheet, row, value AS md FROM cells WHERE {FULL} AND col = 0), tables AS (SELECT DISTINCT p_partkey % 75 AS sheet, p_size % 3 * 9 AS row, p_size % 3 * 9 + 3 AS last_row, '|t' || p_size % 3 || '|' AS md FROM part),
images AS (SELECT DISTINCT p_partkey % 75 AS sheet, p_size % 20 AS row, '![](' || p_size % 20 || '.png)' AS md FROM part),
once AS (SELECT sheet, min(row) AS row, md FROM texts t WHERE NOT EXISTS (SELECT 1 FROM tables b WHERE b.sheet = t.sheet AND t.row BETWEEN b.row AND b.last_row) GROUP BY sheet, md)
SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY row, k, md) AS place, md FROM (SELECT sheet, row, 0 AS k, md FROM once UNION ALL SELECT sheet, row, 1, md FROM tables UNION ALL SELECT sheet, row, 2, md FROM images)""")
def row_order_emit(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    texts = cells(spark, sf_dir).where(f"{FULL} AND col = 0").selectExpr("sheet", "row", "value AS md")
    tables = part.selectExpr("p_partkey % 75 AS sheet", "cast(p_size % 3 * 9 AS bigint) AS row", "cast(p_size % 3 * 9 + 3 AS bigint) AS last_row", "'|t' || p_size % 3 || '|' AS md").distinct()
    images = part.selectExpr("p_partkey % 75 AS sheet", "cast(p_size % 20 AS bigint) AS row", "'![](' || p_size % 20 || '.png)' AS md").distinct()
    return X.emit_rows(texts, tables, images)


@query("""WITH s AS (SELECT p_partkey div 50 AS sheet, p_partkey % 50 AS col, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS double) END AS width FROM part)
SELECT sheet, col, round(sum(coalesce(width, 8.43) * 7 * 300 / 96) OVER w - coalesce(width, 8.43) * 7 * 300 / 96, 4) AS left, round(sum(coalesce(width, 8.43) * 7 * 300 / 96) OVER w, 4) AS right FROM s WINDOW w AS (PARTITION BY sheet ORDER BY col ROWS UNBOUNDED PRECEDING)""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def cell_pixel_map(spark, sf_dir):
    return X.pixel_edges(table(spark, sf_dir, "part").selectExpr("p_partkey div 50 AS sheet", "p_partkey % 50 AS col", "CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS double) END AS width"))


@query("""WITH r AS (SELECT l_suppkey AS region, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey * 100 + CAST(l_quantity AS bigint) AS row, [l_returnflag, l_linestatus] AS cells FROM lineitem)
SELECT region, row, cells FROM (SELECT *, lag(cells) OVER (PARTITION BY region ORDER BY row) AS before FROM r) WHERE before IS NULL OR before <> cells""")
def dedupe_emit(spark, sf_dir):
    return X.drop_repeated_rows(table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS region", "l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey * 100 + CAST(l_quantity AS bigint) AS row", "array(l_returnflag, l_linestatus) AS cells"))


@query("""WITH p AS (SELECT year(o_orderdate) AS chart, month(o_orderdate) AS m, o_orderstatus AS s, count(*) AS y FROM orders GROUP BY 1, 2, 3), l AS (SELECT chart, m, '| M' || m || ' | ' || coalesce(CAST(max(y) FILTER (s = 'F') AS varchar), '') || ' | ' || coalesce(CAST(max(y) FILTER (s = 'O') AS varchar), '') || ' | ' || coalesce(CAST(max(y) FILTER (s = 'P') AS varchar), '') || ' |' AS line FROM p GROUP BY chart, m)
SELECT chart, '### Chart: Y' || chart || chr(10) || chr(10) || '| Category | F | O | Series3 |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY m) AS md FROM l GROUP BY chart""")
def chart_standard(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("chart"), F.month("o_orderdate").alias("m"), "o_orderstatus").agg(F.count("*").cast("double").alias("y"))
    points = p.select("chart", F.concat(F.lit("Y"), "chart").alias("title"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'O' END AS series"), F.expr("CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS series_no"), F.col("m").alias("pos"), F.concat(F.lit("M"), "m").alias("category"), "y")
    return C.standard(points)


@query("""WITH p AS (SELECT p_brand AS chart, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS s, p_partkey, p_size AS x, CAST(floor(p_retailprice) AS bigint) AS y FROM part), f AS (SELECT chart, s, x, arg_min(y, p_partkey) AS y FROM p GROUP BY chart, s, x),
n AS (SELECT chart, list_sort(list(DISTINCT s)) AS ns FROM f GROUP BY chart),
l AS (SELECT f.chart, x, '| ' || x || ' | ' || array_to_string(list_transform(any_value(ns), lambda k: coalesce(CAST(list_extract(list(y) FILTER (s = 1), 1) AS varchar), '')), ' | ') AS q, coalesce(CAST(max(y) FILTER (s = 1) AS varchar), '') AS a, coalesce(CAST(max(y) FILTER (s = 2) AS varchar), '') AS b, len(any_value(ns)) AS k, any_value(ns)[1] AS solo FROM f JOIN n USING (chart) GROUP BY f.chart, x)
SELECT chart, '### Chart' || chr(10) || chr(10) || '| X | ' || CASE WHEN any_value(k) = 2 THEN 'even | odd' WHEN any_value(solo) = 1 THEN 'even' ELSE 'odd' END || ' |' || chr(10) || CASE WHEN any_value(k) = 2 THEN '|---|---|---|' ELSE '|---|---|' END || chr(10) || string_agg('| ' || x || ' | ' || CASE WHEN k = 2 THEN a || ' | ' || b WHEN solo = 1 THEN a ELSE b END || ' |', chr(10) ORDER BY x) AS md FROM l GROUP BY chart""".replace("""'| ' || x || ' | ' || array_to_string(list_transform(any_value(ns), lambda k: coalesce(CAST(list_extract(list(y) FILTER (s = 1), 1) AS varchar), '')), ' | ') AS q, """, ""))
def chart_scatter(spark, sf_dir):
    points = table(spark, sf_dir, "part").selectExpr("p_brand AS chart", "CAST(NULL AS string) AS title", "CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS series", "CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS series_no", "p_partkey AS pos", "CAST(p_size AS double) AS x", "CAST(floor(p_retailprice) AS double) AS y")
    return C.scatter(points)


EVENTS = ("user_id AS doc", "event_id AS seq", "CASE event_id % 5 WHEN 0 THEN 'SECTION_END' WHEN 1 THEN 'PARA' WHEN 2 THEN 'CELL' ELSE 'NEWLINE' END AS kind", "CAST(floor(value) AS bigint) % 3 AS rulers")
SQL_EVENTS = f"e AS (SELECT {', '.join(EVENTS)} FROM events), s AS (SELECT *, CAST(coalesce(sum(CASE WHEN kind = 'SECTION_END' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS section FROM e)"


@query(f"WITH {SQL_EVENTS} SELECT doc, seq, kind, rulers, section FROM s")
def event_sections(spark, sf_dir):
    return E.sections(table(spark, sf_dir, "events").selectExpr(*EVENTS))


@query(f"""WITH {SQL_EVENTS}, r AS (SELECT doc, section, section - row_number() OVER (PARTITION BY doc ORDER BY section) AS k FROM (SELECT doc, section FROM s GROUP BY doc, section HAVING bool_or(kind = 'PARA' AND rulers >= 1)))
SELECT doc, section, min(section) OVER (PARTITION BY doc, k) AS "table" FROM r""")
def section_islands(spark, sf_dir):
    return E.table_islands(E.sections(table(spark, sf_dir, "events").selectExpr(*EVENTS)))


PLACED = ("l_suppkey AS tbl", "l_orderkey % 40 AS row", "l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey * 100 + CAST(l_quantity AS bigint) AS seq", "l_partkey % 97 AS start", "l_returnflag AS text", "l_orderkey % 40 = 0 AS head")


@query(f"""WITH c AS (SELECT {', '.join(PLACED)} FROM lineitem), h AS (SELECT tbl, start AS at, row_number() OVER (PARTITION BY tbl ORDER BY start) AS slot FROM (SELECT DISTINCT tbl, start FROM c WHERE head)),
n AS (SELECT c.tbl, c.row, c.seq, c.text, arg_min(slot, abs(at - start) * 1000 + slot) AS slot FROM c JOIN h ON h.tbl = c.tbl GROUP BY c.tbl, c.row, c.seq, c.text)
SELECT tbl, row, slot, string_agg(text, ' ' ORDER BY seq, text) AS text FROM n GROUP BY tbl, row, slot""".replace("SELECT c.tbl, c.row, c.seq, c.text, arg_min", "SELECT c.tbl, c.row, c.seq, c.text, arg_min").replace("AS at,", "AS pos,").replace("abs(at -", "abs(pos -"))
def column_map_nearest(spark, sf_dir):
    return E.place_cells(table(spark, sf_dir, "lineitem").selectExpr(*PLACED))


@query("""WITH r AS (SELECT o_custkey AS tbl, o_orderkey AS row, [CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END] AS cells FROM orders),
l AS (SELECT tbl, list([cells] ORDER BY row) AS rows FROM r GROUP BY tbl),
m AS (SELECT tbl, list_reduce(rows, lambda a, b: CASE WHEN (a[-1][1] <> '' AND b[1][1] <> '') OR (a[-1][2] <> '' AND b[1][2] <> '') THEN list_concat(a, b) ELSE list_concat(a[:-2], [[a[-1][1] || b[1][1], a[-1][2] || b[1][2]]]) END) AS rows FROM l)
SELECT tbl, len(rows) AS n_rows, array_to_string(list_transform(rows, lambda r: r[1] || '|' || r[2]), chr(10)) AS rows FROM m""")
def continuation_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS tbl", "o_orderkey AS row", "array(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END) AS cells")
    merged = E.merge_continuations(rows)
    return merged.select("tbl", F.size("rows").cast("long").alias("n_rows"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


@query("""WITH l AS (SELECT source AS doc, doc_id AS seq, n_chars % 5 * 350 AS font, text FROM documents), c AS (SELECT doc, font, count(*) AS n, min(seq) AS seen FROM l WHERE trim(text) <> '' AND font > 0 GROUP BY doc, font)
SELECT d.doc, coalesce(font, 0) AS body_font FROM (SELECT DISTINCT doc FROM l) d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, seen) AS k FROM c) c ON d.doc = c.doc AND k = 1""")
def body_font_mode(spark, sf_dir):
    return E.body_font(table(spark, sf_dir, "documents").selectExpr("source AS doc", "doc_id AS seq", "n_chars % 5 * 350 AS font", "text"))


@query("""WITH l AS (SELECT source AS doc, doc_id, n_chars % 5 * 350 AS font FROM documents), c AS (SELECT doc, font, count(*) AS n, min(doc_id) AS seen FROM l JOIN documents USING (doc_id) WHERE trim(text) <> '' AND font > 0 GROUP BY doc, font), b AS (SELECT doc, arg_max(font, n * 100000000 - seen) AS body FROM c GROUP BY doc)
SELECT doc_id, CASE WHEN body <= 0 THEN '' WHEN font > body THEN 'heading' WHEN font = 0 THEN 'bold' ELSE '' END AS mark FROM l JOIN b USING (doc)""")
def heading_bold_rule(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("source AS doc", "doc_id AS seq", "n_chars % 5 * 350 AS font", "text")
    body = E.body_font(d).withColumnRenamed("doc", "b")
    return d.join(body, F.col("doc") == F.col("b")).select(F.col("seq").alias("doc_id"), E.heading_or_bold(F.col("font"), F.col("body_font")).alias("mark"))


HEADINGS = "source AS doc, doc_id AS seq, doc_id % 4 + 1 AS level, source || '-' || doc_id AS anchor, lang || ' ' || doc_id AS text"
SQL_NUMBERED = f"""h AS (SELECT {HEADINGS} FROM documents), g AS (SELECT *, sum(CASE WHEN level <= 1 THEN 1 ELSE 0 END) OVER w AS g1, sum(CASE WHEN level <= 2 THEN 1 ELSE 0 END) OVER w AS g2, sum(CASE WHEN level <= 3 THEN 1 ELSE 0 END) OVER w AS g3 FROM h WINDOW w AS (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c1, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, g1 ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c2, sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, g1, g2 ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c3, sum(CASE WHEN level = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, g1, g2, g3 ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c4 FROM g),
n AS (SELECT doc, seq, level, anchor, text, CASE level WHEN 1 THEN '' || c1 WHEN 2 THEN greatest(c1, 1) || '.' || c2 WHEN 3 THEN greatest(c1, 1) || '.' || greatest(c2, 1) || '.' || c3 ELSE greatest(c1, 1) || '.' || greatest(c2, 1) || '.' || greatest(c3, 1) || '.' || c4 END AS number FROM c)"""


def headings(spark, sf_dir):
    return E.chapter_numbers(table(spark, sf_dir, "documents").selectExpr(*HEADINGS.split(", ")))


@query(f"WITH {SQL_NUMBERED} SELECT doc, seq, level, anchor, text, number FROM n")
def chapter_counter(spark, sf_dir):
    return headings(spark, sf_dir)


@query(f"WITH {SQL_NUMBERED}, r AS (SELECT doc, seq, anchor, unnest([number, number || '章', '第' || number || '章', number || '節', '(' || number || ')']) AS ref FROM n) SELECT doc, ref, arg_max(anchor, seq) AS anchor FROM r GROUP BY doc, ref")
def chapter_map_last_wins(spark, sf_dir):
    return E.chapter_map(headings(spark, sf_dir))


@query(f"""WITH {SQL_NUMBERED}, m AS (SELECT doc, number, arg_max(anchor, seq) AS anchor FROM n GROUP BY doc, number)
SELECT d.source AS doc, d.doc_id AS seq, 'see ' || CASE WHEN m.anchor IS NULL THEN '第' || d.doc_id % 7 || '章' ELSE '[第' || d.doc_id % 7 || '章](#' || m.anchor || ')' END || ', 2019年' || text AS text FROM documents d LEFT JOIN m ON m.doc = d.source AND m.number = '' || d.doc_id % 7""")
def chapter_links(spark, sf_dir):
    paragraphs = table(spark, sf_dir, "documents").selectExpr("source AS doc", "doc_id AS seq", "'see 第' || doc_id % 7 || '章, 2019年' || text AS text")
    return E.link_chapters(paragraphs, E.chapter_map(headings(spark, sf_dir)))


@query(f"WITH h AS (SELECT {HEADINGS} FROM documents) SELECT doc, string_agg(repeat('  ', CAST(level - 1 AS int)) || '- [' || text || '](#' || anchor || ')', chr(10) ORDER BY seq) AS toc FROM h GROUP BY doc")
def toc(spark, sf_dir):
    return E.contents(table(spark, sf_dir, "documents").selectExpr("source AS doc", "doc_id AS seq", "cast(doc_id % 4 + 1 AS int) AS level", "source || '-' || doc_id AS anchor", "lang || ' ' || doc_id AS text"))


@query("""SELECT doc_id % 20 AS doc, doc_id AS id, text FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id % 20 = d.doc_id % 20 AND (contains(d.text, b.text) OR contains(b.text, d.text)))""")
def textbox_antijoin(spark, sf_dir):
    boxes = table(spark, sf_dir, "documents").selectExpr("doc_id % 20 AS doc", "doc_id AS id", "text")
    return E.unseen_boxes(boxes, table(spark, sf_dir, "benchmark").selectExpr("item_id % 20 AS doc", "text"))


@query("SELECT source AS doc, doc_id AS id, min(doc_id) OVER (PARTITION BY source, text) AS keep FROM documents")
def image_dedupe(spark, sf_dir):
    return E.first_of_equal(table(spark, sf_dir, "documents").selectExpr("source AS doc", "doc_id AS id", "text AS content"))


SHAPES = ("c_nationkey AS slide", "c_custkey AS id", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 40 END AS top", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 13 END AS pos")


@query(f"""SELECT slide, id, top, pos AS "left", row_number() OVER (PARTITION BY slide ORDER BY top NULLS LAST, pos NULLS LAST, id) AS place FROM (SELECT {', '.join(SHAPES)} FROM customer)""")
def shape_sort(spark, sf_dir):
    return E.shape_order(table(spark, sf_dir, "customer").selectExpr(*SHAPES).withColumnRenamed("pos", "left"))


@query("""WITH s AS (SELECT c_custkey div 10 AS slide, CASE c_custkey % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'chart' WHEN 3 THEN 'auto' ELSE 'picture' END AS kind, c_custkey * 997 % 900000 AS w, c_custkey * 991 % 900000 AS h FROM customer WHERE c_custkey % 3 > 0)
SELECT slide, bool_or(kind IN ('text', 'auto')) AS has_text, bool_or(kind = 'table') AS has_table, bool_or(kind = 'chart') AS has_chart, bool_or(kind IN ('auto', 'picture') AND NOT (w <= 540000 AND h <= 540000)) AS has_shape FROM s GROUP BY slide""".replace(" WHERE c_custkey % 3 > 0", ""))
def slide_flags(spark, sf_dir):
    return E.slide_flags(table(spark, sf_dir, "customer").selectExpr("c_custkey div 10 AS slide", "CASE c_custkey % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'chart' WHEN 3 THEN 'auto' ELSE 'picture' END AS kind", "c_custkey * 997 % 900000 AS w", "c_custkey * 991 % 900000 AS h"))


@query("""WITH s AS (SELECT c_nationkey AS slide, c_custkey AS z, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS text, c_custkey % 97 = 1 AS is_title FROM customer)
SELECT slide, coalesce(CASE WHEN bool_or(is_title) THEN arg_min_null(text, z) FILTER (is_title) END, arg_min(text, z) FILTER (text IS NOT NULL)) AS title FROM s GROUP BY slide""")
def slide_title(spark, sf_dir):
    return E.slide_titles(table(spark, sf_dir, "customer").selectExpr("c_nationkey AS slide", "c_custkey AS z", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS text", "c_custkey % 97 = 1 AS is_title"))


REGIONS = "vec_id % 50 AS page, vec_id AS id, CAST(vec_id * 37 % 500 AS double) AS x, CAST(vec_id * 53 % 700 AS double) AS y, 40.0 AS w, CAST(10 + label % 5 AS double) AS h, label % 2 = 0 AS vertical"


@query(f"""WITH r AS (SELECT {REGIONS} FROM embeddings), p AS (SELECT page, list_sort(list(h))[count(*) // 2 + 1] AS mid, count(*) FILTER (vertical) > count(*) / 2 AS upright FROM r GROUP BY page)
SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN upright THEN -x ELSE floor((y + h / 2) / (0.5 * mid)) END, CASE WHEN upright THEN y ELSE x END, id) AS place FROM r JOIN p USING (page)""")
def ocr_reading_order(spark, sf_dir):
    return E.region_order(table(spark, sf_dir, "embeddings").selectExpr(*REGIONS.split(", ")))
