"""Queries of the layout and geometry operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import furniture, list_marker
from docloom.operators import geometry as G
from docloom.operators import layout as L
from docloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def lineitem(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*columns)


@query("""SELECT l_orderkey AS doc, avg(CASE WHEN 600 + 40 * l_linenumber > 700 + l_quantity THEN 1.0 ELSE 0.0 END) >= 0.9 AND (count(*) < 2 OR (var_pop(600.0 + 40 * l_linenumber) <= 100 AND var_pop(700.0 + l_quantity) <= 100)) AS is_slide FROM lineitem GROUP BY 1""")
def slide_document_test(spark, sf_dir):
    return L.slide_documents(lineitem(spark, sf_dir, "l_orderkey AS doc", "600.0D + 40 * l_linenumber AS w", "700.0D + l_quantity AS h"))


@query("""SELECT l_suppkey AS doc, l_partkey % 50 AS xref, count(DISTINCT l_orderkey) AS n_pages FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 5 AND bool_and(l_linenumber * 12 < 70 AND l_quantity / 4000.0 < 0.02)""")
def repeated_images(spark, sf_dir):
    return L.repeated_images(lineitem(spark, sf_dir, "l_suppkey AS doc", "l_partkey % 50 AS xref", "l_orderkey AS page", "l_linenumber * 12 AS y", "l_quantity / 4000.0D AS share"))


@query("""SELECT doc, norm, count(DISTINCT page) AS n_pages FROM (SELECT source AS doc, doc_id AS page, regexp_replace(regexp_replace(trim(x, chr(9) || chr(13) || ' '), '[0-9]+', '<NUM>', 'g'), '\\s+', ' ', 'g') AS norm
 FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)) GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2""".replace("\\\\", "\\"))
def header_footer_patterns(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n", -1)).alias("x"))
    return L.furniture_patterns(d.select("doc", "page", furniture(F.col("x")).alias("norm")))


@query("""WITH p AS (SELECT l_suppkey AS doc, l_orderkey AS page, max(l_linenumber * 5.0) + 15 AS h, min(700.0 + l_quantity) - 15 AS f FROM lineitem GROUP BY 1, 2)
SELECT doc, list_sort(list(h))[count(*) // 2 + 1] AS header, list_sort(list(f))[count(*) // 2 + 1] AS footer FROM p GROUP BY 1""")
def header_footer_bands(spark, sf_dir):
    return L.furniture_bands(lineitem(spark, sf_dir, "l_suppkey AS doc", "l_orderkey AS page", "l_linenumber * 5.0D AS header_y", "700.0D + l_quantity AS footer_y"))


@query("""SELECT l_suppkey AS page, CASE WHEN count(*) FILTER (w > 60) >= 5 AND count(*) FILTER (w > 60 AND x < 180) >= 3 AND count(*) FILTER (w > 60 AND x > 240) >= 3 THEN 2 ELSE 1 END AS n_columns FROM (SELECT l_suppkey, CAST(l_partkey % 600 AS double) AS x, l_quantity * 8.0 AS w FROM lineitem) GROUP BY 1""")
def column_layout(spark, sf_dir):
    return L.column_layout(lineitem(spark, sf_dir, "l_suppkey AS page", "CAST(l_partkey % 600 AS double) AS x", "l_quantity * 8.0D AS w"))


LINES = ("l_orderkey AS page", "l_linenumber AS id", "CAST(l_partkey % 600 AS double) AS x", "CAST(l_suppkey % 80 * 10 AS double) AS y", "CASE WHEN l_quantity > 40 THEN 'full' WHEN l_partkey % 600 < 300 THEN 'left' ELSE 'right' END AS kind")


@query(f"""WITH l AS (SELECT {', '.join(LINES)} FROM lineitem), b AS (SELECT *, CAST(sum(CASE WHEN kind = 'full' THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, x, id, kind ROWS UNBOUNDED PRECEDING) AS bigint) AS band FROM l)
SELECT page, id, x, y, kind, band, row_number() OVER (PARTITION BY page ORDER BY band, CASE kind WHEN 'full' THEN 0 WHEN 'left' THEN 1 ELSE 2 END, y, x, id) AS place FROM b""")
def reading_order(spark, sf_dir):
    return L.reading_order(lineitem(spark, sf_dir, *LINES))


SPANS = ("l_orderkey AS page", "l_linenumber AS id", "CAST(l_partkey % 500 AS double) AS x0", "CAST(l_partkey % 500 AS double) + l_quantity AS x1", "CAST(l_suppkey % 20 * 3 AS double) AS y", "CAST(8 + l_linenumber % 5 AS double) AS size", "l_returnflag || l_linenumber AS text")


@query(f"""WITH l AS (SELECT {', '.join(SPANS)} FROM lineitem),
r AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, x0, id ROWS UNBOUNDED PRECEDING) AS row FROM (SELECT *, coalesce(y - lag(y) OVER d > 0.5 * least(size, lag(size) OVER d), true) AS fresh FROM l WINDOW d AS (PARTITION BY page ORDER BY y, x0, id))),
p AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY page, row ORDER BY x0, id ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY page, row ORDER BY x0, id) > 1.5 * size, true) AS apart FROM r))
SELECT page, CAST(row AS bigint) AS row, CAST(part AS bigint) AS part, string_agg(text, ' ' ORDER BY x0, id, text) AS text FROM p GROUP BY page, row, part""")
def same_y_merge(spark, sf_dir):
    return L.same_line(lineitem(spark, sf_dir, *SPANS))


FLOW = "doc_id AS doc, seq, seq * 9.0 + CASE WHEN seq % 5 = 0 THEN 8 ELSE 0 END AS y, 10.0 + CASE WHEN seq % 7 = 0 THEN 4 ELSE 0 END AS size, seq % 4 = 3 AS bold, seq // 6 AS col, x AS text"


@query(r"""WITH l AS (SELECT doc_id AS doc, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS int) AS seq, unnest(string_split(text, chr(10))) AS text FROM documents),
v AS (SELECT *, seq * 9.0 + 8.0 * (seq // 5) AS y, 10.0 + CASE WHEN seq % 7 = 0 THEN 4 ELSE 0 END AS size, (seq // 3) % 2 = 1 AS bold, seq // 6 AS col, regexp_matches(text, '^[0-9]') AS marker FROM l),
f AS (SELECT *, coalesce(y - lag(y) OVER w > 9.6 OR col <> lag(col) OVER w OR bold <> lag(bold) OVER w OR abs(size - lag(size) OVER w) > 1 OR marker, true) AS fresh FROM v WINDOW w AS (PARTITION BY doc ORDER BY seq)),
b AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING) AS block FROM f)
SELECT doc, CAST(block AS bigint) AS block, list_reduce(list_prepend('', list(text ORDER BY seq)), lambda p, q: CASE WHEN p = '' THEN q WHEN regexp_matches(p, '[A-Za-z0-9.,;:!?)]$') AND regexp_matches(q, '^[A-Za-z0-9(]') THEN p || ' ' || q ELSE p || q END) AS text FROM b GROUP BY doc, block""")
def paragraph_reflow(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))
    return L.reflow(d.selectExpr("*", "seq * 9.0D + 8.0D * (seq div 5) AS y", "10.0D + CASE WHEN seq % 7 = 0 THEN 4 ELSE 0 END AS size", "(seq div 3) % 2 = 1 AS bold", "seq div 6 AS col", "text rlike '^[0-9]' AS marker"))


MARK = "CASE event_id % 6 WHEN 0 THEN 'arabic' WHEN 1 THEN 'circled' WHEN 2 THEN 'paren' WHEN 3 THEN 'bullet' WHEN 4 THEN 'circled' END"


@query(f"""WITH e AS (SELECT user_id AS doc, event_id AS seq, {MARK} AS marker FROM events), r AS (SELECT *, sum(CASE WHEN marker IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT doc, seq, marker, CASE WHEN marker IS NULL THEN NULL WHEN marker IN ('circled', 'paren') AND coalesce(max(CASE WHEN marker IN ('arabic', 'fullwidth') THEN 1 ELSE 0 END) OVER (PARTITION BY doc, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 1 ELSE 0 END AS level FROM r""")
def list_levels(spark, sf_dir):
    return L.list_levels(table(spark, sf_dir, "events").selectExpr("user_id AS doc", "event_id AS seq", f"{MARK} AS marker"))


CELLED = ("l_suppkey AS page", "CAST(l_partkey % 12 * (10 + l_suppkey % 60) AS double) AS y", "CAST(l_orderkey % 30 * 7 AS double) AS x", "CASE WHEN l_partkey % 5 = 0 THEN l_returnflag ELSE l_returnflag || l_shipdate END AS text")


@query(f"""WITH c AS (SELECT page, round_even(y / 5, 0) * 5 AS y, round_even(x / 20, 0) * 20 AS x, length(text) AS n FROM (SELECT {', '.join(CELLED)} FROM lineitem WHERE l_linenumber % 2 = 1)),
r AS (SELECT page, y FROM c GROUP BY page, y HAVING count(DISTINCT x) >= 3 AND max(n) > 3),
t AS (SELECT page, y, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y ROWS UNBOUNDED PRECEDING) AS t FROM (SELECT page, y, coalesce(y - lag(y) OVER (PARTITION BY page ORDER BY y) >= 50, true) AS fresh FROM r))
SELECT page, min(y) AS top, max(y) AS bottom, count(*) AS n_rows FROM t GROUP BY page, t HAVING count(*) >= 2""".replace(" WHERE l_linenumber % 2 = 1", ""))
def text_tables(spark, sf_dir):
    return L.text_tables(lineitem(spark, sf_dir, *CELLED))


@query(r"""WITH p AS (SELECT conv_id AS doc, turn AS page, text, regexp_extract(text, '^([^\n]*)', 1) AS first, regexp_extract(lag(text) OVER w, '([^\n]*)$', 1) AS prior, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT doc, page, CASE WHEN n = 1 THEN '' WHEN prior IS NULL OR regexp_matches(prior, '[.!?。．！？」）)]\s*$') OR prior = '' OR regexp_matches(first, '^(?:#|[-*+] |\d+\. |\||>|$)') THEN chr(10) || chr(10) WHEN regexp_matches(prior, '[A-Za-z0-9]$') AND regexp_matches(first, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || text AS part FROM p)
SELECT doc, regexp_replace(string_agg(part, '' ORDER BY page), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM g GROUP BY doc""")
def page_break_merge(spark, sf_dir):
    return L.join_pages(table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc", "turn AS page", "text"))


@query("""WITH c AS (SELECT l_orderkey AS page, l_linenumber AS cid, CAST(l_partkey % 300 AS double) AS x0, CAST(l_partkey % 300 + 100 AS double) AS x1, CAST(l_suppkey % 60 * 10 AS double) AS y FROM lineitem WHERE l_returnflag = 'N'),
b AS (SELECT l_orderkey AS page, l_linenumber AS bid, CAST(l_partkey % 250 AS double) AS x0, CAST(l_partkey % 250 + 120 AS double) AS x1, CAST(l_suppkey % 40 * 15 AS double) AS y0, CAST(l_suppkey % 40 * 15 + 80 AS double) AS y1 FROM lineitem WHERE l_returnflag <> 'N'),
n AS (SELECT c.page, cid, bid, least(abs(y - y1), abs(y0 - y)) AS d FROM c JOIN b ON c.page = b.page WHERE least(c.x1, b.x1) - greatest(c.x0, b.x0) >= 20)
SELECT page, cid, bid FROM (SELECT *, row_number() OVER (PARTITION BY page, cid ORDER BY d, bid) AS k FROM n WHERE d < 50) WHERE k = 1""")
def caption_pairing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    captions = rows.where("l_returnflag = 'N'").selectExpr("l_orderkey AS page", "l_linenumber AS cid", "CAST(l_partkey % 300 AS double) AS x0", "CAST(l_partkey % 300 + 100 AS double) AS x1", "CAST(l_suppkey % 60 * 10 AS double) AS y")
    boxes = rows.where("l_returnflag <> 'N'").selectExpr("l_orderkey AS page", "l_linenumber AS bid", "CAST(l_partkey % 250 AS double) AS x0", "CAST(l_partkey % 250 + 120 AS double) AS x1", "CAST(l_suppkey % 40 * 15 AS double) AS y0", "CAST(l_suppkey % 40 * 15 + 80 AS double) AS y1")
    return L.pair_captions(captions, boxes)


BOX = ("l_orderkey AS grp", "CAST(l_linenumber * 100000000 + l_partkey * 100 + l_quantity AS bigint) AS id", "CAST(l_partkey % 400 AS double) AS x0", "CAST(l_suppkey % 97 * 6 AS double) AS y0", "CAST(l_partkey % 400 + 20 + 5 * l_quantity AS double) AS x1", "CAST(l_suppkey % 97 * 6 + 30 + 3 * l_quantity AS double) AS y1")
SQL_BOX = f"boxes AS (SELECT {', '.join(BOX)} FROM lineitem)"
OVERLAP = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
INSIDE = "{1}.x0 >= {0}.x0 - 10 AND {1}.y0 >= {0}.y0 - 10 AND {1}.x1 <= {0}.x1 + 10 AND {1}.y1 <= {0}.y1 + 10"
LARGER = f"({AREA.format('b')} > {AREA.format('a')} OR ({AREA.format('b')} = {AREA.format('a')} AND b.id < a.id))"


@query(f"""WITH {SQL_BOX} SELECT a.grp, a.id, b.id AS other, round({OVERLAP} / least({AREA.format('a')}, {AREA.format('b')}), 6) AS share,
 round(greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0), 6) AS share_x, round(greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0), 6) AS share_y,
 ({INSIDE.format('a', 'b')}) OR ({INSIDE.format('b', 'a')}) AS nested FROM boxes a JOIN boxes b ON a.grp = b.grp AND a.id < b.id AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 10 AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 10""")
def box_geometry(spark, sf_dir):
    return G.measures(lineitem(spark, sf_dir, *BOX))


@query(f"WITH {SQL_BOX} SELECT * FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE a.grp = b.grp AND a.id <> b.id AND {INSIDE.format('b', 'a')} AND {LARGER})")
def contained_removal(spark, sf_dir):
    return G.drop_contained(lineitem(spark, sf_dir, *BOX))


@query(f"WITH {SQL_BOX} SELECT * FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE a.grp = b.grp AND a.id <> b.id AND {OVERLAP} > 0 AND {OVERLAP} >= 0.5 * least({AREA.format('a')}, {AREA.format('b')}) AND {LARGER})")
def region_deoverlap(spark, sf_dir):
    return G.drop_overlapping(lineitem(spark, sf_dir, *BOX))


@query(f"""WITH RECURSIVE {SQL_BOX}, e AS (SELECT a.grp, a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.grp = b.grp AND a.id <> b.id WHERE greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 100 AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 40),
r AS (SELECT grp, id, id AS reached FROM boxes UNION SELECT r.grp, r.id, e.b FROM r JOIN e ON r.grp = e.grp AND r.reached = e.a)
SELECT grp, id, min(reached) AS root FROM r GROUP BY grp, id""")
def figure_components(spark, sf_dir):
    boxes = lineitem(spark, sf_dir, *BOX)
    return G.components(boxes, G.near_edges(boxes))


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS k FROM (SELECT {', '.join(BOX)}, l_extendedprice AS score FROM lineitem)),
r AS (SELECT DISTINCT grp, CAST(0 AS bigint) AS k, CAST([] AS struct(id bigint, x0 double, y0 double, x1 double, y1 double, score double)[]) AS kept FROM o
 UNION ALL SELECT r.grp, o.k, CASE WHEN len(list_filter(r.kept, lambda q: greatest(0, least(o.x1, q.x1) - greatest(o.x0, q.x0)) * greatest(0, least(o.y1, q.y1) - greatest(o.y0, q.y0))
  > 0.35 * ((o.x1 - o.x0) * (o.y1 - o.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) - greatest(0, least(o.x1, q.x1) - greatest(o.x0, q.x0)) * greatest(0, least(o.y1, q.y1) - greatest(o.y0, q.y0)) + 1e-9))) = 0
  THEN list_append(r.kept, {{'id': CAST(o.id AS bigint), 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'score': o.score}}) ELSE r.kept END FROM r JOIN o ON o.grp = r.grp AND o.k = r.k + 1),
l AS (SELECT grp, arg_max(kept, k) AS kept FROM r GROUP BY grp) SELECT grp, q.id AS id, q.x0 AS x0, q.y0 AS y0, q.x1 AS x1, q.y1 AS y1, q.score AS score FROM (SELECT grp, unnest(kept) AS q FROM l)""")
def nms(spark, sf_dir):
    return G.nms(lineitem(spark, sf_dir, *BOX, "l_extendedprice AS score"))
