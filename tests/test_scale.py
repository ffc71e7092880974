"""Cases that only larger tables have: ids on several rows, ties, long maps, few rows of much work."""

import re
import sys
from itertools import permutations

import pytest
from compare import same
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import events as E
from docloom.operators import layout as L
from docloom.operators import regions as R
from docloom.plans import catalogue
from docloom.plans.source_queries import make_book, make_deck, make_pdf
from docloom.session import by_key
from docloom.sources import ooxml, pdf

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"


def parts_of(df):
    """Parts of the last exchange of a run."""
    return df.rdd.getNumPartitions()


@pytest.fixture
def against(spark, tmp_path):
    """Holds a query against its SQL on rows of one table, or gives its result where `sql` is off."""

    def run(name, table, rows, schema, sql=True):
        import duckdb

        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        if not sql:
            return got
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        same(got, con, catalogue.ORACLES[name])

    return run


# the first two boxes have one id but other places; the third covers the first alone
TWICE = [(1, 1, 5, 0, 1.0, "A"), (1, 1, 5, 50, 1.0, "A"), (1, 2, 5, 0, 9.0, "A")]


@pytest.mark.parametrize("name", ["region_deoverlap", "contained_removal"])
def test_boxes_of_one_id_are_dropped_by_their_places(against, name):
    against(name, "lineitem", TWICE, LINE)


def test_components_have_an_id_once(against):
    # the second place of id 1 reaches a box that the first doesn't
    against("figure_components", "lineitem", [(1, 1, 5, 0, 1.0, "A"), (1, 1, 5, 50, 1.0, "A"), (1, 2, 5, 55, 9.0, "A"), (1, 3, 350, 0, 1.0, "A")], LINE)


def test_lines_of_equal_place_and_id_have_one_order(spark):
    # of the first two the one that ends farther right is read last; whether the third is apart hangs on that
    lines = [(1, 243.0, 260.0, 18.0, 9.0, "R1"), (1, 243.0, 290.0, 18.0, 9.0, "N1"), (5, 302.0, 344.0, 18.0, 8.0, "R5")]
    rows = [(page, *x) for page, order in enumerate(permutations(lines)) for x in order]
    got = L.same_line(spark.createDataFrame(rows, "page int, id int, x0 double, x1 double, y double, size double, text string").coalesce(1)).collect()
    assert {r.text for r in got} == {"N1 R1 R5"}
    assert len(got) == 6


def test_column_letters_past_four(spark):
    def letters(n):
        found = ""
        while n > 0:
            n, k = divmod(n - 1, 26)
            found = chr(65 + k) + found
        return found

    numbers = [1, 18278, 18279, 475253, 475254, 475255, 1_000_000, 1_199_999, 12_356_630, 12_356_631]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", T.col_letter(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == {n: letters(n) for n in numbers}


def test_references_meet_the_map_one_by_one(spark):
    paragraphs = spark.createDataFrame([("a", 1, "第1章と第1章と3節, 2019年"), ("a", None, "2章"), ("a", 1, "第9章と2章"), ("b", 1, "第1章"), ("a", 3, None), (None, 4, "第1章")], "doc string, seq int, text string")
    mapping = spark.createDataFrame([("a", "第1章", "one"), ("a", "2章", "two"), ("a", "3節", None), ("c", "第9章", "nine")], "doc string, ref string, anchor string")
    got = E.link_chapters(paragraphs, mapping)
    want = {("a", 1, "[第1章](#one)と[第1章](#one)と3節, 2019年"), ("a", None, "[2章](#two)"), ("a", 1, "第9章と[2章](#two)"), ("b", 1, "第1章"), ("a", 3, None), (None, 4, "第1章")}
    assert {tuple(r) for r in got.collect()} == want
    # no row gathers all that a document's map has
    assert not re.search(r"Aggregate \[doc#\d+\]", got._jdf.queryExecution().optimizedPlan().toString())


MANY = [(p, 1 + k % 7, p * 31 % 500 + k, p * 17 % 90 + k, 1.0 + (p + k) % 50, "A") for p in range(2000) for k in range(4)]


@pytest.mark.parametrize(("name", "module"), [("ruled_table_merge", R), ("reading_order", L)])
def test_pages_are_dealt_by_the_size_of_files(against, monkeypatch, name, module):
    dealt = []
    monkeypatch.setattr(module, "by_key", lambda df, *keys: dealt.append(keys) or by_key(df, *keys, most=2048))
    against(name, "lineitem", MANY, LINE)
    assert dealt == [("page",)]


def test_parts_grow_with_the_files(spark, tmp_path):
    for name, n in (("one", 1), ("eight", 8)):
        spark.range(20000 * n).selectExpr("id div 4 AS page", "rand(1) AS x").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    one, eight = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("one", "eight"))
    assert 7 <= parts_of(by_key(eight, "page", most=10_000)) / parts_of(by_key(one, "page", most=10_000)) <= 9
    # a frame that isn't files, or a small one, is left to Spark
    assert parts_of(by_key(spark.createDataFrame([(1,)], "page int"), "page")) <= 4 and parts_of(by_key(one, "page")) <= 4


@pytest.mark.parametrize("name", ["xlsx_to_markdown", "pptx_to_text", "drawing_shapes", "pdf_to_markdown"])
def test_files_of_a_small_table_are_parsed_on_all_cores(spark, tmp_path, name):
    spark.createDataFrame([(k, f"Supplier#{k}", k % 25, k / 4) for k in range(200)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    # rows are dealt out below the first function that works on a file
    below = plan[max(plan.rindex("MapInArrow"), plan.rindex("ArrowEvalPython")) :]
    assert (found := re.search(r"hashpartitioning\(a#\d+, (\d+)\), REPARTITION_BY_NUM", below)) and int(found[1]) >= 4 * spark.sparkContext.defaultParallelism


def test_fonts_share_one_table_of_codes():
    doc = pdf.Document(make_pdf("a", ["b"]))
    own = pdf.Font(doc, {"Encoding": {"Differences": [65, pdf.Name("z")]}})
    plain, mac = pdf.Font(doc, {}), pdf.Font(doc, {"Encoding": pdf.Name("MacRomanEncoding")})
    # worked out once, and not touched by a font's own characters
    assert pdf._codes("cp1252") is pdf._codes("cp1252")
    assert [f.chars[65] for f in (own, plain, mac)] == ["z", "A", "A"] and [f.chars[0xC4] for f in (own, plain, mac)] == ["Ä", "Ä", "ƒ"]
    assert plain.chars == {c: bytes([c]).decode("cp1252", "ignore") for c in range(32, 256)}


def calls_of(name, run):
    """How often functions of this name, Python's own ones too, are called in a run."""
    found = []
    sys.setprofile(lambda frame, event, arg: found.append(frame.f_code.co_name if event == "call" else getattr(arg, "__name__", "")) if event in ("call", "c_call") else None)
    try:
        run()
    finally:
        sys.setprofile(None)
    return found.count(name)


def test_names_of_xml_are_cut_once(monkeypatch):
    deck, other = make_deck("a", "1", "7"), make_deck("b", "2.5", "8")
    want = ooxml.pptx_elements(deck)
    # a worker's first file brings the names, the others have the same ones
    assert calls_of("rpartition", lambda: ooxml.pptx_elements(other)) == 0
    # names in full aren't held without end
    monkeypatch.setattr(ooxml._Local, "MOST", 3)
    monkeypatch.setattr(ooxml, "LOCAL", ooxml._Local())
    assert ooxml.pptx_elements(deck) == want and len(ooxml.LOCAL) <= 3


def test_of_attributes_with_one_local_name_the_first_counts():
    root = ooxml.ET.fromstring('<a xmlns:z="q" xmlns:y="p"><z:b z:r="1" r="2"/><!-- c --><y:b r="3" y:r="4"/></a>')
    assert [ooxml.attr(x, "r") for x in ooxml.under(root, "b")] == ["1", "3"]
    assert ooxml.first_under(root, "b") is ooxml.child(root, "b") is root[0] and ooxml.first_under(root, "c") is ooxml.child(root, "b", "c") is None


def test_places_of_cells_are_read_once():
    book, other = make_book("a", "1", "7"), make_book("b", "2.5", "8")
    ooxml.xlsx_anchors(book)
    assert calls_of("fullmatch", lambda: ooxml.xlsx_anchors(other)) == 0
    # a place that is none isn't kept, and raises each time
    for _ in range(2):
        with pytest.raises(AttributeError):
            ooxml._reference("7B")


def test_cells_of_one_format_share_it_and_others_dont():
    cells = {x[2:4]: x[4:] for x in ooxml.xlsx_cells(make_book("a", "1", "7")) if x[0] == 0}
    assert [cells[k][1:] for k in ((2, 2), (4, 2), (6, 2), (10, 2))] == [(True, False), (True, True), (False, True), (False, False)]
    assert [cells[k][0] for k in ((6, 2), (8, 2), (8, 4))] == ["a", "7", None]
