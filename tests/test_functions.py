"""Literal cases of the scalar functions, the parsers and the fold operators."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.omml import to_latex
from docloom.operators import events as E
from docloom.operators import geometry as G
from docloom.plans.source_queries import OFFICE, make_docx, make_jtd, make_pptx, make_xlsx
from docloom.sources import detect, jtd, ooxml


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(("n", "letters"), [(0, ""), (-3, ""), (1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (256, "IV"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")])
def test_col_letter(spark, n, letters):
    assert one(spark, T.col_letter, n, "int") == letters
    if n > 0:
        assert one(spark, T.col_index, letters) == n


CASES = [
    (T.strip_markdown, "# A\n\n- b\n  * c\n3. d **e** *f*\n| a | b |  |\n|---|:-:|\n---\n----\n![x](y)\nt ![i](j) [k](l)  ", "A\n\nb\n  c\nd e f\na\tb\n----\nt !i k"),
    (T.normalize, "  ス　 ペ\n\nース　 ", "ス ペ ース"),
    (T.normalize, None, ""),
    (T.escape_angles, "a<b>", "a&lt;b&gt;"),
    (T.escape_angles, None, ""),
    (T.anchor_id, "第1章 はじめに!@#", "第1章-はじめに"),
    (T.heading_title, "第1章 システム概要", "システム概要"),
    (T.heading_title, "1.2 システム構成", "システム構成"),
    (T.remove_number, "１．x", "x"),
    (T.remove_number, "(1) x", "x"),
    (T.list_marker, "（１）x", "paren"),
    (T.list_marker, "x", None),
    (T.numbered_bullets, "①a\n１２．b\n前記①c\n１４．０%", "1. a\n12. b\n前記①c\n１４．０%"),
    (T.footnote_ref, "[1][22]", "[^1][^22]"),
    (T.repair_urls, "see http://a.b/c d.pdf) x", "see http://a.b/cd.pdf) x"),
    (T.cell_escape, "a<br/>b <x> & &amp; | <u>c</u>", "a<br>b &lt;x&gt; &amp; &amp; \\| <u>c</u>"),
    (T.cell_content, " a|b\r\n\n\nc&d ", "a\\|b<br><br>c&amp;d"),
    (T.excel_path, "../media/x.png", "xl/media/x.png"),
    (T.sanitize_filename, 'a/b: <c>"d" ', "ab_cd"),
    (T.escape_latex, r"a_b\%", r"a\_b\%"),
    (T.html_table, "no table", "no table"),
]


@pytest.mark.parametrize(("fn", "given", "want"), CASES)
def test_text(spark, fn, given, want):
    assert one(spark, fn, given) == want


@pytest.mark.parametrize(("text", "want"), [("これはテストです", True), ("漢字", True), ("ASCII only", False), ("  ", False), ("ȂȃȄ", False)])
def test_readable_ja(spark, text, want):
    assert one(spark, T.readable_ja, text) is want


@pytest.mark.parametrize(("text", "level"), [("4.1　QRコード", 2), ("4.1.1　ファインダ", 3), ("1　はじめに", 2), ("第1条（借入要項）本文", 3), ("図 1 x", 0), ("5　個の例", 0), ("1　これは文である", 0), ("１．金利", 3)])
def test_numbered_heading(spark, text, level):
    assert one(spark, lambda t: T.numbered_heading(t)["level"], text) == level


def test_collapse_repeats(spark):
    assert one(spark, T.collapse_repeats, ["A", "B", "A", "B"], "array<string>") == ["A", "B"]
    assert one(spark, T.collapse_repeats, ["A", "B", "A"], "array<string>") == ["A", "B", "A"]
    assert one(spark, T.collapse_repeats, [], "array<string>") == []


def test_u16be(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\x1c\x30\x42"),)], "b binary")
    assert list(df.select(*[T.u16be(F.col("b"), F.lit(i)) for i in (0, 2, 3, -1)]).first()) == [0x1C, 0x3042, -1, -1]


def test_continuation_rows(spark):
    rows = [(1, 0, ["行1", ""]), (1, 1, ["", "継続"]), (2, 0, ["a", "b"]), (2, 1, ["c", "d"])]
    got = {r.tbl: r.rows for r in E.merge_continuations(spark.createDataFrame(rows, "tbl int, row int, cells array<string>")).collect()}
    assert got == {1: [["行1", "継続"]], 2: [["a", "b"], ["c", "d"]]}


@pytest.mark.parametrize(("font", "body", "mark"), [(1200, 700, "heading"), (0, 700, "bold"), (700, 700, ""), (1200, 0, ""), (500, 700, "")])
def test_heading_or_bold(spark, font, body, mark):
    assert spark.range(1).select(E.heading_or_bold(F.lit(font), F.lit(body)).alias("r")).first()["r"] == mark


def test_nms_against_brute_force(spark):
    import random

    random.seed(4)
    rows = [(i % 3, i, (x := random.random() * 50), (y := random.random() * 50), x + 20.0, y + 20.0, random.random()) for i in range(90)]

    def iou(a, b):
        both = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return both / (800 - both)

    want = set()
    for g in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: -r[6]):
            if all(iou(r, k) <= 0.35 for k in kept):
                kept.append(r)
        want |= {(g, r[1]) for r in kept}
    got = G.nms(spark.createDataFrame(rows, "grp int, id int, x0 double, y0 double, x1 double, y1 double, score double"))
    assert {(r.grp, r.id) for r in got.collect()} == want


def test_parsers():
    assert [c[2:5] for c in ooxml.xlsx_cells(make_xlsx([["a", "b"], ["1", "<"]]))] == [(1, 1, "a"), (1, 2, "b"), (2, 1, "1"), (2, 2, "<")]
    assert [e[1:] for e in ooxml.docx_elements(make_docx("T", "x", [["1"]]))] == [("heading", 1, "T", None), ("paragraph", 0, "x", None), ("table", 0, None, [["1"]])]
    assert [e[2:5] for e in ooxml.pptx_elements(make_pptx("T", "x"))] == [("title", 2, "T"), ("text", 0, "x"), ("rule", 0, None)]
    assert jtd.lines(make_jtd(["日本", " ", "𠮷"])) == ["日本", "𠮷"]
    assert jtd.lines(b"short") == [] and jtd.content_start(b"x" * 64) == -1


def test_zip_kinds():
    assert detect.zip_kind(make_xlsx([["a"]])) == "excel" and detect.zip_kind(make_docx("a", "b", [])) == "word" and detect.zip_kind(make_pptx("a", "b")) == "powerpoint"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.txt", "y")
    assert detect.zip_kind(out.getvalue()) == "unknown" and detect.zip_kind(b"PK\x03\x04") == "unknown"


def compound(name: str, body: bytes) -> bytes:
    """A compound file of one stream, of 512-byte sectors."""
    body = body.ljust(4096, b"\0")
    n = len(body) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, n + 2), 0xFFFFFFFE]
    entry = lambda s, kind, start, size: (s.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HB", 2 * len(s) + 2, kind) + b"\0" * 49 + struct.pack("<IQ", start, size)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<9I", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))) + (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry(name, 2, 2, len(body))).ljust(512, b"\0") + body


def test_compound_files():
    from docloom.sources.ole import CompoundFile

    data = compound("DocumentText", make_jtd(["日本語"]))
    assert CompoundFile(data).names() == ["DocumentText"]
    assert jtd.lines(jtd.stream_of(data)) == ["日本語"]
    assert detect.ole_kind(compound("WordDocument", b"")) == "word" and detect.ole_kind(b"no") == "unknown"


M = f"{OFFICE}/officeDocument/2006/math"


@pytest.mark.parametrize(
    ("xml", "want"),
    [
        ("<m:sSub><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sub><m:r><m:t>1</m:t></m:r></m:sub></m:sSub>", "x_{1}"),
        ('<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub><m:r><m:t>i</m:t></m:r></m:sub><m:sup/><m:e><m:r><m:t>x</m:t></m:r></m:e></m:nary>', r"\sum_{i}{x}"),
        ("<m:d><m:e><m:r><m:t>a</m:t></m:r></m:e></m:d>", r"\left(a\right)"),
        ("<m:m><m:mr><m:e><m:r><m:t>a</m:t></m:r></m:e><m:e><m:r><m:t>b</m:t></m:r></m:e></m:mr></m:m>", r"\begin{matrix}a & b\end{matrix}"),
    ],
)
def test_omml(xml, want):
    assert to_latex(f'<m:oMath xmlns:m="{M}">{xml}</m:oMath>') == want


def test_folder_and_stream(spark, tmp_path):
    from docloom.sources.files import convert
    from docloom.streaming.files import stream_markdown

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.docx").write_bytes(make_docx("T", "x", [["1"]]))
    (src / "b.XLSX").write_bytes(make_xlsx([["k", "v"], ["1", "2"]]))
    (src / "bad.docx").write_bytes(b"PK\x03\x04nothing")
    (src / "skip.txt").write_text("no")
    r = convert(spark, str(src), str(tmp_path / "out")).first()
    assert (r.success, r.failed) == (2, 1)
    q = stream_markdown(spark, str(src), str(tmp_path / "s"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    batch = {x.path: (x.md, x.error) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {x.path: (x.md, x.error) for x in spark.read.parquet(str(tmp_path / "s")).collect()} == batch
