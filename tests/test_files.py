"""Folders, single files, plug-ins and odd sheets."""

import datetime
import struct
import zipfile

import pytest

from docloom import __main__ as cli
from docloom.plans.source_queries import make_book, make_deck, make_jtd, make_letter, make_stream
from docloom.session import fresh_path, materialise, sweep
from docloom.sources import external, files, jtd, ooxml, sheets


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    put = {"a.xlsx": make_book("n", "1.5", "7"), "sub/b.docx": make_letter("n", "1.5", "7"), "sub/c.PPTX": make_deck("n", "1.5", "7"), "d.jtd": make_stream("n", "1.5", "7"), "bad.docx": b"PK\x03\x04broken", "old.doc": external.OLE + b"x" * 600, "e.png": b"\x89PNG\r\n\x1a\nx", "no.zzz": b"x"}
    for name, content in put.items():
        (tmp_path / "in" / name).write_bytes(content)
    return tmp_path


def test_folder_with_its_folders(spark, folder):
    counts = files.convert(spark, str(folder / "in"), str(folder / "out"), recursive=True).first()
    rows = {r.relative: r for r in spark.read.parquet(str(folder / "out")).collect()}
    assert set(rows) == {"a.md", "sub/b.md", "sub/c.md", "d.md", "bad.md", "old.md", "e.md"}
    assert (counts.success, counts.failed) == (4, 3)
    assert "office suite" in rows["old.md"].error and "reads images" in rows["e.md"].error and rows["bad.md"].error.startswith("BadZipFile")
    flat = files.convert(spark, str(folder / "in"), str(folder / "out2"), text_only=True).first()
    assert flat.success + flat.failed == 5


def test_large_files_get_an_error_row(spark, folder):
    found = files.elements(files.read_files(spark, str(folder / "in"), True, most=700)).where("error like '%too large%'")
    assert {r.path.rsplit("/", 1)[1] for r in found.collect()} >= {"a.xlsx", "b.docx"}


def test_the_filter(spark, folder, capsys):
    assert files.filter_bytes(spark, make_stream("n", "1.5", "7"), "x.jtd").startswith("n様\n\n国7")
    # by its content alone
    assert "high" in files.filter_bytes(spark, make_deck("n", "1.5", "7"))
    assert cli.main(["--filter", str(folder / "in" / "d.jtd"), "--output", str(folder / "text")]) == 0 and "終わり" in (folder / "text").read_text()
    assert cli.main(["--filter", str(folder / "in" / "bad.docx")]) == 1
    assert cli.main([str(folder / "in"), str(folder / "o3"), "--recursive"]) == 1 and "success 4, failed 3" in capsys.readouterr().out


def test_an_engine_for_images(spark, folder):
    before = dict(files.PARSERS)
    try:
        files.ocr(lambda content: f"read {len(content)}\n\nbytes")
        row = files.markdown(files.elements(files.read_files(spark, str(folder / "in")).where("path like '%e.png'"))).first()
    finally:
        files.PARSERS.update(before)
    assert row.md.endswith("### 抽出テキスト（OCR）\n\nread 9\n\nbytes\n") and "![image](images/" in row.md


def test_patterns_of_what_converters_make_up(spark):
    df = spark.createDataFrame([("/x/my.book.xlsx", "# my.book\n\n## S (Sheet Data)\n\n| a | b |\n| --- | --- |\n<details>\n<summary>図形内テキスト</summary>\n\nt\n</details>")], "path string, md string")
    assert df.select(files.text_of_markdown(df.path, df.md, "excel").alias("t")).first().t.split() == ["a", "b", "t"]


def book(rows, merges=(), bold=(), lined=()):
    s = sheets.Sheet(0, "s")
    for r, row in enumerate(rows, 1):
        for c, v in enumerate(row, 1):
            if v is not None or (r, c) in lined:
                s.cells[r, c] = sheets.Cell(v, (r, c) in bold, False, dict.fromkeys(("left", "right", "top", "bottom"), "thin") if (r, c) in lined else {})
    s.merges = list(merges)
    return s.ready()


def tables(s):
    return [x[3] for x in sheets.elements(s) if x[0] == "table"]


def test_odd_sheets():
    assert sheets.elements(book([])) == [] and sheets.elements(book([[None, " "]])) == []
    assert [x[2] for x in sheets.elements(book([["only"]]))] == ["only"]
    # a list of colons and a list of numbers are no tables
    assert tables(book([["a", ":", "1"], ["b", ":", "2"], ["c", "：", "3"]])) == []
    assert tables(book([["1.", "the first of all things"], ["2.", "the second of all things"], ["3.", "the third of all things"]])) == []
    # side by side, two empty columns between: two tables
    wide = [["k", "v", "w", None, None, None, "p", "q", "r"]] + [[f"a{i}", f"b{i}", f"c{i}", None, None, None, f"x{i}", f"y{i}", f"z{i}"] for i in range(3)]
    assert [t[0] for t in tables(book(wide))] == [["k", "v", "w"], ["p", "q", "r"]]
    # three words in most cells of a column are split
    triples = [["n", "what"], ["1", "a is b"], ["2", "c has d"], ["3", "plain"]]
    assert tables(book(triples))[0] == [["n", "what", "Property", "Value"], ["1", "a", "is", "b"], ["2", "c", "has", "d"], ["3", "plain", "", ""]]
    # one wide merged header takes the column with most to say
    s = book([["id", "name", None], ["1", "x", "long one"], ["2", "x", "long two"], ["3", "x", "long three"]], merges=[(1, 1, 2, 3)])
    assert tables(s)[0] == [["id", "name"], ["1", "long one"], ["2", "long two"], ["3", "long three"]]
    # what is in the same place in every row below is data, and no header
    assert sheets.head_text(book([["same", "x"], ["same", "1"], ["same", "2"]]), (1, 3, 1, 2), 1, 1, 1) == ""
    # long text is text
    assert tables(book([["word " * 30, "more " * 30], ["word " * 30, "x " * 60], ["a " * 90, "b " * 70]])) == []
    assert sheets.is_plain(book([["/a/b/c", "/d/e"], ["/f/g", "h"], ["i", "j"]]), (1, 3, 1, 2))
    # many rows in linear time
    many = book([["k", "v", "w"], *([f"a{i}", f"b{i}", "c"] for i in range(30_000))])
    assert len(tables(many)[0]) == 30_001


def test_streams():
    u = lambda *xs: b"".join(x.to_bytes(2, "big") for x in xs)
    assert [jtd.rulers_of(b) for b in (u(0x1C, 0x10, 0xFFFF), u(0x8F, 7, 0x124, 0, 0, 0x1B, 0, 8, 0x46), u(0x8F, 9, 0x124, 0, 0, 0x13, 0, 0x13, 0, 0x13, 0), u(0x8F, 3, 0x124, 0, 0))] == [0, 1, 3, 0]
    assert [jtd.font_of(b) for b in (u(0x1C, 0x10, 0x19, 0, 8, 850, 0x1F), u(0x1C, 0x10, 0x19, 0, 9, 1, 0x1F))] == [850, 0]
    assert jtd.document(make_jtd(["a"])) == [("paragraph", 0, "a", None)] and jtd.document(make_jtd([])) == []
    ticks = int((datetime.datetime(2024, 1, 2, 3, 4, 5) - datetime.datetime(1601, 1, 1)).total_seconds()) * 10_000_000
    values = {2: struct.pack("<II", 30, 6) + "題名".encode("cp932") + b"\0\0", 4: struct.pack("<II", 30, 4) + b"\xff\xfe\xfa\0", 12: struct.pack("<IQ", 64, ticks), 13: struct.pack("<IQ", 64, 0)}
    body, where = b"", []
    for pid, v in values.items():
        where.append((pid, 8 + 8 * len(values) + len(body)))
        body += v
    section = struct.pack("<II", 8 + 8 * len(values) + len(body), len(values)) + b"".join(struct.pack("<II", *w) for w in where) + body
    stream = struct.pack("<HHI16sI16sI", 0xFFFE, 0, 0, b"", 1, b"", 48) + section

    class Fake:
        def names(self):
            return ["\x05SummaryInformation", "\x05DocumentSummaryInformation"]

        def read(self, name):
            return stream

    found = dict(jtd.metadata(Fake()))
    assert found["title"] == "題名" and found["create_time"] == "2024-01-02 03:04:05" and "last_saved_time" not in found and "author" in found


def test_charts_of_a_package():
    (_, title, rows), = ooxml.charts(make_book("n", "1", "7"))
    assert title == "Sums" and rows[0] == ["Category", "Series1", "Series2"] and rows[1] == ["1", "1", "7"]
    assert ooxml.docx_shapes(make_letter("n", "1", "7"))[0][:5] == ("9", "Box", "wsp", 5, 6)


def program(folder, name, body):
    path = folder / name
    path.write_text(f"#!/bin/sh\n{body}\n")
    path.chmod(0o755)


def test_programs_of_the_machine(spark, tmp_path, monkeypatch):
    """Stand-ins for the programs: what they get and what is made of what they leave."""
    put = make_deck("n", "1.5", "7")
    (tmp_path / "new.pptx").write_bytes(put)
    program(tmp_path, "soffice", f'for x; do last=$x; done\ncase "$*" in *"--convert-to pptx"*) cp {tmp_path}/new.pptx "$(dirname "$last")/in.pptx";; *"--convert-to pdf"*) echo %PDF > "$(dirname "$last")/in.pdf";; esac')
    program(tmp_path, "pdftoppm", 'for x; do last=$x; done\nfor k in 1 2 10; do echo "page $k" > "$last-$k.png"; done')
    program(tmp_path, "tesseract", "cat > /dev/null; echo read; echo; echo text")
    monkeypatch.setenv("PATH", f"{tmp_path}:{__import__('os').environ['PATH']}")
    external.office.cache_clear()
    try:
        assert external.modern("powerpoint", external.OLE + b"old") == put and external.modern("powerpoint", b"PK new") == b"PK new"
        assert [x.strip() for x in external.page_images(external.as_pdf("excel", make_book("n", "1", "7")))] == [b"page 1", b"page 2", b"page 10"]
        assert external.tesseract(b"image") == "read\n\ntext"
        with pytest.raises(RuntimeError, match="made no file"):
            external.modern("word", external.OLE + b"old")
        with pytest.raises(ValueError, match="can't be rendered"):
            external.as_pdf("image", b"x")
    finally:
        external.office.cache_clear()


def test_rendering_without_programs_gives_error_rows(spark, folder):
    rows = files.rendered(files.read_files(spark, str(folder / "in"))).collect()
    assert len(rows) == 5 and all(r.error and r.content is None for r in rows)


def test_print_setup():
    before = make_book("n", "1", "7")
    after = ooxml.fit_to_one_page(before)
    a, b = ooxml.Package(before), ooxml.Package(after)
    assert a.names == b.names and [s.cells for s in ooxml.Workbook(before).sheets] == [s.cells for s in ooxml.Workbook(after).sheets]
    sheet = b.xml("xl/worksheets/s1.xml")
    assert [ooxml.tag(x) for x in sheet] == ["sheetPr", "sheetData", "mergeCells", "pageSetup"] and ooxml.child(sheet, "pageSetup").attrib == {"fitToWidth": "1", "fitToHeight": "1"}
    assert ooxml.fit_to_one_page(after) and ooxml.child(sheet, "sheetPr", "pageSetUpPr").get("fitToPage") == "1"


def test_sweep(spark):
    kept = materialise(spark.range(3), "kept")
    from docloom.session import made

    since = len(made(spark))
    gone, last = materialise(spark.range(4), "gone"), materialise(spark.range(5), "last")
    path = made(spark)[since].removeprefix("file:")
    sweep(spark, since, keep=1)
    assert kept.count() == 3 and last.count() == 5 and not __import__("os").path.exists(path) and gone is not None
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_zip_bombs_are_refused():
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", b"<x>" + b"0" * (ooxml.MAX_PART + 1))
    with pytest.raises(ValueError, match="too large"):
        ooxml.Workbook(out.getvalue())
