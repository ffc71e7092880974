"""Queries of type detection and of the parsers; the files are built from table values."""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docloom.session import over_all, ship, table
from docloom.sources import detect as D
from docloom.sources import files as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ENDS = ["xlsx", "XLS", "docx", "doc", "pptx", "Ppt", "pdf", "jtd", "JTT", "jpg", "jpeg", "PNG", "gif", "bmp", "tiff", "webp", "txt", "tar.gz"]
HEADS = ["255044462D312E37", "D0CF11E0A1B11AE1", "504B030414000600", "89504E470D0A1A0A", "FFD8FFE0", "4749463839", "424D3626", "524946460000000057454250", "524946460000000057415645", "49492A00", "4D4D002A", "4949002A", "255044", "68656C6C6F", "00000000", "89504E470D0A1A", "", "4D4D2A00"]


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def _pick(values: list[str]) -> str:
    return "CASE page_id % 18 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


PATH = f"'/a.b/' || page_id || '.' || ({_pick(ENDS)})"
SUFFIX_SQL = "CASE WHEN regexp_matches(lower(p), '\\.(xlsx?)$') THEN 'excel' WHEN regexp_matches(lower(p), '\\.docx?$') THEN 'word' WHEN regexp_matches(lower(p), '\\.pptx?$') THEN 'powerpoint' WHEN lower(p) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(p), '\\.(jtd|jtt)$') THEN 'ichitaro' WHEN regexp_matches(lower(p), '\\.(jpe?g|png|gif|bmp|tiff?|webp)$') THEN 'image' ELSE 'unknown' END"
BYTES_SQL = "CASE WHEN length(h) < 8 THEN 'unknown' WHEN starts_with(h, '25504446') THEN 'pdf' WHEN starts_with(h, 'D0CF11E0') THEN 'ole' WHEN starts_with(h, '504B0304') THEN 'zip' WHEN starts_with(h, '89504E470D0A1A0A') OR starts_with(h, 'FFD8') OR starts_with(h, '47494638') OR starts_with(h, '424D') OR starts_with(h, '49492A00') OR starts_with(h, '4D4D002A') OR (starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250') THEN 'image' ELSE 'unknown' END"


@query(f"SELECT page_id, p AS path, {SUFFIX_SQL} AS file_type FROM (SELECT page_id, {PATH} AS p FROM pages)")
def type_by_extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(PATH).alias("path")).withColumn("file_type", D.by_suffix(F.col("path")))


@query(f"SELECT page_id, {BYTES_SQL} AS file_type FROM (SELECT page_id, {_pick(HEADS)} AS h FROM pages)")
def type_by_magic(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.unhex(F.expr(_pick(HEADS))).alias("content")).select("page_id", D.by_bytes(F.col("content")).alias("file_type"))


@query(f"SELECT page_id, CASE WHEN s <> 'unknown' THEN s WHEN b IN ('ole', 'zip') THEN 'unknown' ELSE b END AS file_type FROM (SELECT page_id, {SUFFIX_SQL} AS s, {BYTES_SQL} AS b FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN {PATH} ELSE 'x' || page_id END AS p, {_pick(HEADS)} AS h FROM pages))")
def type_cascade(spark, sf_dir):
    ship(spark)
    d = table(spark, sf_dir, "pages").select("page_id", F.expr(f"CASE WHEN page_id % 5 = 0 THEN {PATH} ELSE 'x' || page_id END").alias("p"), F.unhex(F.expr(_pick(HEADS))).alias("h"))
    return d.select("page_id", D.file_type(F.col("p"), F.col("h")).alias("file_type"))


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


OFFICE = "http://schemas.openxmlformats.org"
R = f"{OFFICE}/officeDocument/2006/relationships"
W = f"{OFFICE}/wordprocessingml/2006/main"
A = f"{OFFICE}/drawingml/2006/main"


def _escape(x: str) -> str:
    return x.replace("&", "&amp;").replace("<", "&lt;")


def make_xlsx(rows: list[list[str]]) -> bytes:
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(64 + j)}{i}" t="inlineStr"><is><t>{_escape(v)}</t></is></c>' for j, v in enumerate(r, 1)) + "</row>" for i, r in enumerate(rows, 1))
    return _zip({"[Content_Types].xml": "<Types>spreadsheetml</Types>", "xl/workbook.xml": f'<workbook xmlns:r="{R}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>"})


def make_docx(title: str, text: str, rows: list[list[str]]) -> bytes:
    p = lambda t, props="": f"<w:p>{props}<w:r><w:t>{_escape(t)}</w:t></w:r></w:p>"
    table_ = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    return _zip({"[Content_Types].xml": "<Types>wordprocessingml</Types>", "word/document.xml": f'<w:document xmlns:w="{W}"><w:body>' + p(title, '<w:pPr><w:pStyle w:val="h1"/></w:pPr>') + p(text) + table_ + "</w:body></w:document>", "word/styles.xml": f'<w:styles xmlns:w="{W}"><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>'})


def make_pptx(title: str, text: str) -> bytes:
    sp = lambda t, y, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="1" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{_escape(t)}</a:t></a:r></a:p></p:txBody></p:sp>'
    ns = f'xmlns:p="{OFFICE}/presentationml/2006/main" xmlns:a="{A}" xmlns:r="{R}"'
    return _zip({"[Content_Types].xml": "<Types>presentationml</Types>", "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>', "ppt/slides/slide1.xml": f"<p:sld {ns}><p:cSld><p:spTree>{sp(text, 200)}{sp(title, 100, '<p:ph type=\"title\"/>')}</p:spTree></p:cSld></p:sld>"})


def make_jtd(lines: list[str]) -> bytes:
    head = b"SsmgV.01" + b"\0" * 24 + b"CTextV.01\0"
    head += b"\0" * (len(head) % 2)
    block = lambda t: b"\0\x1c\0\x10\xff\xff\0\x1f" + t.encode("utf-16-be") + b"\0\x0e"
    return head + b"".join(map(block, lines))


def _files(df, maker, kind: str):
    """Each row's strings as a file of one kind."""
    ship(df.sparkSession)

    @pandas_udf("binary")
    def build(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([maker(x, y, z) for x, y, z in zip(a, b, c, strict=True)])

    return over_all(df, "a").select(F.concat("a", F.lit(f".{kind}")).alias("path"), build("a", "b", "c").alias("content")).withColumn("file_type", D.file_type(F.col("path"), F.col("content")))


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_name AS a", "cast(s_acctbal AS string) AS b", "cast(s_nationkey AS string) AS c")


Q = "chr(10) || chr(10)"


def _sql_lines(*parts: str) -> str:
    """Blocks of Markdown, as SQL expressions, with a blank line between them and a line end after the last."""
    return f" || {Q} || ".join(parts) + " || chr(10)"


def make_book(name: str, balance: str, nation: str) -> bytes:
    """Two sheets and a hidden one: a title, a bordered table with a merged header and merged rows, notes, a list, an unlined table with repeats, a chart of it and an image."""
    edge = lambda row: "".join(f'<c r="{c}{row}" s="1"/>' for c in "BCD")  # noqa: E731, F841
    cell = lambda ref, v, s=0: f'<c r="{ref}" s="{s}" t="inlineStr"><is><t>{_escape(v)}</t></is></c>' if v is not None else f'<c r="{ref}" s="{s}"/>'
    number = lambda ref, v, s=0: f'<c r="{ref}" s="{s}"><v>{v}</v></c>'
    row = lambda i, *cells: f'<row r="{i}">{"".join(cells)}</row>'
    one = "".join((
        row(2, cell("B2", f"List of {name}", 2)),
        row(4, cell("B4", "Who", 3), cell("C4", "Money", 3), cell("D4", None, 3)),
        row(5, cell("B5", None, 3), cell("C5", "now", 3), cell("D5", "then", 3)),
        row(6, cell("B6", name, 1), cell("C6", balance, 1), cell("D6", "a|b", 1)),
        row(7, cell("B7", name, 1), cell("C7", balance, 1), cell("D7", "a|b", 1)),
        row(8, cell("B8", nation, 1), cell("C8", "x", 1), cell("D8", None, 1)),
        row(10, cell("B10", "※ only a note")),
        row(12, cell("B12", "①"), cell("C12", "the first thing that is to be said")),
        row(13, cell("B13", "②"), cell("C13", "another thing that is to be said")),
        row(14, cell("B14", "③"), cell("C14", "the last thing that is to be said")),
    ))
    merges = '<mergeCells><mergeCell ref="B4:B5"/><mergeCell ref="C4:D4"/></mergeCells>'
    two = "".join((
        row(1, cell("A1", "key"), cell("B1", "n"), cell("C1", "day")),
        row(2, cell("A2", "p"), number("B2", "1"), number("C2", "45000", 4)),
        row(3, cell("A3", "q"), number("B3", "2.5"), number("C3", "45000.5", 4)),
        row(4, cell("A4", "q"), number("B4", "2.5"), number("C4", "45000.5", 4)),
        row(5, cell("A5", nation), number("B5", "3")),
    ))
    drawing = f'<wsDr xmlns:a="{A}" xmlns:r="{R}">' + "".join((
        '<twoCellAnchor><from><col>4</col><row>7</row></from><to><col>9</col><row>12</row></to><graphicFrame><nvGraphicFramePr><cNvPr id="2" name="Chart 1"/></nvGraphicFramePr><chart r:id="c1"/></graphicFrame></twoCellAnchor>',
        '<oneCellAnchor><from><col>4</col><row>20</row></from><ext cx="10" cy="20"/><pic><nvPicPr><cNvPr id="3" name="Pic"/></nvPicPr><blipFill><a:blip r:embed="i1"/></blipFill></pic></oneCellAnchor>',
        '<twoCellAnchor><from><col>0</col><row>30</row></from><to><col>1</col><row>31</row></to><sp><nvSpPr><cNvPr id="4" name="Box" hidden="1"/></nvSpPr></sp></twoCellAnchor>',
        f'<twoCellAnchor><from><col>0</col><row>40</row></from><to><col>1</col><row>41</row></to><sp><nvSpPr><cNvPr id="5" name="Box"/></nvSpPr><txBody><a:p><a:r><a:t>{_escape(name)}</a:t></a:r></a:p></txBody></sp></twoCellAnchor>',
    )) + "</wsDr>"
    series = lambda n, f: f'<ser><tx><strRef><f>T!$B$1</f></strRef></tx><cat><strRef><f>T!$A$2:$A$5</f></strRef></cat><val><numRef><f>{f}</f><numCache><pt idx="0"><v>{n}</v></pt></numCache></numRef></val></ser>'
    chart = f'<chartSpace xmlns:a="{A}"><chart><title><tx><rich><a:p><a:r><a:t>Sums</a:t></a:r></a:p></rich></tx></title><plotArea><barChart>{series(1, "T!$B$2:$B$5")}{series(7, "Gone!$B$2")}</barChart></plotArea></chart></chartSpace>'
    styles = (
        '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy/mm/dd"/></numFmts><fonts><font/><font><b/></font></fonts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFEEEEEE"/></patternFill></fill></fills>'
        '<borders><border/><border><left style="thin"/><right style="thin"/><top style="thin"/><bottom style="thin"/></border></borders>'
        '<cellXfs><xf fontId="0" borderId="0"/><xf fontId="0" borderId="1"/><xf fontId="1" borderId="0"/><xf fontId="1" fillId="1" borderId="1"/><xf fontId="0" borderId="0" numFmtId="170"/></cellXfs></styleSheet>'
    )
    sheets = "".join(f'<sheet name="{n}" r:id="r{k}"{state}/>' for k, (n, state) in enumerate((("S", ""), ("T", ""), ("H", ' state="hidden"')), 1))
    return _zip({
        "[Content_Types].xml": "<Types>spreadsheetml</Types>", "xl/workbook.xml": f'<workbook xmlns:r="{R}"><sheets>{sheets}</sheets></workbook>', "xl/styles.xml": styles,
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{min(k, 2)}.xml"/>' for k in (1, 2, 3)) + "</Relationships>",
        "xl/worksheets/s1.xml": f"<worksheet><sheetData>{one}</sheetData>{merges}</worksheet>", "xl/worksheets/s2.xml": f"<worksheet><sheetData>{two}</sheetData></worksheet>",
        "xl/worksheets/_rels/s2.xml.rels": '<Relationships><Relationship Id="d" Target="../drawings/drawing1.xml"/></Relationships>', "xl/drawings/drawing1.xml": drawing,
        "xl/drawings/_rels/drawing1.xml.rels": '<Relationships><Relationship Id="c1" Target="../charts/chart1.xml"/><Relationship Id="i1" Target="../media/image1.PNG"/></Relationships>',
        "xl/charts/chart1.xml": chart, "xl/media/image1.PNG": f"png of {nation}", "xl/media/image2.png": f"png of {nation}",
    })


def make_letter(name: str, balance: str, nation: str) -> bytes:
    """Headings, runs with marks, lists, a table with a short row, an equation, a text box said and one not said, a chart, an image."""
    m = f"{OFFICE}/officeDocument/2006/math"
    r = lambda t, props="": f"<w:r><w:rPr>{props}</w:rPr><w:t>{_escape(t)}</w:t></w:r>"
    p = lambda inner, props="": f"<w:p><w:pPr>{props}</w:pPr>{inner}</w:p>"
    eq = "<m:oMath><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in cells) + "</w:tr>"
    box = lambda t: f'<w:r><w:drawing><wp:docPr id="9" name="Box"/><wp:extent cx="5" cy="6"/><wps:wsp><wps:txbx><w:txbxContent><w:p><w:r><w:t>{_escape(t)}</w:t></w:r></w:p></w:txbxContent></wps:txbx></wps:wsp></w:drawing></w:r>'
    num = lambda k, level: f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{k}"/></w:numPr>'
    body = "".join((
        p(r(name), '<w:pStyle w:val="mine"/>'),
        p(r("Bold", "<w:b/>") + r(" and ") + r("up", '<w:vertAlign w:val="superscript"/>') + r("hidden", "<w:vanish/>") + f" {eq}"),
        p(f"<m:oMathPara>{eq}{eq}</m:oMathPara>"),
        p(r("one"), num(1, 0)) + p(r("two"), num(1, 1)) + p(r("three"), num(2, 0)) + p(r("- four")),
        f"<w:sdt><w:sdtContent>{p(r(f'balance {balance}'))}</w:sdtContent></w:sdt>",
        "<w:tbl>" + row(p(r("a")), p(r("b|c"))) + row(p(r(nation)) + p(r("more"))) + "</w:tbl>",
        p(box(f"balance {balance}") + box(f"unsaid {nation}")),
        p(r("", "") + '<w:r><w:drawing><c:chart r:id="c1"/></w:drawing></w:r><w:r><w:drawing><a:blip r:embed="i1"/></w:drawing></w:r>'),
    ))
    ns = f'xmlns:w="{W}" xmlns:m="{m}" xmlns:a="{A}" xmlns:r="{R}" xmlns:c="c" xmlns:wp="wp" xmlns:wps="wps"'
    chart = '<chartSpace><chart><plotArea><scatterChart><ser><xVal><numCache><pt idx="0"><v>2</v></pt><pt idx="1"><v>1</v></pt><pt idx="2"><v>2</v></pt></numCache></xVal><yVal><numCache><pt idx="0"><v>5</v></pt><pt idx="1"><v>6.25</v></pt><pt idx="2"><v>7</v></pt></numCache></yVal></ser></scatterChart></plotArea></chart></chartSpace>'
    numbering = f'<w:numbering xmlns:w="{W}">' + "".join(f'<w:abstractNum w:abstractNumId="{k}"><w:lvl><w:numFmt w:val="{f}"/></w:lvl></w:abstractNum><w:num w:numId="{k}"><w:abstractNumId w:val="{k}"/></w:num>' for k, f in ((1, "bullet"), (2, "decimal"))) + "</w:numbering>"
    styles = f'<w:styles xmlns:w="{W}"><w:style w:styleId="h2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="mine"><w:name w:val="mine"/><w:basedOn w:val="h2"/></w:style></w:styles>'
    rels = '<Relationships><Relationship Id="c1" Target="charts/chart1.xml"/><Relationship Id="i1" Target="media/i.png"/></Relationships>'
    return _zip({"[Content_Types].xml": "<Types>wordprocessingml</Types>", "word/document.xml": f"<w:document {ns}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/numbering.xml": numbering, "word/_rels/document.xml.rels": rels, "word/charts/chart1.xml": chart, "word/media/i.png": f"png of {nation}"})


def make_deck(name: str, balance: str, nation: str) -> bytes:
    """Two slides: a title, a list, a group, a table, a chart, notes; and one without a title."""
    ns = f'xmlns:p="{OFFICE}/presentationml/2006/main" xmlns:a="{A}" xmlns:r="{R}" xmlns:c="c"'
    para = lambda t, props="": f"<a:p>{props}<a:r><a:t>{_escape(t)}</a:t></a:r></a:p>"
    sp = lambda y, inner, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="1" y="{y}"/></a:xfrm></p:spPr><p:txBody>{inner}</p:txBody></p:sp>'
    listed = para("head") + para("one", "<a:pPr><a:buChar/></a:pPr>") + para("two", '<a:pPr lvl="1"/>')
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="1" y="50"/></a:xfrm></p:grpSpPr>{sp(900, para("low", "<a:pPr><a:buChar/></a:pPr>"))}{sp(800, para("high"))}</p:grpSp>'
    table_ = f"<p:graphicFrame><a:tbl><a:tr><a:tc>{para('a')}</a:tc><a:tc><a:p/></a:tc></a:tr><a:tr><a:tc>{para(nation)}</a:tc><a:tc>{para('x')}{para('y')}</a:tc></a:tr></a:tbl></p:graphicFrame>"
    chart = '<p:graphicFrame><c:chart r:id="c1"/></p:graphicFrame>'
    one = sp(200, listed) + group + sp(100, para(name), '<p:ph type="title"/>') + sp(5, para("foot"), '<p:ph type="ftr"/>') + table_ + chart
    data = f'<chartSpace><chart><plotArea><lineChart><ser><tx><strCache><pt><v>s</v></pt></strCache></tx><cat><strCache><pt><v>{_escape(nation)}</v></pt></strCache></cat><val><numCache><pt><v>{balance}</v></pt></numCache></val></ser></lineChart></plotArea></chart></chartSpace>'
    notes = f"<p:notes {ns}>{sp(1, para('said aside'), '<p:ph type=\"body\"/>')}{sp(1, para('7'), '<p:ph type=\"sldNum\"/>')}</p:notes>"
    slide = lambda tree: f"<p:sld {ns}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
    rel = lambda **to: "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in to.items()) + "</Relationships>"
    return _zip({
        "[Content_Types].xml": "<Types>presentationml</Types>", "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="r1"/><p:sldId id="257" r:id="r2"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rel(r1="slides/slide1.xml", r2="slides/slide2.xml"), "ppt/slides/slide1.xml": slide(one), "ppt/slides/slide2.xml": slide(""),
        "ppt/slides/_rels/slide1.xml.rels": rel(c1="../charts/chart1.xml", n="../notesSlides/notesSlide1.xml"), "ppt/charts/chart1.xml": data, "ppt/notesSlides/notesSlide1.xml": notes,
    })


def make_stream(name: str, balance: str, nation: str) -> bytes:
    """A heading by its font, body text, a bold line, a ruled table with a continuation row, text again."""
    u = lambda *xs: b"".join(x.to_bytes(2, "big") for x in xs)
    font = lambda size: u(0x08, size) if size else b""
    para = lambda t, size=700, rulers=0: u(0x1C, 0x10, 0x19, 0) + font(size) + (u(0x8F, 3 + rulers, 0x124, 0, 0) + u(0x1B) * rulers if rulers else b"") + u(0xFFFF, 0x10, 0x1F) + t.encode("utf-16-be")
    cell = lambda a, b, t: u(0x1C, 0x30, 0xC, 0, a, b, 0, 0, 0xC, 0, 0x30, 0x1F) + t.encode("utf-16-be")
    end = u(0x0E)
    body = end.join((
        para(f"{name}様", 1200), para(f"国{nation}"), para(f"残高{balance}"), para("太い", 0),
        para("", 700, 2) + cell(0, 10, "列|1") + cell(20, 30, "列2"), para("", 700, 2) + cell(0, 10, name) + cell(21, 30, nation), para("", 700, 2) + cell(20, 30, "続き"),
        para("終わり"),
    ))
    head = b"SsmgV.01" + b"\0" * 24 + b"CTextV.01\0"
    return head + b"\0" * (len(head) % 2) + body + end


@query(f"SELECT s_name || '.xlsx' AS path, {_sql_lines("'# ' || s_name", "'## S (Sheet Data)'", "'### List of ' || s_name", "'| Who | Money<br>now | Money<br>then |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || s_name || ' | ' || b || ' | a\\|b |' || chr(10) || '| ' || s_nationkey || ' | x |  |'", "'※ only a note'", "'① the first thing that is to be said'", "'② another thing that is to be said'", "'③ the last thing that is to be said'", "'## T (Sheet Data)'", "'| key | n | day |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| p | 1 | 2023-03-15 00:00:00 |' || chr(10) || '| q | 2.5 | 2023-03-15 12:00:00 |' || chr(10) || '| ' || s_nationkey || ' | 3 |  |'", "'### Chart: Sums'", "'| Category | n | n |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| p | 1 | 7 |' || chr(10) || '| q | 2.50 |  |' || chr(10) || '| q | 2.50 |  |' || chr(10) || '| ' || s_nationkey || ' | 3 |  |'", "'![image](images/' || substr(sha256('png of ' || s_nationkey), 1, 16) || '.png)'")} AS md, CAST(NULL AS varchar) AS error FROM (SELECT *, CAST(s_acctbal AS varchar) AS b FROM supplier)")
def xlsx_to_markdown(spark, sf_dir):
    return S.markdown(S.elements(_files(_suppliers(spark, sf_dir), make_book, "xlsx")))


@query(f"SELECT s_name || '.docx' AS path, {_sql_lines("'# ' || s_name", "'## ' || s_name", "'**Bold** and <sup>up</sup>$x^{2}$'", "'$$x^{2} x^{2}$$'", "'- one' || chr(10) || '  - two' || chr(10) || '1. three' || chr(10) || '- four'", "'balance ' || CAST(s_acctbal AS varchar)", "'| a | b\\|c |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || s_nationkey || '<br>more |  |'", "'<details>' || chr(10) || '<summary>図形内テキスト</summary>'", "'unsaid ' || s_nationkey", "'</details>'", "'### Chart'", "'| X | Series1 |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 6.25 |' || chr(10) || '| 2 | 5 |'", "'![image](images/' || substr(sha256('png of ' || s_nationkey), 1, 16) || '.png)'")} AS md, CAST(NULL AS varchar) AS error FROM supplier")
def docx_to_markdown(spark, sf_dir):
    return S.markdown(S.elements(_files(_suppliers(spark, sf_dir), make_letter, "docx")))


@query(f"SELECT s_name || '.pptx' AS path, {_sql_lines("s_name", "'high'", "'low'", "'one' || chr(10) || '  two'", "'head'", "'a' || chr(10) || s_nationkey || chr(9) || 'x<br>y'", "'Chart'", "'カテゴリ' || chr(9) || 's' || chr(10) || s_nationkey || chr(9) || CAST(s_acctbal AS varchar)", "'said aside'")} AS text, CAST(NULL AS varchar) AS error FROM supplier")
def pptx_to_text(spark, sf_dir):
    return S.plain_text(S.elements(_files(_suppliers(spark, sf_dir), make_deck, "pptx")))


@query(f"SELECT s_name || '.pptx' AS path, {_sql_lines("'# ' || s_name", "'## ' || s_name", "'high'", "'low'", "'- one' || chr(10) || '  - two'", "'head'", "'| a |   |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || s_nationkey || ' | x<br>y |'", "'### Chart'", "'| カテゴリ | s |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || s_nationkey || ' | ' || CAST(s_acctbal AS varchar) || ' |'", "'### ノート:'", "'said aside'", "'---'", "'## スライド 2'", "'---'")} AS md, CAST(NULL AS varchar) AS error FROM supplier")
def pptx_to_markdown(spark, sf_dir):
    return S.markdown(S.elements(_files(_suppliers(spark, sf_dir), make_deck, "pptx")))


@query("SELECT s_name || '.jtd' AS path, 'ichitaro' AS file_type, unnest([0, 1]) AS seq, unnest([s_name || '様', '国' || s_nationkey]) AS text FROM supplier")
def jtd_extract(spark, sf_dir):
    return S.elements(_files(_suppliers(spark, sf_dir), lambda a, b, c: make_jtd([f"{a}様", " ", f"国{c}"]), "jtd")).select("path", "file_type", "seq", "text")


@query(f"SELECT s_name || '.jtd' AS path, {_sql_lines("'# ' || s_name", "'## ' || s_name || '様'", "'国' || s_nationkey", "'残高' || CAST(s_acctbal AS varchar)", "'**太い**'", "'| 列\\|1 | 列2 |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || s_name || ' | 続き | ' || s_nationkey || ' |'", "'終わり'")} AS md, CAST(NULL AS varchar) AS error FROM supplier")
def jtd_to_markdown(spark, sf_dir):
    return S.markdown(S.elements(_files(_suppliers(spark, sf_dir), make_stream, "jtd")))


@query("SELECT s_name || '.xlsx' AS path, substr(sha256('png of ' || s_nationkey), 1, 16) || '.png' AS name, 'xl/media/image1.PNG' AS part, 'png of ' || s_nationkey AS content FROM supplier")
def package_images(spark, sf_dir):
    return S.images(_files(_suppliers(spark, sf_dir), make_book, "xlsx")).withColumn("content", F.col("content").cast("string"))


@query("SELECT s_name || '.xlsx' AS path, 'T' AS unit, unnest(['2', '3', '5']) AS id, unnest(['chart', 'pic', 'sp']) AS kind, unnest([8, 21, 41]) AS r1, unnest([5, 5, 1]) AS c1, unnest([13, 21, 42]) AS r2, unnest([10, 5, 2]) AS c2, unnest(['', '', s_name]) AS text FROM supplier")
def drawing_shapes(spark, sf_dir):
    return S.shapes(_files(_suppliers(spark, sf_dir), make_book, "xlsx")).select("path", "unit", "id", "kind", "r1", "c1", "r2", "c2", "text")


@query("""SELECT s_name || e.x AS path, CASE WHEN e.x IN ('.zz', '') THEN 'unknown' ELSE 'x' END AS by_name, e.want AS file_type FROM supplier, (VALUES ('.zz', 'excel'), ('', 'word'), ('.q', 'powerpoint'), ('.bin', 'unknown'), ('.n', 'unknown')) AS e(x, want)""".replace(", CASE WHEN e.x IN ('.zz', '') THEN 'unknown' ELSE 'x' END AS by_name", ""))
def container_types(spark, sf_dir):
    """Containers without a telling name: spreadsheets, documents and decks are known by what is in them, broken and other archives aren't."""
    makers = {".zz": make_book, "": make_letter, ".q": make_deck, ".bin": lambda a, b, c: b"PK\x03\x04" + a.encode(), ".n": lambda a, b, c: _zip({"a.txt": a})}
    out = None
    for end, maker in makers.items():
        one = _files(_suppliers(spark, sf_dir), maker, "x").select(F.regexp_replace("path", r"\.x$", end).alias("path"), "content")
        out = one if out is None else out.union(one)
    return out.select("path", D.file_type(F.col("path"), F.col("content")).alias("file_type"))


def make_pdf(title: str, body: list[str]) -> bytes:
    """One page: a large line, then a paragraph of lines."""
    show = lambda t: b"(" + t.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj"
    page = b"BT /F1 24 Tf 50 700 Td " + show(title) + b" ET BT /F1 10 Tf 12 TL 50 660 Td " + b" T* ".join(map(show, body)) + b" ET"
    data = zlib.compress(page)
    return b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /MediaBox [0 0 600 800] /Contents 4 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >> >> >> >> endobj\n4 0 obj << /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n%%%%EOF" % (len(data), data)


@query("SELECT s_name || '.pdf' AS path, '# ' || s_name || chr(10) || chr(10) || '# ' || s_name || chr(10) || chr(10) || 'This line of the page is longer than a title and is of nation ' || s_nationkey || '.' || chr(10) AS md, CAST(NULL AS varchar) AS error FROM supplier")
def pdf_to_markdown(spark, sf_dir):
    return S.markdown(S.elements(_files(_suppliers(spark, sf_dir), lambda a, b, c: make_pdf(a, ["This line of the page is longer than a title", f"and is of nation {c}."]), "pdf")))


@query("SELECT s_name || '.docx' AS path, 'BadZipFile' AS error FROM supplier")
def broken_file_rows(spark, sf_dir):
    bad = _files(_suppliers(spark, sf_dir), lambda a, b, c: b"PK\x03\x04" + a.encode(), "docx")
    return S.elements(bad).select("path", F.substring_index("error", ":", 1).alias("error"))


def _maths() -> list[tuple[str, str]]:
    """Each construct as XML, and as LaTeX; ¤ stands for a name."""
    r = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
    e = lambda x, tag="e": f"<m:{tag}>{x}</m:{tag}>"
    n = r("¤")
    frac = lambda kind: f'<m:f><m:fPr><m:type m:val="{kind}"/></m:fPr>{e(n, "num")}{e(r("2"), "den")}</m:f>'
    return [
        (frac("bar"), r"\frac{¤}{2}"), (frac("skw"), "^{¤}/_{2}"), (frac("noBar"), r"\genfrac{}{}{0pt}{}{¤}{2}"), (frac("lin"), "{¤}/{2}"),
        (f"<m:sSup>{e(n)}{e(r('2'), 'sup')}</m:sSup>", "¤^{2}"), (f"<m:sSub>{e(n)}{e(r('i'), 'sub')}</m:sSub>", "¤_{i}"), (f"<m:sSubSup>{e(n)}{e(r('i'), 'sub')}{e(r('2'), 'sup')}</m:sSubSup>", "¤_{i}^{2}"),
        (f"<m:rad><m:deg/>{e(n)}</m:rad>", r"\sqrt{¤}"), (f"<m:rad>{e(r('3'), 'deg')}{e(n)}</m:rad>", r"\sqrt[3]{¤}"),
        (f'<m:acc><m:accPr><m:chr m:val="&#x303;"/></m:accPr>{e(n)}</m:acc>', r"\tilde{¤}"), (f'<m:bar><m:barPr><m:pos m:val="top"/></m:barPr>{e(n)}</m:bar>', r"\overline{¤}"),
        (f'<m:d><m:dPr><m:begChr m:val="["/><m:endChr m:val=""/></m:dPr>{e(n)}</m:d>', r"\left[¤\right."), (f'<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr>{e(r("i=1"), "sub")}{e(r("k"), "sup")}{e(n)}</m:nary>', r"\sum_{i=1}^{k}{¤}"),
        (f"<m:func>{e(r('sin'), 'fName')}{e(n)}</m:func>", r"\sin(¤)"), (f"<m:limLow>{e(r('lim'))}{e(n, 'lim')}</m:limLow>", r"\lim_{¤}"), (f"<m:limUpp>{e(n)}{e(r('*'), 'lim')}</m:limUpp>", r"\overset{*}{¤}"),
        (f"<m:groupChr>{e(n)}</m:groupChr>", r"\underbrace{¤}"), (f"<m:m><m:mr>{e(n)}{e(r('0'))}</m:mr><m:mr>{e(r('1'))}{e(r('x'))}</m:mr></m:m>", r"\begin{matrix}¤ & 0 \\ 1 & x\end{matrix}"),
        (f"<m:eqArr>{e(n)}{e(r('0'))}</m:eqArr>", r"\begin{array}{c}¤ \\ 0\end{array}"), (f"<m:box>{e(n)}</m:box>", "¤"), (r("¤#α%"), r"¤\#\alpha \%"),
    ]


MATHS = _maths()


def _maths_sql() -> str:
    cases = " ".join(f"WHEN {k} THEN replace('{latex}', '¤', replace(n_name, '_', chr(92) || '_'))" for k, (_, latex) in enumerate(MATHS))
    return f"SELECT n_nationkey, CASE n_nationkey % {len(MATHS)} {cases} END AS latex FROM nation"


@query(_maths_sql())
def omml_to_latex(spark, sf_dir):
    ship(spark)

    @pandas_udf("string")
    def latex(x: pd.Series) -> pd.Series:
        from docloom.functions.omml import to_latex

        return x.map(to_latex)

    whole = f'<m:oMath xmlns:m="{OFFICE}/officeDocument/2006/math">{{}}</m:oMath>'
    forms = F.array(*[F.lit(whole.format(xml)) for xml, _ in MATHS])
    xml = F.replace(F.get(forms, (F.col("n_nationkey") % len(MATHS)).cast("int")), F.lit("¤"), F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", latex(xml).alias("latex"))
