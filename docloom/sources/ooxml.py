"""Parts of OOXML files as rows: sheet cells, document paragraphs and tables, slide shapes, charts. Standard library only."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import sys
import zipfile
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import lru_cache
from xml.etree import ElementTree as ET

from docloom.sources.sheets import Cell, Sheet

MAX_PART = 256 << 20


class _Local(dict):
    """Local names by names in full, each cut once in a worker; emptied where files bring more than `MOST` names."""

    MOST = 1 << 14

    def __missing__(self, name: str) -> str:
        local = sys.intern(name.rpartition("}")[2])
        if len(self) >= self.MOST:
            self.clear()
        self[name] = local
        return local


LOCAL = _Local()


def tag(e: ET.Element) -> str:
    return LOCAL[e.tag]


def attr(e: ET.Element | None, name: str, default: str = "") -> str:
    """By local name."""
    if e is not None:
        for k, v in e.attrib.items():
            if LOCAL[k] == name:
                return v
    return default


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        if e is None:
            return None
        for c in e:
            if LOCAL[c.tag] == name:
                e = c
                break
        else:
            return None
    return e


def kids(e: ET.Element | None) -> list[ET.Element]:
    return [] if e is None else list(e)


def under(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if LOCAL[x.tag] == name]


def first_under(e: ET.Element, name: str) -> ET.Element | None:
    """The first of `under`, or None."""
    for x in e.iter():
        if LOCAL[x.tag] == name:
            return x
    return None


class Package:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.names:
            return None
        if self.zip.getinfo(name).file_size > MAX_PART:
            raise ValueError(f"{name} is too large")
        return ET.fromstring(self.zip.read(name))

    def relations(self, name: str) -> dict[str, str]:
        folder, base = posixpath.split(name)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        found = [] if root is None else [(attr(r, "Id"), attr(r, "Target")) for r in root]
        return {k: to[1:] if to.startswith("/") else posixpath.normpath(posixpath.join(folder, to)).lstrip("/") for k, to in found}


@lru_cache(1 << 14)
def _reference(ref: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for x in letters:
        col = col * 26 + ord(x) - 64
    return int(row), col


def _range(ref: str) -> tuple[int, int, int, int]:
    a, _, b = ref.partition(":")
    (r1, c1), (r2, c2) = _reference(a), _reference(b or a)
    return r1, r2, c1, c2


DATE_FORMATS = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))


def _number(raw: str, dated: bool) -> str:
    """A number as its shortest text; a serial number of a dated format as a date and time."""
    try:
        x = float(raw)
    except ValueError:
        return raw
    if dated and 0 < x < 2_958_466:
        at = datetime(1899, 12, 30) + timedelta(days=x)
        return str((at + timedelta(microseconds=500_000)).replace(microsecond=0))
    return str(int(x)) if x == int(x) and abs(x) < 1e15 and not re.search(r"[.eE]", raw) else repr(x)


class Workbook:
    """Sheets of an xlsx file, but for hidden ones, with values, formats, merged ranges, charts and images."""

    def __init__(self, content: bytes):
        self.package = p = Package(content)
        strings = p.xml("xl/sharedStrings.xml")
        self.shared = ["".join(t.text or "" for t in under(si, "t")) for si in strings] if strings is not None else []
        styles = p.xml("xl/styles.xml")
        on = lambda e, name: (x := child(e, name)) is not None and attr(x, "val", "1") not in ("0", "false")
        self.bold = [on(f, "b") for f in kids(child(styles, "fonts"))]
        self.fill = [attr(child(f, "patternFill"), "patternType", "none") != "none" and attr(child(f, "patternFill", "fgColor"), "rgb") not in ("FFFFFFFF", "00000000") for f in kids(child(styles, "fills"))]
        self.border = [{tag(x): attr(x, "style") for x in b if attr(x, "style")} for b in kids(child(styles, "borders"))]
        dated = {int(attr(f, "numFmtId", "0")) for f in under(styles, "numFmt") if re.search(r"[ydh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", attr(f, "formatCode").lower()))} if styles is not None else set()
        self.formats = [tuple(int(attr(x, n, "0")) for n in ("fontId", "fillId", "borderId")) + (int(attr(x, "numFmtId", "0")) in DATE_FORMATS | dated,) for x in kids(child(styles, "cellXfs"))]
        book, self.rels = p.xml("xl/workbook.xml"), p.relations("xl/workbook.xml")
        shown = [x for x in kids(child(book, "sheets")) if attr(x, "state") != "hidden"]
        self.parts = [self.rels[attr(x, "id")] for x in shown]
        self.sheets = [self._sheet(no, attr(x, "name"), part) for no, (x, part) in enumerate(zip(shown, self.parts, strict=True))]

    def _sheet(self, no: int, name: str, part: str) -> Sheet:
        out = Sheet(no, name)
        root = self.package.xml(part)
        get = lambda xs, k, none: xs[k] if k < len(xs) else none
        looks: dict[int, tuple[bool, bool, dict[str, str]]] = {}
        for c in under(root, "c") if root is not None else []:
            v, kind = child(c, "v"), attr(c, "t")
            at = int(attr(c, "s", "0"))
            font, fill, border, dated = self.formats[at] if at < len(self.formats) else (0, 0, 0, False)
            text = None if v is None else v.text
            if text is not None:
                text = self.shared[int(text)] if kind == "s" else ("True" if text == "1" else "False") if kind == "b" else _number(text, dated) if kind in ("", "n") else text
            elif kind == "inlineStr":
                text = "".join([t.text or "" for t in under(c, "t")])
            if (look := looks.get(at)) is None:
                look = looks[at] = get(self.bold, font, False), get(self.fill, fill, False), get(self.border, border, {})
            out.cells[_reference(attr(c, "r"))] = Cell(text, *look)
        out.merges = [_range(attr(m, "ref")) for m in under(root, "mergeCell")] if root is not None else []
        return out.ready()

    def values(self, formula: str) -> list[str | None] | None:
        """The values of a reference like Sheet!$A$1:$B$5 row by row; None for a sheet that isn't there."""
        sheet, _, ref = formula.rpartition("!")
        sheet = sheet.strip("'").replace("''", "'")
        own = next((s for s in self.sheets if s.name == sheet), None)
        if own is None or not re.fullmatch(r"\$?[A-Z]+\$?\d+(:\$?[A-Z]+\$?\d+)?", ref):
            return None
        r1, r2, c1, c2 = _range(ref)
        return [own.cells[r, c].value if (r, c) in own.cells else None for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)]

    def drawn(self) -> None:
        """Puts each sheet's charts and images at the row they are anchored at."""
        for sheet, part in zip(self.sheets, self.parts, strict=True):
            for a in anchors(self.package, part):
                if a["hidden"]:
                    continue
                if a["kind"] == "chart" and (root := self.package.xml(a["target"])) is not None:
                    title, rows = chart_table(root, self.values)
                    sheet.drawn.append((a["r1"], "chart", title, rows))
                elif a["kind"] == "pic" and a["target"] in self.package.names:
                    sheet.drawn.append((a["r1"], "image", image_name(self.package, a["target"]), None))


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
#: What may stand before the two elements that the schema puts in order.
BEFORE_SETUP = frozenset("sheetPr dimension sheetViews sheetFormatPr cols sheetData sheetCalcPr sheetProtection protectedRanges scenarios autoFilter sortState dataConsolidate customSheetViews mergeCells phoneticPr conditionalFormatting dataValidations hyperlinks printOptions pageMargins".split())


def fit_to_one_page(content: bytes) -> bytes:
    """The workbook with every sheet set to print on one page, for a renderer; all else stays as it is."""
    source, out = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        for item in source.infolist():
            body = source.read(item)
            if re.fullmatch(r"xl/worksheets/[^/]+\.xml", item.filename):
                root = ET.fromstring(body)
                space = root.tag.partition("}")[0] + "}" if "}" in root.tag else ""
                ET.register_namespace("", space[1:-1] or MAIN)
                props = child(root, "sheetPr")
                if props is None:
                    props = ET.Element(f"{space}sheetPr")
                    root.insert(0, props)
                fit = child(props, "pageSetUpPr")
                (ET.SubElement(props, f"{space}pageSetUpPr") if fit is None else fit).set("fitToPage", "1")
                setup = child(root, "pageSetup")
                if setup is None:
                    setup = ET.Element(f"{space}pageSetup")
                    root.insert(sum(tag(x) in BEFORE_SETUP for x in root), setup)
                setup.attrib.pop("scale", None)
                setup.set("fitToWidth", "1")
                setup.set("fitToHeight", "1")
                body = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            made.writestr(item, body)
    return out.getvalue()


def image_name(p: Package, part: str) -> str:
    """The first 16 digits of the content's SHA-256 and the part's suffix: equal images have one name."""
    return hashlib.sha256(p.zip.read(part)).hexdigest()[:16] + posixpath.splitext(part)[1].lower()


def images(content: bytes) -> list[tuple[str, str, bytes]]:
    """(name, part, bytes) of the images in a package, one of each content, by part."""
    p = Package(content)
    out: dict[str, tuple[str, str, bytes]] = {}
    for part in sorted(n for n in p.names if re.search(r"/media/[^/]+$", n)):
        out.setdefault(name := image_name(p, part), (name, part, p.zip.read(part)))
    return list(out.values())


def anchors(p: Package, part: str) -> list[dict]:
    """Anchored shapes of a sheet: id, name, kind (pic, sp, cxnSp, grpSp, chart, frame), hidden, rows and columns from 1, size, text, target part."""
    rels = p.relations(part)
    out = []
    for drawing in sorted(t for t in rels.values() if "/drawings/drawing" in t):
        root, inner = p.xml(drawing), p.relations(drawing)
        for a in root if root is not None else []:
            if tag(a) not in ("twoCellAnchor", "oneCellAnchor"):
                continue
            shape = next((x for x in a if tag(x) in ("pic", "sp", "cxnSp", "grpSp", "graphicFrame")), None)
            if shape is None:
                continue
            info = first_under(shape, "cNvPr")
            chart = next((x for x in under(shape, "chart") if attr(x, "id")), None)
            blip = first_under(shape, "blip")
            place = lambda e, n, a=a: int(x.text) if (x := child(a, e, n)) is not None else None
            up = any(attr(g, "name").startswith("adj") and re.search(r"val -", attr(g, "fmla")) for g in under(shape, "gd"))
            r0, c0 = place("from", "row") or 0, place("from", "col") or 0
            ext = x if (x := first_under(shape, "ext")) is not None else first_under(a, "ext")
            kind = "chart" if chart is not None else "frame" if tag(shape) == "graphicFrame" else tag(shape)
            target = inner.get(attr(chart, "id") if chart is not None else attr(blip, "embed"), "")
            out.append({
                "id": attr(info, "id"), "name": attr(info, "name"), "kind": kind, "hidden": attr(info, "hidden") in ("1", "true"),
                "r1": max(1, r0 + 1 - up), "c1": c0 + 1, "r2": (place("to", "row") if place("to", "row") is not None else r0) + 1, "c2": (place("to", "col") if place("to", "col") is not None else c0) + 1,
                "w": int(attr(ext, "cx", "0") or 0), "h": int(attr(ext, "cy", "0") or 0), "text": "\n".join(t for q in under(shape, "p") if (t := "".join(x.text or "" for x in under(q, "t")))), "target": target,
            })
    return out


def xlsx_anchors(content: bytes) -> list[tuple]:
    """(sheet_no, sheet, id, name, kind, hidden, r1, c1, r2, c2, w, h, text, target) of all anchored shapes."""
    book = Workbook(content)
    return [(s.no, s.name, *a.values()) for s, part in zip(book.sheets, book.parts, strict=True) for a in anchors(book.package, part)]


def xlsx_cells(content: bytes) -> list[tuple]:
    """(sheet_no, sheet, row, col, value, bold, border) of visible sheets; cached values of formulas."""
    return [(s.no, s.name, r, c, x.value, x.bold, bool(x.sides)) for s in Workbook(content).sheets for (r, c), x in s.cells.items()]


def xlsx_merges(content: bytes) -> list[tuple]:
    """(sheet_no, r1, r2, c1, c2) of merged ranges."""
    return [(s.no, *m) for s in Workbook(content).sheets for m in s.merges]


# -- charts -------------------------------------------------------------------

#: The kinds of charts that are read, the first of them in a plot.
CHARTS = ("barChart", "lineChart", "pieChart", "areaChart", "scatterChart", "doughnutChart", "radarChart", "bar3DChart", "line3DChart", "pie3DChart", "area3DChart", "bubbleChart")


def _points(e: ET.Element | None, values: Callable[[str], list | None] | None) -> list[str | None]:
    """The values a formula refers to, else the cached ones one after the other."""
    if e is None:
        return []
    formula = next((f.text for f in under(e, "f") if f.text), None)
    found = values(formula) if values and formula else None
    if found is not None:
        return found
    cached = [child(pt, "v").text if child(pt, "v") is not None else None for pt in under(e, "pt")]
    return cached or [x.text for x in under(e, "v")]


def _float(x: str | None) -> float | None:
    try:
        return None if x is None or not str(x).strip() else float(x)
    except ValueError:
        return None


def shown(x: float | None) -> str:
    """'' for none, whole numbers without decimals, others with two."""
    return "" if x is None else str(int(x)) if x == int(x) else f"{x:.2f}"


def chart_table(root: ET.Element, values: Callable[[str], list | None] | None = None, head: str = "Category", plain: bool = False) -> tuple[str, list[list[str]]]:
    """Title and table of a chart: categories down and series across, or for scatter charts each x once, ascending.

    plain: values as numbers are written, not with two decimals.
    """
    title = "".join(t.text or "" for t in under(x, "t")) if (x := child(root, "chart", "title")) is not None else ""
    plot = child(root, "chart", "plotArea")
    kind = next((x for x in kids(plot) if tag(x) in CHARTS), None)
    series = [x for x in kids(kind) if tag(x) == "ser"]
    names = [next((v for v in _points(child(s, "tx"), values) if v), None) or f"Series{k}" for k, s in enumerate(series, 1)]
    show = (lambda v: "" if v is None else str(v)) if plain else shown
    if kind is not None and tag(kind) == "scatterChart":
        xs: list[dict] = []
        for s in series:
            own: dict = {}
            for x, y in zip(_points(child(s, "xVal"), values), _points(child(s, "yVal"), values), strict=False):
                key = _float(x) if _float(x) is not None else x
                if key is not None:
                    own.setdefault(key, _float(y))
            xs.append(own)
        keys = sorted({k for own in xs for k in own}, key=lambda k: (isinstance(k, str), k))
        return title, [["X", *names], *([k if isinstance(k, str) else shown(k), *(show(own.get(k)) for own in xs)] for k in keys)] if series else []
    columns = [[_float(v) for v in _points(child(s, "val"), values)] for s in series]
    labels = _points(child(series[0], "cat"), values) if series else []
    if not labels:
        labels = [str(i + 1) for i in range(len(columns[0]))] if columns else []
    rows = [[label or "", *(show(col[i]) if i < len(col) else "" for col in columns)] for i, label in enumerate(labels)]
    return title, [[head, *names], *rows] if series else []


def charts(content: bytes) -> list[tuple[str, str, list[list[str]]]]:
    """(part, title, table) of all charts of a package, from cached values."""
    p = Package(content)
    return [(n, *chart_table(p.xml(n))) for n in sorted(n for n in p.names if re.search(r"/charts/chart\d+\.xml$", n))]


# -- documents ----------------------------------------------------------------


def _on(props: ET.Element | None, name: str) -> bool:
    return (x := child(props, name)) is not None and attr(x, "val", "1") not in ("0", "false", "none")


MATHS = "officeDocument/2006/math}"


def _runs(p: ET.Element) -> str:
    """Text of a paragraph with its marks; hidden runs, and what stands in text boxes, are left out.

    Equations are LaTeX: inline between $, displayed ones between $$.
    """
    from docloom.functions.omml import to_latex

    out: list[str] = []

    def walk(e: ET.Element) -> None:
        kind = tag(e)
        if kind in ("txbxContent", "drawing", "pict", "Fallback", "pPr", "del"):
            return
        if kind == "oMathPara":
            out.append(f"$${' '.join(to_latex(x) for x in e if tag(x) == 'oMath')}$$")
        elif kind == "oMath":
            out.append(f"${to_latex(e)}$")
        elif kind == "r" and MATHS not in e.tag:
            props = child(e, "rPr")
            if _on(props, "vanish"):
                return
            text = "".join((x.text or "") if tag(x) == "t" else "\t" if tag(x) == "tab" else "\n" if tag(x) == "br" else "" for x in e)
            if text.strip():
                position = attr(child(props, "vertAlign"), "val")
                text = {"superscript": f"<sup>{text}</sup>", "subscript": f"<sub>{text}</sub>"}.get(position, text)
                for name, a, b in (("strike", "~~", "~~"), ("u", "<u>", "</u>"), ("i", "*", "*"), ("b", "**", "**")):
                    text = f"{a}{text}{b}" if _on(props, name) else text
            out.append(text)
        else:
            for x in e:
                walk(x)

    for x in p:
        walk(x)
    return "".join(out)


def _boxes(e: ET.Element) -> list[str]:
    """Texts of the text boxes in an element; of a choice and its fallback, which say the same, the first."""
    out: list[str] = []
    for box in under(e, "txbxContent"):
        text = "\n".join(t for q in under(box, "p") if (t := "".join(x.text or "" for x in under(q, "t")).strip()))
        if text and text not in out:
            out.append(text)
    return out


def docx_shapes(content: bytes) -> list[tuple[str, str, str, int, int, str]]:
    """(id, name, kind, width, height, text) of drawn shapes and pictures, in document order."""
    root = Package(content).xml("word/document.xml")
    out = []
    for d in under(root, "drawing") if root is not None else []:
        info, ext = first_under(d, "docPr"), first_under(d, "extent")
        kind = next((k for k in ("chart", "wpc", "wgp", "wsp", "pic") if any(tag(x) == k for x in d.iter())), "drawing")
        out.append((attr(info, "id"), attr(info, "name"), kind, int(attr(ext, "cx", "0") or 0), int(attr(ext, "cy", "0") or 0), "\n".join(_boxes(d))))
    return out


LISTED = re.compile(r"(?:[-•・○●◆◇▪▫*]|\d+[.)])\s+")


def docx_elements(content: bytes) -> list[tuple]:
    """(seq, kind, level, text, cells): headings, list items, paragraphs, tables, charts, images and text boxes in document order."""
    p = Package(content)
    body = child(p.xml("word/document.xml"), "body")
    rels = p.relations("word/document.xml")
    styles = p.xml("word/styles.xml")
    names = {attr(s, "styleId"): attr(child(s, "name"), "val") for s in under(styles, "style")} if styles is not None else {}
    bases = {attr(s, "styleId"): attr(child(s, "basedOn"), "val") for s in under(styles, "style")} if styles is not None else {}
    numbering = p.xml("word/numbering.xml")
    bullets = {}
    if numbering is not None:
        kinds = {attr(a, "abstractNumId"): attr(child(child(a, "lvl"), "numFmt"), "val") for a in under(numbering, "abstractNum")}
        bullets = {attr(n, "numId"): kinds.get(attr(child(n, "abstractNumId"), "val")) == "bullet" for n in under(numbering, "num")}
    out: list[tuple] = []
    boxes: list[tuple[int, str]] = []

    def add(kind: str, level: int, text: str | None, cells: list | None = None) -> None:
        out.append((len(out), kind, level, text, cells))

    def level_of(style: str) -> int:
        seen: set[str] = set()
        while style and style not in seen:
            seen.add(style)
            name = names.get(style, style).lower()
            if m := re.search(r"heading\s*(\d+)", name):
                return int(m[1])
            if name == "title":
                return 1
            style = bases.get(style, "")
        return 0

    def paragraph(e: ET.Element) -> None:
        props, text = child(e, "pPr"), _runs(e).strip()
        style = attr(child(props, "pStyle"), "val")
        level, num = level_of(style), child(props, "numPr")
        if text and level:
            add("heading", level, text)
        elif text and num is not None:
            add("bullet" if bullets.get(attr(child(num, "numId"), "val"), True) else "number", int(attr(child(num, "ilvl"), "val", "0") or 0), text)
        elif text and ("list" in names.get(style, "").lower() or LISTED.match(text)):
            add("number" if re.match(r"\d+[.)]", text) or "number" in names.get(style, "").lower() else "bullet", 0, LISTED.sub("", text, count=1))
        elif text:
            add("paragraph", 0, text)
        for x in e.iter():
            if tag(x) == "chart" and (part := rels.get(attr(x, "id"))) in p.names:
                title, rows = chart_table(p.xml(part))
                add("chart", 0, title, rows)
            elif tag(x) == "blip" and (part := rels.get(attr(x, "embed"))) in p.names:
                add("image", 0, image_name(p, part))
        boxes.extend((len(out), t) for t in _boxes(e))

    def table(e: ET.Element) -> None:
        rows = [["<br>".join(filter(None, (_runs(q).strip() for q in under(c, "p")))) for c in r if tag(c) == "tc"] for r in e if tag(r) == "tr"]
        rows = [r for r in rows if r]
        if rows:
            width = len(rows[0])
            add("table", 0, None, [(r + [""] * width)[:width] for r in rows])

    def walk(e: ET.Element) -> None:
        for x in e:
            if tag(x) == "p":
                paragraph(x)
            elif tag(x) == "tbl":
                table(x)
            elif tag(x) in ("sdt", "sdtContent", "ins", "smartTag"):
                walk(x)

    if body is not None:
        walk(body)
    # boxes whose text the document says itself, or that say more of it, are left out
    said = [x[3] for x in out if x[3] and x[1] in ("heading", "paragraph", "bullet", "number")]
    late = [(at, t) for at, t in boxes if not any(t in q or q in t for q in said)]
    for k, (at, t) in enumerate(late):
        out.insert(at + k, (0, "details", 0, t, None))
    return [(i, *x[1:]) for i, x in enumerate(out)]


# -- slides -------------------------------------------------------------------


def _place(x: ET.Element) -> tuple[float, float]:
    off = first_under(x, "off")
    return (float(attr(off, "y", "inf") or "inf"), float(attr(off, "x", "inf") or "inf")) if off is not None else (float("inf"),) * 2


def _frames(tree: ET.Element, grouped: bool = False) -> list[tuple[ET.Element, bool]]:
    """Shapes by top and left, those of a group at its place and in their own order; and whether they are in a group."""
    shapes = sorted(((_place(x), k, x) for k, x in enumerate(tree) if tag(x) in ("sp", "graphicFrame", "grpSp", "pic")), key=lambda t: t[:2])
    out = []
    for _, _, x in shapes:
        out += _frames(x, True) if tag(x) == "grpSp" else [(x, grouped)]
    return out


def _list_kind(paragraphs: list[ET.Element]) -> str | None:
    """What the first paragraph that says so makes of a frame: number, bullet, or no list."""
    for q in paragraphs:
        props = child(q, "pPr")
        if child(props, "buAutoNum") is not None:
            return "number"
        if child(props, "buChar") is not None or int(attr(props, "lvl", "0") or 0) > 0:
            return "bullet"
    return None


def pptx_elements(content: bytes) -> list[tuple]:
    """(slide, seq, kind, level, text, cells): of each slide its title, texts and lists by place, tables, charts, images, notes."""
    p = Package(content)
    show, rels = p.xml("ppt/presentation.xml"), p.relations("ppt/presentation.xml")
    out: list[tuple] = []
    for no, s in enumerate(kids(child(show, "sldIdLst")), 1):
        part = rels[next((v for k, v in s.attrib.items() if k.endswith("relationships}id")), attr(s, "id"))]
        root, inner = p.xml(part), p.relations(part)
        frames = _frames(under(root, "spTree")[0]) if root is not None and under(root, "spTree") else []
        role = {id(x): attr(first_under(x, "ph"), "type") for x, _ in frames}
        line = lambda q: "".join(["\n" if LOCAL[t.tag] == "br" else t.text or "" for t in q.iter() if LOCAL[t.tag] in ("t", "br")]).strip()
        texts = [(x, grouped, [(q, t) for q in under(x, "p") if (t := line(q))]) for x, grouped in frames if tag(x) == "sp"]
        titled = next((x for x, _, lines in texts if role[id(x)] in ("title", "ctrTitle") and lines), None)
        first = titled if titled is not None else next((x for x, _, lines in texts if lines and role[id(x)] not in ("dt", "ftr", "sldNum")), None)
        found: list[tuple] = []
        if first is not None:
            found.append(("title", 2, re.sub(r"\s*[\n\v\f]\s*", "<br>", "<br>".join(t for _, t in next(lines for x, _, lines in texts if x is first))), None))
        else:
            found.append(("made", 2, f"スライド {no}", None))
        for x, grouped, lines in texts:
            if not lines or x is titled or x is first and titled is None or role[id(x)] in ("title", "ctrTitle", "dt", "ftr", "sldNum"):
                continue
            kind = None if grouped else _list_kind([q for q, _ in lines])
            plain = []
            for q, t in lines:
                props = child(q, "pPr")
                depth = int(attr(props, "lvl", "0") or 0)
                if kind and (depth > 0 or child(props, "buChar") is not None or child(props, "buAutoNum") is not None):
                    found.append((kind, depth, t, None))
                else:
                    plain.append(t)
            if plain:
                found.append(("text", 0, "<br>".join(plain), None))
        for x, _ in frames:
            t = first_under(x, "tbl")
            if t is not None:
                rows = [["<br>".join(v for q in under(c, "p") if (v := line(q))) or " " for c in r if tag(c) == "tc"] for r in t if tag(r) == "tr"]
                found.append(("table", 0, None, rows))
        for x, _ in frames:
            c = next((c for c in under(x, "chart") if attr(c, "id")), None)
            if c is not None and inner.get(attr(c, "id")) in p.names:
                title, rows = chart_table(p.xml(inner[attr(c, "id")]), head="カテゴリ", plain=True)
                found.append(("chart", 0, title, rows))
        for x, _ in frames:
            blip = first_under(x, "blip") if tag(x) == "pic" else None
            if blip is not None and inner.get(attr(blip, "embed")) in p.names:
                found.append(("image", 0, image_name(p, inner[attr(blip, "embed")]), None))
        note = next((t for t in inner.values() if "/notesSlides/" in t), None)
        if note and (notes := p.xml(note)) is not None:
            said = [line(q) for x in under(notes, "sp") if attr(first_under(x, "ph"), "type") == "body" for q in under(x, "p")]
            if any(said):
                found += [("made", 3, "ノート:", None), ("text", 0, "\n".join(said).strip(), None)]
        found.append(("rule", 0, None, None))
        out += [(no, len(out) + k, *x) for k, x in enumerate(found)]
    return out
