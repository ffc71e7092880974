"""Order-dependent searches: regions of a sheet, superscripts of a page, closures of connectors.

These visit cells or lines in order and mark what they have used, so each runs
over one sheet or page at a time, streamed (see geometry.per_group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.geometry import per_group
from docloom.session import by_key

REGION = T.StructType([T.StructField("sheet", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("r1", "r2", "c1", "c2"))])


def _filled(v: str | None) -> bool:
    return bool(v and v.strip())


def bordered(cells: list[tuple[int, int, str | None, bool, bool]]) -> list[tuple[int, int, int, int]]:
    """Regions of (row, col, value, left, top) cells: from each unused cell with a left and a top border, down while two left borders or more follow; valid if under half of the rows and of the columns are empty."""
    left, corner, value = {}, [], {}
    for r, c, v, has_left, has_top in sorted(cells, key=lambda x: x[:2]):
        value[r, c] = v
        if has_left:
            left.setdefault(r, []).append(c)
            if has_top:
                corner.append((r, c))
    out, used = [], set()
    for r, c in corner:
        if (r, c) in used:
            continue
        cols = [x for x in left[r] if x >= c]
        if len(cols) < 2:
            continue
        r2, c1, c2 = r, cols[0], cols[-1]
        used.update((r, x) for x in cols)
        while len(more := [x for x in left.get(r2 + 1, ()) if c1 <= x <= c2]) >= 2:
            r2 += 1
            used.update((r2, x) for x in more)
        if (r2 > r or c2 - c1 >= 2) and c2 > c1:
            rows = sum(not any(_filled(value.get((i, j))) for j in range(c1, c2 + 1)) for i in range(r, r2 + 1))
            empty = sum(not any(_filled(value.get((i, j))) for i in range(r, r2 + 1)) for j in range(c1, c2 + 1))
            if rows < 0.5 * (r2 - r + 1) and empty < 0.5 * (c2 - c1 + 1):
                out.append((r, r2, c1, c2))
    return out


def discrete(cells: list[tuple[int, int, str | None]]) -> list[tuple[int, int, int, int]]:
    """Regions of (row, col, value) cells: from each unused cell with text, down its column and right along its row until a cell without a value; two columns or more, and two cells or more in 30 % of the rows.

    Blank text ends no region (only a missing value does), but starts none.
    """
    value = {(r, c): v for r, c, v in cells if v is not None}
    out, used = [], set()
    for r, c in sorted(value):
        if (r, c) in used or not _filled(value[r, c]):
            continue
        r2, c2 = r, c
        while (r2 + 1, c) in value:
            r2 += 1
        while (r, c2 + 1) in value:
            c2 += 1
        used.update((i, j) for i in range(r, r2 + 1) for j in range(c, c2 + 1))
        many = sum(sum(_filled(value.get((i, j))) for j in range(c, c2 + 1)) >= 2 for i in range(r, r2 + 1))
        if c2 > c and many >= 0.3 * (r2 - r + 1):
            out.append((r, r2, c, c2))
    return out


def bordered_regions(cells: DataFrame) -> DataFrame:
    """cells(sheet, row, col, value, left, top) -> sheet, r1, r2, c1, c2."""
    own = cells.select("sheet", "row", "col", "value", "left", "top")
    return per_group(own, "sheet", ["row", "col"], lambda rows: [(rows[0][0], *x) for x in bordered([r[1:] for r in rows])], REGION)


def discrete_regions(cells: DataFrame) -> DataFrame:
    """cells(sheet, row, col, value) -> sheet, r1, r2, c1, c2."""
    own = cells.select("sheet", "row", "col", "value")
    return per_group(own, "sheet", ["row", "col"], lambda rows: [(rows[0][0], *x) for x in discrete([r[1:] for r in rows])], REGION)


def superscripts(lines: DataFrame, base: float) -> DataFrame:
    """lines(page, id, x0, x1, y, size, text) -> page, id, text: a short line in small type that starts where another ends, at about the same height, joins it as <sup>."""

    def run(rows: list[tuple]) -> list[tuple]:
        text, gone = {r[1]: r[6] for r in rows}, set()
        # small lines by bands of ten points: what is at about the same height is in a line's band or beside it
        bands: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            if r[5] < 0.7 * base:
                bands.setdefault(int(r[4] // 10), []).append(k)
        for p, i, _, x1, y, _, _ in rows:
            if i in gone:
                continue
            band = int(y // 10)
            for k in sorted(k for b in (band - 1, band, band + 1) for k in bands.get(b, ())):
                _, j, left, _, y2, _, _ = rows[k]
                mark = text[j].strip()
                if i != j and j not in gone and abs(y - y2) < 10 and 0 < len(mark) <= 15 and abs(x1 - left) < 10:
                    text[i] = f"{text[i].rstrip()}<sup>{mark}</sup>"
                    gone.add(j)
                    break
        return [(r[0], r[1], text[r[1]]) for r in rows if r[1] not in gone]

    own = lines.select("page", "id", "x0", "x1", "y", "size", "text")
    return per_group(own, "page", ["id"], run, T.StructType([own.schema["page"], own.schema["id"], own.schema["text"]]))


def connector_closure(links: DataFrame, start: DataFrame) -> DataFrame:
    """links(sheet, a, b), start(sheet, id) -> sheet, id: all shapes that connectors join to the start, either way."""
    both = links.select("sheet", "a", "b").union(links.select("sheet", F.col("b"), F.col("a"))).union(start.select("sheet", F.lit(None).cast(links.schema["a"].dataType), "id")).toDF("sheet", "a", "b")

    def run(rows: list[tuple]) -> list[tuple]:
        to: dict = {}
        todo = []
        for _, a, b in rows:
            if a is None:
                todo.append(b)
            else:
                to.setdefault(a, []).append(b)
        seen = set(todo)
        while todo:
            for b in to.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return [(rows[0][0], x) for x in sorted(seen)]

    schema = T.StructType([links.schema["sheet"], T.StructField("id", links.schema["a"].dataType)])
    return per_group(both, "sheet", ["a", "b"], run, schema)


# -- the rest is relational -----------------------------------------------------


def scan_pages(figures: DataFrame) -> DataFrame:
    """figures(page, area, page_area, n_text) -> page, is_scan: no text, and one figure alone that covers 80 % or more."""
    return figures.groupBy("page").agg(((F.max("n_text") == 0) & (F.count("*") == 1) & (F.max(F.col("area") / F.col("page_area")) >= 0.8)).alias("is_scan"))


def merge_ruled_tables(tables: DataFrame, gap: float = 10.0) -> DataFrame:
    """tables(page, id, x0, x1, y0, y1) -> page, x0, x1, y0, y1, n: tables under one another join where the gap is small and over half of the narrower overlaps."""
    w = W.partitionBy("page").orderBy("y0", "id")
    lag = lambda c: F.lag(c).over(w)
    overlap = F.least("x1", lag("x1")) - F.greatest("x0", lag("x0"))
    joined = (F.col("y0") - lag("y1") <= gap) & (overlap > 0.5 * F.least(F.col("x1") - F.col("x0"), lag("x1") - lag("x0")))
    t = by_key(tables, "page").withColumn("fresh", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("t", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return t.groupBy("page", "t").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("n")).drop("t")


def text_in_boxes(lines: DataFrame, boxes: DataFrame, margin: float = 0.0) -> DataFrame:
    """lines(page, id, x, y, text), boxes(page, box, x0, x1, y0, y1) -> page, box, texts by (y, x) of lines whose point is inside."""
    b = boxes.withColumnRenamed("page", "p")
    hit = lines.join(b, (F.col("page") == F.col("p")) & F.col("x").between(F.col("x0") - margin, F.col("x1") + margin) & F.col("y").between(F.col("y0") - margin, F.col("y1") + margin))
    return hit.groupBy("page", "box").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "id", "text"))), lambda s: s["text"]).alias("texts"))


def shape_clusters(shapes: DataFrame) -> DataFrame:
    """shapes(sheet, id, r1, r2) + cluster: one shape of 75 % of the span makes one cluster; else the first gap of two rows or more cuts in two, else all is one."""
    w = W.partitionBy("sheet").orderBy("r1", "r2", "id")
    reach = F.max("r2").over(w.rowsBetween(W.unboundedPreceding, -1))
    whole = W.partitionBy("sheet")
    span = F.max("r2").over(whole) - F.min("r1").over(whole) + 1
    cut = F.coalesce(F.col("r1") - F.col("reach") - 1 >= 2, F.lit(False))
    cuts = shapes.withColumn("reach", reach).withColumn("wide", F.max(F.col("r2") - F.col("r1") + 1).over(whole) >= 0.75 * span).withColumn("cut", cut)
    after = F.max(F.col("cut").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return cuts.withColumn("after", after).select("sheet", "id", "r1", "r2", F.when(F.col("wide"), 0).otherwise(F.col("after")).alias("cluster"))


def trim_unreadable(lines: DataFrame, readable: Column) -> DataFrame:
    """lines(doc, seq, ..) up to each document's last readable line."""
    w = W.partitionBy("doc")
    return lines.withColumn("_last", F.max(F.when(readable, F.col("seq"))).over(w)).where(F.col("seq") <= F.col("_last")).drop("_last")


def split_lines(projection: Column, gap: int = 5, line: int = 20, share: float = 0.05) -> Column:
    """Ink per pixel row -> array of struct(top, bottom): lines of `line` rows or more between gaps of `gap` rows or more with under `share` of the most ink."""
    n = F.size(projection)
    low = F.transform(projection, lambda x: x < share * F.array_max(projection))
    step = lambda acc, x: F.struct(
        F.when(x, acc["run"] + 1).otherwise(0).alias("run"),
        (acc["at"] + 1).alias("at"),
        F.when(~x & (acc["run"] >= gap), F.concat(acc["gaps"], F.array(F.struct((acc["at"] - acc["run"]).alias("a"), acc["at"].alias("b"))))).otherwise(acc["gaps"]).alias("gaps"),
    )
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("at"), F.lit([]).cast("array<struct<a:int,b:int>>").alias("gaps"))
    gaps = F.aggregate(low, start, step)["gaps"]
    # a line lies between the end of one gap and the start of the next
    edges = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(gaps, lambda g: g["b"])), F.concat(F.transform(gaps, lambda g: g["a"]), F.array(n)), lambda a, b: F.struct(a.alias("top"), b.alias("bottom")))
    kept = F.filter(edges, lambda s: s["bottom"] - s["top"] >= line)
    return F.when(F.size(kept) > 1, kept).otherwise(F.array(F.struct(F.lit(0).alias("top"), n.alias("bottom"))))


def is_plain_text(regions: DataFrame) -> DataFrame:
    """cells(region, row, col, value) -> region, is_text: rules on counts and lengths, in order; what none decides is a table."""
    full = regions.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    m = full.groupBy("region").agg(
        F.countDistinct("row").alias("rows"),
        F.countDistinct("col").alias("cols"),
        F.count("*").alias("n"),
        F.avg(F.length("value")).alias("mean"),
        F.avg(F.col("value").rlike(r"[\\/].*[\\/]").cast("double")).alias("paths"),
    )
    rule = F.when((F.col("rows") == 1) & (F.col("n") > 1), False).when(F.col("cols") == 1, True).when(F.col("paths") > 0.25, True).when((F.col("mean") > 60) & (F.col("rows") <= 8), True).otherwise(False)
    return m.select("region", rule.alias("is_text"))


def is_furniture(text: Column, norm: Column, patterns: Column, y: Column, height: Column) -> Column:
    """Page furniture: '-N-' anywhere, or a known pattern in the top 12 % or bottom 10 % of the page."""
    edge = (y < 0.12 * height) | (y > 0.9 * height)
    return F.trim(text).rlike(r"^[-－―]\s*\d+\s*[-－―]$") | (edge & F.array_contains(patterns, norm))
