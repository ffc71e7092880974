"""Table regions of sheets, and blocks and boxes of pages: validity, splits, lists, clips and routes.

Every window and group is keyed by sheet, region or page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import cell_escape, markdown_table
from docloom.operators.grid import is_blank

UPTO = (W.unboundedPreceding, W.currentRow)


def valid_bordered(cells: DataFrame) -> DataFrame:
    """cells(sheet, row, col, value, merged) of bordered regions, one a sheet -> sheet, row_ratio, col_ratio, valid.

    Ratios are those of empty rows and columns: under half each. A small region
    with many merged cells and three columns of data may have more empty columns.
    """
    full = ~is_blank(F.col("value"))
    n_rows, n_cols = F.countDistinct("row"), F.countDistinct("col")
    data_cols = F.countDistinct(F.when(full, F.col("col")))
    found = cells.groupBy("sheet").agg(
        n_rows.alias("n_rows"),
        data_cols.alias("data_cols"),
        (1 - F.countDistinct(F.when(full, F.col("row"))) / n_rows).alias("row_ratio"),
        (1 - data_cols / n_cols).alias("col_ratio"),
        F.avg(F.col("merged").cast("int")).alias("merged"),
    )
    loose = (F.col("n_rows") <= 10) & (F.col("merged") > 0.3) & (F.col("data_cols") >= 3)
    valid = (F.col("row_ratio") < 0.5) & (F.col("col_ratio") < F.when(loose, 0.8).otherwise(0.5))
    return found.select("sheet", "row_ratio", "col_ratio", valid.alias("valid"))


def column_splits(cells: DataFrame, least: int = 9) -> DataFrame:
    """cells(sheet, col, value) -> sheet, split: the middle of each run of two empty columns or more, between columns with data.

    Sheets of fewer than `least` columns stay whole.
    """
    per = cells.groupBy("sheet", "col").agg(F.max((~is_blank(F.col("value"))).cast("int")).alias("full"))
    whole = W.partitionBy("sheet")
    data = F.when(F.col("full") == 1, F.col("col"))
    framed = per.select("sheet", "col", "full", F.min(data).over(whole).alias("c1"), F.max(data).over(whole).alias("c2"), F.count("*").over(whole).alias("n"))
    empty = framed.where((F.col("n") >= least) & (F.col("full") == 0) & F.col("col").between(F.col("c1"), F.col("c2")))
    run = empty.withColumn("k", F.col("col") - F.row_number().over(W.partitionBy("sheet").orderBy("col")))
    return run.groupBy("sheet", "k").agg(F.min("col").alias("a"), F.max("col").alias("b")).where("b > a").selectExpr("sheet", "cast((a + b) div 2 AS long) AS split")


def strong_regions(cells: DataFrame) -> DataFrame:
    """cells(sheet, row, value, strong) -> sheet, r1, r2: a row with data under a strong border (half its cells) opens a region; a row without data ends it."""
    rows = cells.groupBy("sheet", "row").agg(F.max((~is_blank(F.col("value"))).cast("int")).alias("full"), (F.avg(F.col("strong").cast("int")) >= 0.5).alias("strong"))
    w = W.partitionBy("sheet").orderBy("row")
    opens = (F.col("full") == 1) & F.col("strong")
    ids = rows.withColumn("opens", opens).withColumn("k", F.sum((opens | (F.col("full") == 0)).cast("int")).over(w.rowsBetween(*UPTO)))
    return ids.groupBy("sheet", "k").agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.max(F.col("opens").cast("int")).alias("own")).where("own = 1").select("sheet", "r1", "r2")


def trim_regions(cells: DataFrame, marks: str = "※|注意|注記|備考|説明") -> DataFrame:
    """cells(sheet, row, value, side) -> sheet, r1, r2: the rows with data that is no annotation, or with side borders; two rows or more."""
    data = ~is_blank(F.col("value")) & ~F.col("value").rlike(marks)
    return cells.where(data | F.col("side")).groupBy("sheet").agg(F.min("row").alias("r1"), F.max("row").alias("r2")).where("r2 > r1")


def headless_tables(cells: DataFrame, least: int = 2) -> DataFrame:
    """cells(sheet, row, col, value), a cell each -> sheet, md: columns with data (`least` or more), in order; rows without data and rows equal to the one before go."""
    whole = W.partitionBy("sheet")
    text = F.when(~is_blank(F.col("value")), F.trim("value"))
    columns = cells.where(text.isNotNull()).groupBy("sheet").agg(F.array_sort(F.collect_set("col")).alias("cols")).withColumnRenamed("sheet", "of")
    rows = cells.where(text.isNotNull()).groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", text.alias("text")))).alias("at"))
    # a cell that is not there at all is an empty one, wherever it is missing
    rows = rows.join(columns, F.col("sheet") == F.col("of")).where(F.size("cols") >= least).select("sheet", "row", F.transform("cols", lambda c: F.coalesce(F.try_element_at("at", c), F.lit(""))).alias("cells"))
    fresh = rows.withColumn("before", F.lag("cells").over(whole.orderBy("row"))).where("before IS NULL OR before <> cells")
    table = F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda s: F.transform(s["cells"], cell_escape))
    return fresh.groupBy("sheet").agg(markdown_table(table).alias("md"))


def join_list_items(blocks: DataFrame) -> DataFrame:
    """blocks(page, seq, x, y, kind, text) -> page, seq, kind, text: a text close under a list item (15 points) goes to it if indented (5..60) or short (8)."""
    w = W.partitionBy("page").orderBy("seq")
    near = F.col("y") - F.lag("y").over(w) <= 15
    item = F.col("kind") == "list_item"
    last_x = F.last(F.when(item, F.col("x")), True).over(w.rowsBetween(*UPTO))
    fits = (F.col("x") - last_x).between(5, 60) | (F.length("text") <= 8)
    follows = F.coalesce((F.col("kind") == "paragraph") & near & fits, F.lit(False))
    # a group is a block and what follows it; it joins only under a list item
    marked = blocks.withColumn("follows", follows).withColumn("k", F.sum((~F.col("follows")).cast("int")).over(w.rowsBetween(*UPTO)))
    head = F.first("kind").over(W.partitionBy("page", "k").orderBy("seq"))
    group = marked.withColumn("head", head).withColumn("part", F.when(F.col("head") == "list_item", F.lit(0)).otherwise(F.col("seq")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "text")))
    joined = group.groupBy("page", "k", "part").agg(parts.alias("parts"))
    return joined.select("page", F.col("parts")[0]["seq"].alias("seq"), F.col("parts")[0]["kind"].alias("kind"), F.array_join(F.transform("parts", lambda s: s["text"]), "").alias("text"))


def demote_headings(blocks: DataFrame, gap: float = 30.0, dx: float = 20.0) -> DataFrame:
    """blocks(page, seq, x, y, kind) + kind: headings that chain to a list item, down or up, by `gap` and `dx`, become list items."""
    w = W.partitionBy("page").orderBy("seq")
    own = F.col("kind").isin("heading", "list_item")
    linked = own & F.lag(own).over(w) & (F.col("y") - F.lag("y").over(w) <= gap) & (F.abs(F.col("x") - F.lag("x").over(w)) <= dx)
    chained = blocks.withColumn("k", F.sum((~F.coalesce(linked, F.lit(False))).cast("int")).over(w.rowsBetween(*UPTO)))
    listed = F.max((F.col("kind") == "list_item").cast("int")).over(W.partitionBy("page", "k")) == 1
    return chained.withColumn("kind", F.when(listed, F.lit("list_item")).otherwise(F.col("kind"))).drop("k")


def clip_boxes(boxes: DataFrame, lines: DataFrame, pad: float = 20.0, least: float = 50.0) -> DataFrame:
    """boxes(page, id, y0, y1), lines(page, y, kind) -> page, id, top, bottom.

    Padding ends 5 points short of the caption below and of the body line above; a clip is `least` high at least.
    """
    # captions and the lower edges of boxes from the bottom up, body lines and upper edges from the top down: the last one passed is the nearest
    def nearest(own: DataFrame, kind: str, edge: str, down: bool, name: str) -> DataFrame:
        marks = lines.where(F.col("kind") == kind).select("page", F.lit(None).alias("box"), "y", F.lit(0).alias("late"))
        both = marks.union(own.select("page", F.struct(*own.columns).alias("box"), F.col(edge), F.lit(1)))
        w = W.partitionBy("page").orderBy(F.col("y") if down else -F.col("y"), "late").rowsBetween(*UPTO)
        passed = F.last(F.when(F.col("late") == 0, F.col("y")), ignorenulls=True).over(w)
        return both.withColumn(name, passed).where("late = 1").select("box.*", name)

    found = nearest(nearest(boxes.select("page", "id", "y0", "y1"), "caption", "y1", False, "below"), "body", "y0", True, "above")
    top = F.greatest(F.col("y0") - pad, F.coalesce(F.col("above") + 5, F.col("y0") - pad), F.lit(0.0))
    bottom = F.least(F.col("y1") + pad, F.coalesce(F.col("below") - 5, F.col("y1") + pad))
    return found.select("page", "id", top.alias("top"), bottom.alias("end")).select("page", "id", "top", F.greatest(F.col("end"), F.col("top") + least).alias("bottom"))


def page_route(is_scan: Column, n_lines: Column, n_figures: Column) -> Column:
    """How a page is converted: a scan by its image and OCR, a page with text or figures by structure, else rendered and read."""
    return F.when(is_scan, "scan").when((n_lines > 0) | (n_figures > 0), "structured").otherwise("render")


def anchor_ranges(anchors: DataFrame) -> DataFrame:
    """anchors(sheet, id, row0, col0, row1, col1, adjust), from 0 -> r1, c1, r2, c2 from 1, both ends in; a callout that points up starts a row earlier."""
    up = F.when(F.col("adjust") < 0, 1).otherwise(0)
    return anchors.select("sheet", "id", F.greatest(F.col("row0") + 1 - up, F.lit(1)).cast("long").alias("r1"), (F.col("col0") + 1).cast("long").alias("c1"), (F.col("row1") + 1).cast("long").alias("r2"), (F.col("col1") + 1).cast("long").alias("c2"))


def shape_json(shapes: DataFrame) -> DataFrame:
    """shapes(sheet, id, name, kind, x, y, w, h, text) -> sheet, json: the sheet's shapes by id, nulls left out."""
    one = F.to_json(F.struct("id", "name", "kind", "x", "y", "w", "h", "text"))
    return shapes.select("sheet", "id", one.alias("one")).groupBy("sheet").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "one"))), lambda s: s["one"]), ","), F.lit("]")).alias("json"))


def language_of(env: Column) -> Column:
    """The label language of a locale: nothing, C and POSIX are Japanese, as is all but English."""
    first = F.lower(F.regexp_extract(F.coalesce(env, F.lit("")), r"^([A-Za-z]*)", 1))
    return F.when(first == "en", "en").otherwise("ja")


def combine_lines(regions: DataFrame, most: float = 10.0) -> DataFrame:
    """regions(page, seq, y, text), by seq (ties by y, text) -> page, text: regions within `most` of their line's first join by two spaces, lines by a blank line."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "y", "text")))

    def step(acc: Column, x: Column) -> Column:
        same = F.abs(x["y"] - acc["y"]) <= most
        return F.struct(F.when(same, acc["y"]).otherwise(x["y"]).alias("y"), F.concat(acc["text"], F.when(same, "  ").otherwise("\n\n"), x["text"]).alias("text"))

    found = regions.groupBy("page").agg(parts.alias("parts"))
    first = F.struct(F.col("parts")[0]["y"].alias("y"), F.col("parts")[0]["text"].alias("text"))
    return found.select("page", F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), first, step)["text"].alias("text"))
