"""Sheets as cells: bounds, runs, densities, merged cells, ranges, titles, headers, emission order.

Cells are rows (sheet, row, col, value, ...); every window runs over one sheet,
one row of a sheet, or one region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def data_bounds(cells: DataFrame) -> DataFrame:
    """cells(sheet, row, col, value, styled) -> sheet, r1, r2, c1, c2 over cells with a value or a style."""
    return cells.where(~is_blank(F.col("value")) | F.col("styled")).groupBy("sheet").agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("col").alias("c1"), F.max("col").alias("c2"))


def row_runs(cells: DataFrame, least_rows: int = 3, least_cells: int = 2) -> DataFrame:
    """Runs of `least_rows` rows or more that hold `least_cells` values or more -> sheet, r1, r2, c1, c2."""
    rows = cells.where(~is_blank(F.col("value"))).groupBy("sheet", "row").agg(F.countDistinct("col").alias("n"), F.min("col").alias("c1"), F.max("col").alias("c2")).where(F.col("n") >= least_cells)
    island = F.col("row") - F.row_number().over(W.partitionBy("sheet").orderBy("row"))
    runs = rows.withColumn("island", island).groupBy("sheet", "island").agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("c1").alias("c1"), F.max("c2").alias("c2"))
    return runs.where(F.col("r2") - F.col("r1") + 1 >= least_rows).drop("island")


def colon_lists(cells: DataFrame) -> DataFrame:
    """sheet, n_rows, colon_rows, is_list: half of the rows or more hold a lone colon."""
    rows = cells.groupBy("sheet", "row").agg(F.bool_or(F.trim("value").isin(":", "：")).alias("colon"))
    return rows.groupBy("sheet").agg(F.count("*").alias("n_rows"), F.count_if("colon").alias("colon_rows")).withColumn("is_list", F.col("colon_rows") >= 0.5 * F.col("n_rows"))


def density(cells: DataFrame) -> DataFrame:
    """Per sheet and column: cells, share of values, share of bordered ones; cells(.., border)."""
    return cells.groupBy("sheet", "col").agg(F.count("*").alias("n"), F.avg((~is_blank(F.col("value"))).cast("int")).alias("filled"), F.avg(F.col("border").cast("int")).alias("bordered"))


def expand_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Blank cells inside a merged range get the value of its first cell; merges(sheet, r1, r2, c1, c2).

    Ranges of a sheet never overlap, so each is spread over its cells and met by
    equality instead of a range join.
    """
    m = merges.select("sheet", "r1", "c1", F.explode(F.sequence("r1", "r2")).alias("row"), "c2").select("sheet", "r1", "c1", "row", F.explode(F.sequence("c1", "c2")).alias("col"))
    masters = cells.select(F.col("sheet").alias("s"), F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("master"))
    known = m.join(masters, (m.sheet == F.col("s")) & (m.r1 == F.col("r")) & (m.c1 == F.col("c"))).select(m.sheet.alias("s2"), m.row.alias("row2"), m.col.alias("col2"), "master")
    joined = cells.join(known, (cells.sheet == F.col("s2")) & (cells.row == F.col("row2")) & (cells.col == F.col("col2")), "left")
    return joined.select(cells.sheet, cells.row, cells.col, F.when(is_blank(cells.value), F.coalesce("master", cells.value)).otherwise(cells.value).alias("value"))


RANGE = r"^'?(.*?)'?!?[$]?([A-Z]+)[$]?(\d+)(?:[:][$]?([A-Z]+)[$]?(\d+))?$"


def parse_range(ref: Column) -> Column:
    """struct(sheet, r1, r2, c1, c2) of a reference like Sheet!$A$1:$B$5."""
    from docloom.functions.text import col_index

    g = lambda k: F.regexp_extract(ref, RANGE, k)
    last_col, last_row = F.when(g(4) == "", g(2)).otherwise(g(4)), F.when(g(5) == "", g(3)).otherwise(g(5))
    return F.struct(g(1).alias("sheet"), g(3).cast("long").alias("r1"), last_row.cast("long").alias("r2"), col_index(g(2)).alias("c1"), col_index(last_col).alias("c2"))


def resolve_ranges(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """refs(ref_id, sheet, r1, r2, c1, c2) -> ref_id, values in row-major order."""
    hit = cells.join(refs, (cells.sheet == refs.sheet) & cells.row.between(refs.r1, refs.r2) & cells.col.between(refs.c1, refs.c2))
    return hit.groupBy("ref_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), lambda s: s["value"]).alias("values"))


def best_titles(regions: DataFrame, texts: DataFrame, above: int = 10, inside: int = 5) -> DataFrame:
    """regions(sheet, region, r1), texts(sheet, row, text, bold) -> sheet, region, title.

    Candidates stand up to 10 rows above or 5 inside; just above comes first,
    then bold, then above, then short, then near.
    """
    t = texts.select(F.col("sheet").alias("s"), "row", "text", "bold")
    near = regions.join(t, (F.col("sheet") == F.col("s")) & F.col("row").between(F.col("r1") - above, F.col("r1") + inside - 1))
    rank = F.struct((F.col("row") != F.col("r1") - 1).cast("int"), (~F.col("bold")).cast("int"), (F.col("row") >= F.col("r1")).cast("int"), F.length("text"), F.abs(F.col("r1") - F.col("row")), F.col("row"), F.col("text"))
    return near.groupBy("sheet", "region").agg(F.min_by("text", rank).alias("title"))


def best_headers(rows: DataFrame, most_height: int = 3) -> DataFrame:
    """rows(sheet, row, start, borders, filled) -> sheet, header_row, height: of start-2..start+2 and heights 1..3 the one with the most borders, then values, then the topmost and lowest."""
    near = rows.where(F.col("row").between(F.col("start") - 2, F.col("start") + 2))
    tall = near.select("sheet", "row", "start", F.explode(F.sequence(F.lit(1), F.lit(most_height))).alias("height"))
    part = rows.select(F.col("sheet").alias("s"), F.col("row").alias("r"), "borders", "filled")
    group = tall.join(part, (F.col("sheet") == F.col("s")) & F.col("r").between(F.col("row"), F.col("row") + F.col("height") - 1))
    score = group.groupBy("sheet", "row", "start", "height").agg((F.avg("borders") + 0.5 * F.max(F.when(F.col("r") == F.col("row"), F.col("borders")).otherwise(0.0))).alias("b"), F.avg("filled").alias("f"))
    best = F.max_by(F.struct("row", "height"), F.struct(F.round("b", 9), F.round("f", 9), -F.col("row"), -F.col("height")))
    return score.groupBy("sheet").agg(best.alias("best")).select("sheet", F.col("best.row").alias("header_row"), F.col("best.height").alias("height"))


def column_priority(columns: DataFrame) -> DataFrame:
    """cells(region, grp, col, value) -> region, grp, col of the column with most distinct values, then the least share of its commonest, then most values."""
    counts = columns.where(~is_blank(F.col("value"))).groupBy("region", "grp", "col", "value").agg(F.count("*").alias("k"))
    profile = counts.groupBy("region", "grp", "col").agg(F.count("*").alias("n_distinct"), F.max("k").alias("top"), F.sum("k").alias("n"))
    rank = F.struct(F.col("n_distinct"), -F.round(F.col("top") / F.col("n"), 9), F.col("n"), -F.col("col"))
    return profile.groupBy("region", "grp").agg(F.max_by("col", rank).alias("col"))


def emit_rows(texts: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """texts(sheet, row, md), tables(sheet, row, last_row, md), images(sheet, row, md) -> sheet, place, md.

    At a row: text, then table, then image. Text in a table's rows goes, and so do repeats of a text.
    """
    covered = tables.select("sheet", F.explode(F.sequence("row", "last_row")).alias("row")).distinct()
    free = texts.join(covered, ["sheet", "row"], "left_anti")
    once = free.withColumn("k", F.row_number().over(W.partitionBy("sheet", "md").orderBy("row"))).where("k = 1")
    kind = lambda df, rank: df.select("sheet", "row", F.lit(rank).alias("rank"), "md")
    every = kind(once, 0).unionByName(kind(tables, 1)).unionByName(kind(images, 2))
    return every.select("sheet", F.row_number().over(W.partitionBy("sheet").orderBy("row", "rank", "md")).alias("place"), "md")


def pixel_edges(sizes: DataFrame, dpi: int = 300) -> DataFrame:
    """sizes(sheet, col, width) -> left and right edges in pixels; a missing width is 8.43 characters of 7 pixels at 96 dpi."""
    pixels = F.coalesce("width", F.lit(8.43)) * 7 * dpi / 96
    w = W.partitionBy("sheet").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    return sizes.select("sheet", "col", F.round(F.sum(pixels).over(w) - pixels, 4).alias("left"), F.round(F.sum(pixels).over(w), 4).alias("right"))


def drop_repeated_rows(rows: DataFrame) -> DataFrame:
    """rows(region, row, cells) without rows equal to the one before."""
    before = F.lag("cells").over(W.partitionBy("region").orderBy("row"))
    return rows.withColumn("_same", F.coalesce(F.col("cells") == before, F.lit(False))).where("not _same").drop("_same")
