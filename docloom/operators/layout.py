"""Page layout: operators over pages, images, lines and blocks with positions.

Every operator takes frames keyed by document and page; windows and groups run
over one page or one document, never over the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.session import by_key


def slide_documents(pages: DataFrame) -> DataFrame:
    """pages(doc, w, h) -> doc, is_slide: 90 % landscape, and sizes that hardly vary where there are two pages or more."""
    even = (F.count("*") < 2) | ((F.var_pop("w") <= 100) & (F.var_pop("h") <= 100))
    return pages.groupBy("doc").agg(((F.avg((F.col("w") > F.col("h")).cast("int")) >= 0.9) & even).alias("is_slide"))


def repeated_images(images: DataFrame, least: int = 5) -> DataFrame:
    """images(doc, page, xref, y, share) -> (doc, xref) of small images at the top of `least` pages or more."""
    return images.groupBy("doc", "xref").agg(F.countDistinct("page").alias("n_pages"), F.bool_and((F.col("y") < 70) & (F.col("share") < 0.02)).alias("small")).where((F.col("n_pages") >= least) & F.col("small")).select("doc", "xref", "n_pages")


def furniture_patterns(lines: DataFrame, least: int = 2) -> DataFrame:
    """lines(doc, page, norm) -> (doc, norm, n_pages) of what recurs on `least` pages or more."""
    return lines.groupBy("doc", "norm").agg(F.countDistinct("page").alias("n_pages")).where(F.col("n_pages") >= least)


def upper_median(values: Column) -> Column:
    """The value at index n // 2 of the sorted ones."""
    ordered = F.sort_array(F.collect_list(values))
    return F.get(ordered, (F.size(ordered) / 2).cast("int"))


def furniture_bands(bands: DataFrame) -> DataFrame:
    """bands(doc, page, header_y, footer_y) -> doc, header, footer: the pages' upper medians, 15 points into the page."""
    pages = bands.groupBy("doc", "page").agg((F.max("header_y") + 15).alias("h"), (F.min("footer_y") - 15).alias("f"))
    return pages.groupBy("doc").agg(upper_median(F.col("h")).alias("header"), upper_median(F.col("f")).alias("footer"))


def column_layout(lines: DataFrame, width: float = 600.0) -> DataFrame:
    """lines(page, x, w) -> page, n_columns: two where three wide lines or more stand clearly left, and three clearly right."""
    wide, centre = F.col("w") > 0.1 * width, width / 2
    counts = lines.groupBy("page").agg(F.count_if(wide).alias("n"), F.count_if(wide & (F.col("x") < 0.6 * centre)).alias("l"), F.count_if(wide & (F.col("x") > 0.8 * centre)).alias("r"))
    return counts.select("page", F.when((F.col("n") >= 5) & (F.col("l") >= 3) & (F.col("r") >= 3), 2).otherwise(1).alias("n_columns"))


def reading_order(lines: DataFrame) -> DataFrame:
    """lines(page, id, x, y, kind full|left|right) + place: full lines cut the page into bands; a band is read left, then right."""
    by_y = W.partitionBy("page").orderBy("y", "x", "id", "kind")
    upto = by_y.rowsBetween(W.unboundedPreceding, W.currentRow)
    full = F.col("kind") == "full"
    # a full line opens a band; it comes before the columns that follow it
    banded = by_key(lines, "page").withColumn("band", F.sum(full.cast("int")).over(upto)).withColumn("rank", F.when(full, 0).when(F.col("kind") == "left", 1).otherwise(2))
    return banded.withColumn("place", F.row_number().over(W.partitionBy("page").orderBy("band", "rank", "y", "x", "id"))).drop("rank")


def same_line(lines: DataFrame) -> DataFrame:
    """lines(page, id, x0, x1, y, size, text) -> page, row, part, text: neighbours in y chain to rows, neighbours in x join.

    Lines of equal x0 and id are read from the top, then by their ends, so the result doesn't hang on the order of the input.
    """
    down = W.partitionBy("page").orderBy("y", "x0", "id", "x1", "size", "text")
    gap = F.col("y") - F.lag("y").over(down)
    fresh = F.coalesce(gap > 0.5 * F.least("size", F.lag("size").over(down)), F.lit(True))
    rows = by_key(lines, "page").withColumn("row", F.sum(fresh.cast("int")).over(down.rowsBetween(W.unboundedPreceding, 0)))
    along = W.partitionBy("page", "row").orderBy("x0", "id", "y", "x1", "size", "text")
    apart = F.coalesce(F.col("x0") - F.lag("x1").over(along) > 1.5 * F.col("size"), F.lit(True))
    parts = rows.withColumn("part", F.sum(apart.cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "id", "text"))), lambda s: s["text"]), " ")
    return parts.groupBy("page", "row", "part").agg(joined.alias("text"))


def reflow(lines: DataFrame, base: float = 10.0) -> DataFrame:
    """lines(doc, seq, y, size, bold, col, marker, text) -> doc, block, text: a gap, a change of column, weight or size, or a list mark starts a block.

    Lines join with a space between ASCII letters and digits, else without.
    """
    w = W.partitionBy("doc").orderBy("seq")
    lag = lambda c: F.lag(c).over(w)
    fresh = F.coalesce((F.col("y") - lag("y") > 0.8 * 1.2 * base) | (F.col("col") != lag("col")) | (F.col("bold") != lag("bold")) | (F.abs(F.col("size") - lag("size")) > 1) | F.col("marker"), F.lit(True))
    blocks = lines.withColumn("block", F.sum(fresh.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))

    def join(a: Column, b: Column) -> Column:
        spaced = a.rlike("[A-Za-z0-9.,;:!?)]$") & b.rlike("^[A-Za-z0-9(]")
        return F.when(a == "", b).when(spaced, F.concat(a, F.lit(" "), b)).otherwise(F.concat(a, b))

    return blocks.groupBy("doc", "block").agg(F.aggregate(F.transform(ordered, lambda s: s["text"]), F.lit(""), join).alias("text"))


def list_levels(blocks: DataFrame) -> DataFrame:
    """blocks(doc, seq, marker) + level: circled and bracketed marks under numbered ones are one level down; other text ends a list."""
    w = W.partitionBy("doc").orderBy("seq")
    # the list a block is in starts after the last block that isn't an item
    run = F.sum(F.col("marker").isNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    parent = F.max(F.col("marker").isin("arabic", "fullwidth").cast("int")).over(W.partitionBy("doc", "run").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("run", run).withColumn("level", F.when(F.col("marker").isNull(), F.lit(None)).when(F.col("marker").isin("circled", "paren") & (F.coalesce(parent, F.lit(0)) == 1), 1).otherwise(0)).drop("run")


def text_tables(spans: DataFrame) -> DataFrame:
    """spans(page, x, y, text) -> page, top, bottom, n_rows: rows of three cells or more, within 50 points, two rows or more.

    y is rounded to 5 and x to 20, half to even.
    """
    cells = spans.select("page", (F.bround(F.col("y") / 5) * 5).alias("y"), (F.bround(F.col("x") / 20) * 20).alias("x"), F.length("text").alias("n"))
    rows = cells.groupBy("page", "y").agg(F.countDistinct("x").alias("xs"), F.max("n").alias("longest")).where((F.col("xs") >= 3) & (F.col("longest") > 3))
    w = W.partitionBy("page").orderBy("y")
    fresh = F.coalesce(F.col("y") - F.lag("y").over(w) >= 50, F.lit(True))
    tables = rows.withColumn("t", F.sum(fresh.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return tables.groupBy("page", "t").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.count("*").alias("n_rows")).where("n_rows >= 2").drop("t")


def join_pages(pages: DataFrame) -> DataFrame:
    """pages(doc, page, text) -> doc, text: a page that ends inside a sentence runs on into the next.

    A page's last line ends a sentence by its last character; a first line that
    opens a heading, list, table or quote never continues. ASCII letters and
    digits get a space between them; three line ends or more become two.
    """
    w = W.partitionBy("doc").orderBy("page")
    first = F.regexp_extract("text", r"^([^\n]*)", 1)
    before = F.regexp_extract(F.lag("text").over(w), r"([^\n]*)$", 1)
    runs_on = F.coalesce(~before.rlike("[.!?。．！？」）)]\\s*$") & (before != "") & ~first.rlike(r"^(?:#|[-*+] |\d+\. |\||>|$)"), F.lit(False))
    gap = F.when(~runs_on, "\n\n").when(before.rlike("[A-Za-z0-9]$") & first.rlike("^[A-Za-z0-9]"), " ").otherwise("")
    marked = pages.select("doc", "page", F.concat(F.when(F.row_number().over(w) == 1, "").otherwise(gap), F.col("text")).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "part"))), lambda s: s["part"]), "")
    return marked.groupBy("doc").agg(F.regexp_replace(whole, "\n{3,}", "\n\n").alias("text"))


def pair_captions(captions: DataFrame, boxes: DataFrame, most: float = 50.0) -> DataFrame:
    """captions(page, cid, x0, x1, y), boxes(page, bid, x0, x1, y0, y1) -> page, cid, bid: the nearest box above or below by less than `most`, 20 points of overlap in x."""
    c, b = captions.alias("c"), boxes.alias("b")
    overlap = F.least("c.x1", "b.x1") - F.greatest("c.x0", "b.x0")
    distance = F.least(F.abs(F.col("c.y") - F.col("b.y1")), F.abs(F.col("b.y0") - F.col("c.y")))
    near = c.join(b, F.col("c.page") == F.col("b.page")).where((overlap >= 20) & (distance < most)).select("c.page", "c.cid", "b.bid", distance.alias("d"))
    return near.groupBy("page", "cid").agg(F.min_by("bid", F.struct("d", "bid")).alias("bid"))
