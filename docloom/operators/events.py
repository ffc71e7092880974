"""Event streams of word-processor files: sections, tables, columns, continuation rows, body font, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sections(events: DataFrame) -> DataFrame:
    """events(doc, seq, kind, ..) + section: a new one after each SECTION_END."""
    w = W.partitionBy("doc").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("section", F.coalesce(F.sum((F.col("kind") == "SECTION_END").cast("int")).over(w), F.lit(0)).cast("long"))


def table_islands(events: DataFrame) -> DataFrame:
    """events(doc, section, kind, rulers) -> doc, section, table: consecutive sections with a ruled paragraph form a table."""
    s = events.groupBy("doc", "section").agg(F.bool_or((F.col("kind") == "PARA") & (F.col("rulers") >= 1)).alias("ruled")).where("ruled")
    island = F.col("section") - F.row_number().over(W.partitionBy("doc").orderBy("section"))
    first = F.min("section").over(W.partitionBy("doc", "island"))
    return s.withColumn("island", island).select("doc", "section", first.alias("table"))


def place_cells(cells: DataFrame) -> DataFrame:
    """cells(tbl, row, seq, start, text) -> tbl, row, slot, text: slots are the starts in order that the first row of most... a cell goes to the slot of equal start, else the nearest (the first of equals); texts in one slot join by a space.

    Slots are the distinct starts of cells flagged `head`.
    """
    slots = cells.where("head").select(F.col("tbl").alias("t"), F.col("start").alias("at")).distinct().groupBy("t").agg(F.array_sort(F.collect_set("at")).alias("slots"))
    j = cells.join(slots, cells.tbl == slots.t)
    nearest = F.array_min(F.transform("slots", lambda x, i: F.struct(F.abs(x - F.col("start")).alias("d"), i.alias("i"))))["i"]
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ")
    return j.select("tbl", "row", "seq", "text", (nearest + 1).cast("long").alias("slot")).groupBy("tbl", "row", "slot").agg(texts.alias("text"))


def merge_continuations(rows: DataFrame) -> DataFrame:
    """rows(tbl, row, cells array<string>) -> tbl, rows: a row joins the one before unless some column has text in both.

    The fold runs over one table's rows in order.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda s: s["cells"])
    start = F.lit([]).cast("array<array<string>>")

    def step(acc: Column, row: Column) -> Column:
        last = F.element_at(acc, -1)
        clash = F.exists(F.zip_with(last, row, lambda a, b: (a != "") & (b != "")), lambda x: x)
        joined = F.zip_with(last, row, lambda a, b: F.concat(a, b))
        return F.when((F.size(acc) == 0) | clash, F.concat(acc, F.array(row))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))

    return rows.groupBy("tbl").agg(F.aggregate(ordered, start, lambda a, r: F.when(F.size(a) == 0, F.array(r)).otherwise(step(a, r))).alias("rows"))


def body_font(lines: DataFrame) -> DataFrame:
    """lines(doc, seq, font, text) -> doc, body_font: the commonest font over 0 of lines with text, the first seen of equals; 0 if none."""
    counted = lines.where((F.trim("text") != "") & (F.col("font") > 0)).groupBy("doc", "font").agg(F.count("*").alias("n"), F.min("seq").alias("seen"))
    best = counted.groupBy("doc").agg(F.max_by("font", F.struct("n", -F.col("seen"))).alias("font"))
    return lines.select("doc").distinct().join(best, "doc", "left").select("doc", F.coalesce("font", F.lit(0)).cast("long").alias("body_font"))


def heading_or_bold(font: Column, body: Column) -> Column:
    """'heading' for a font over the body's, 'bold' for font 0, else ''; '' where the body has no font."""
    return F.when(body <= 0, "").when(font > body, "heading").when(font == 0, "bold").otherwise("")


def chapter_numbers(headings: DataFrame, levels: int = 4) -> DataFrame:
    """headings(doc, seq, level) + number like 2.1.3: a counter per level, deeper ones start anew, missing parents count as 1."""
    w = W.partitionBy("doc").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    out, counters, part = headings, [], ["doc"]
    for k in range(1, levels + 1):
        own = (F.col("level") == k).cast("int")
        span = W.partitionBy(*part).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn(f"_c{k}", F.sum(own).over(span))
        # what is at this level or above starts the deeper counters anew
        out = out.withColumn(f"_g{k}", F.sum((F.col("level") <= k).cast("int")).over(w))
        part = ["doc", *[f"_g{i}" for i in range(1, k + 1)]]
        counters.append(F.when(F.col("level") >= k, F.when(F.col("level") == k, F.col(f"_c{k}")).otherwise(F.greatest(F.col(f"_c{k}"), F.lit(1)))))
    number = F.array_join(F.array_compact(F.array(*[c.cast("string") for c in counters])), ".")
    return out.withColumn("number", number).drop(*[f"_{x}{k}" for x in "cg" for k in range(1, levels + 1)])


def chapter_map(headings: DataFrame) -> DataFrame:
    """headings(doc, seq, number, anchor) -> doc, ref, anchor: 'N', 'N章', '第N章', 'N節', '(N)'; of equal refs the last heading counts."""
    n = F.col("number")
    refs = F.array(n, F.concat(n, F.lit("章")), F.concat(F.lit("第"), n, F.lit("章")), F.concat(n, F.lit("節")), F.concat(F.lit("("), n, F.lit(")")))
    return headings.select("doc", "seq", "anchor", F.explode(refs).alias("ref")).groupBy("doc", "ref").agg(F.max_by("anchor", "seq").alias("anchor"))


def link_chapters(paragraphs: DataFrame, mapping: DataFrame) -> DataFrame:
    """paragraphs(doc, seq, text) with references (第N章, N章, N節) that the map knows as links.

    References are joined to the map one by one, so no row holds the whole map of a document.
    """
    pattern = r"(第\d+(?:\.\d+)*章|(?<![第\d.])\d+(?:\.\d+)*[章節])"
    hits, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.split("text", pattern, -1)
    found = paragraphs.select("doc", "seq", F.explode(F.array_distinct(hits)).alias("ref")).join(mapping, ["doc", "ref"])
    known = found.groupBy("doc", "seq").agg(F.map_from_entries(F.collect_set(F.struct("ref", "anchor"))).alias("known")).withColumnsRenamed({"doc": "d", "seq": "s"})
    link = lambda x: F.coalesce(F.concat(F.lit("["), x, F.lit("](#"), F.try_element_at("known", x), F.lit(")")), x)
    j = paragraphs.join(known, (paragraphs.doc == F.col("d")) & paragraphs.seq.eqNullSafe(F.col("s")), "left").withColumn("_h", hits).withColumn("_g", gaps)
    whole = F.array_join(F.concat(F.slice("_g", 1, 1), F.transform("_h", lambda x, i: F.concat(link(x), F.get("_g", i + 1)))), "")
    return j.select("doc", "seq", F.when(F.col("known").isNull(), F.col("text")).otherwise(whole).alias("text"))


def contents(headings: DataFrame) -> DataFrame:
    """headings(doc, seq, level, text, anchor) -> doc, toc: an indented list of links in order."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- ["), F.col("text"), F.lit("](#"), F.col("anchor"), F.lit(")"))
    return headings.withColumn("line", line).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]), "\n").alias("toc"))


def unseen_boxes(boxes: DataFrame, emitted: DataFrame) -> DataFrame:
    """boxes(doc, id, text) without those whose text holds, or is held by, an emitted(doc, text) of the document."""
    e = emitted.select(F.col("doc").alias("d"), F.col("text").alias("t"))
    same = (F.col("doc") == F.col("d")) & (F.contains("text", "t") | F.contains("t", "text"))
    return boxes.join(e, same, "left_anti")


def first_of_equal(images: DataFrame) -> DataFrame:
    """images(doc, id, content) -> doc, id, keep: the least id of equal content in the document."""
    digest = F.sha2(F.col("content").cast("binary"), 256)
    keep = images.select("doc", digest.alias("digest"), "id").groupBy("doc", "digest").agg(F.min("id").alias("keep"))
    return images.select("doc", "id", digest.alias("digest")).join(keep, ["doc", "digest"]).select("doc", "id", "keep")


def shape_order(shapes: DataFrame) -> DataFrame:
    """shapes(slide, id, top, left) + place: by top, then left, nulls last."""
    order = [F.col("top").asc_nulls_last(), F.col("left").asc_nulls_last(), F.col("id")]
    return shapes.withColumn("place", F.row_number().over(W.partitionBy("slide").orderBy(*order)))


def slide_flags(shapes: DataFrame, small: int = 540_000) -> DataFrame:
    """shapes(slide, kind, w, h) -> slide, has_text, has_table, has_chart, has_shape; shapes small both ways don't count."""
    f = lambda cond, name: F.bool_or(cond).alias(name)
    k = F.col("kind")
    return shapes.groupBy("slide").agg(f(k.isin("text", "auto"), "has_text"), f(k == "table", "has_table"), f(k == "chart", "has_chart"), f(k.isin("auto", "picture") & ~((F.col("w") <= small) & (F.col("h") <= small)), "has_shape"))


def slide_titles(shapes: DataFrame) -> DataFrame:
    """shapes(slide, z, text, is_title) -> slide, title: the title placeholder's text, else the first text."""
    own = F.min_by("text", F.when(F.col("is_title"), F.col("z")))
    any_ = F.min_by("text", F.when(F.col("text").isNotNull(), F.col("z")))
    return shapes.groupBy("slide").agg(F.coalesce(F.when(F.bool_or("is_title"), own), any_).alias("title"))


def region_order(regions: DataFrame) -> DataFrame:
    """regions(page, id, x, y, w, h, vertical) + place: mostly vertical pages right to left, others by lines of half the upper median height, then x."""
    heights = F.sort_array(F.collect_list("h"))
    page = regions.groupBy("page").agg(F.get(heights, (F.size(heights) / 2).cast("int")).alias("mid"), (F.count_if("vertical") > F.count("*") / 2).alias("upright")).withColumnRenamed("page", "p")
    j = regions.join(page, regions.page == page.p).drop("p")
    line = F.floor((F.col("y") + F.col("h") / 2) / (0.5 * F.col("mid")))
    keys = [F.when(F.col("upright"), -F.col("x")).otherwise(line.cast("double")), F.when(F.col("upright"), F.col("y")).otherwise(F.col("x")), F.col("id")]
    return j.withColumn("place", F.row_number().over(W.partitionBy("page").orderBy(*keys))).select("page", "id", "place")
