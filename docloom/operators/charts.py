"""Charts: points (chart, series, pos, x or category, y) as Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import format_value


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _table(df: DataFrame, head: str) -> DataFrame:
    """df(chart, title, names, place, label, values) -> chart, md."""
    heading = F.concat(F.lit("### Chart"), F.when(F.coalesce("title", F.lit("")) == "", "").otherwise(F.concat(F.lit(": "), F.col("title"))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"])
    cells = df.withColumn("line", _row(F.concat(F.array("label"), F.col("values"))))
    top = _row(F.concat(F.array(F.lit(head)), F.first("names")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.first("names")) + 1))
    return cells.groupBy("chart").agg(F.array_join(F.concat(F.array(F.first(heading), F.lit(""), top, rule), lines), "\n").alias("md"))


def standard(points: DataFrame, head: str = "Category") -> DataFrame:
    """points(chart, title, series, pos, category, y): categories down, series across; a missing name is SeriesN, a missing category its number, a missing value empty."""
    named = points.withColumn("name", F.coalesce("series", F.concat(F.lit("Series"), F.col("series_no").cast("string"))))
    names = named.groupBy("chart").agg(F.array_sort(F.collect_set(F.struct("series_no", "name"))).alias("all"), F.first("title").alias("title"))
    rows = named.groupBy("chart", "pos").agg(F.coalesce(F.max("category"), (F.col("pos") + 1).cast("string")).alias("label"), F.map_from_entries(F.collect_set(F.struct("series_no", format_value(F.col("y")).alias("v")))).alias("by"))
    full = rows.join(names, "chart").select("chart", "title", F.transform("all", lambda s: s["name"]).alias("names"), F.col("pos").alias("place"), "label", F.transform("all", lambda s: F.coalesce(F.try_element_at("by", s["series_no"]), F.lit(""))).alias("values"))
    return _table(full, head)


def scatter(points: DataFrame, head: str = "X") -> DataFrame:
    """points(chart, title, series, series_no, pos, x, y): every x once, ascending; of repeated x in a series the first y counts."""
    first = points.groupBy("chart", "series_no", "x").agg(F.min_by("y", "pos").alias("y"), F.first("series").alias("series"), F.first("title").alias("title"))
    names = first.groupBy("chart").agg(F.array_sort(F.collect_set(F.struct("series_no", F.coalesce("series", F.concat(F.lit("Series"), F.col("series_no").cast("string"))).alias("name")))).alias("all"), F.first("title").alias("title"))
    rows = first.groupBy("chart", "x").agg(F.map_from_entries(F.collect_list(F.struct("series_no", format_value(F.col("y")).alias("v")))).alias("by"))
    full = rows.join(names, "chart").select("chart", "title", F.transform("all", lambda s: s["name"]).alias("names"), F.col("x").alias("place"), format_value(F.col("x")).alias("label"), F.transform("all", lambda s: F.coalesce(F.try_element_at("by", s["series_no"]), F.lit(""))).alias("values"))
    return _table(full, head)
