"""Boxes: measures, removal of overlapping and contained ones, components, non-maximum suppression.

Pairs are joined by their group (a page or sheet) and the cells of a grid that
they reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.session import by_key, ship


def area(b: str = "") -> Column:
    p = f"{b}." if b else ""
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_area(a: str = "a", b: str = "b") -> Column:
    c = lambda t, n: F.col(f"{t}.{n}")
    return overlap_1d(c(a, "x0"), c(a, "x1"), c(b, "x0"), c(b, "x1")) * overlap_1d(c(a, "y0"), c(a, "y1"), c(b, "y0"), c(b, "y1"))


def contains(outer: str, inner: str, margin: float = 10.0) -> Column:
    o, i = (lambda n: F.col(f"{outer}.{n}")), (lambda n: F.col(f"{inner}.{n}"))
    return (i("x0") >= o("x0") - margin) & (i("y0") >= o("y0") - margin) & (i("x1") <= o("x1") + margin) & (i("y1") <= o("y1") + margin)


def touching(boxes: DataFrame, dx: float = 0.0, dy: float = 0.0, cell: float = 256.0) -> DataFrame:
    """Pairs a, b of different boxes of a group whose gaps are at most dx and dy, each way round; boxes(grp, id, x0, y0, x1, y1).

    Boxes meet in the cells of a grid that they reach, so a group of many boxes
    costs what lies near each other; of all cells that two share, the pair
    comes from that of their upper left corner.
    """
    at = lambda x: F.floor(x / cell)
    low = lambda t, n, d: F.col(f"{t}{n}0") - d / 2
    own = boxes.select("*", F.explode(F.sequence(at(low("", "x", dx)), at(F.col("x1") + dx / 2))).alias("cx")).select("*", F.explode(F.sequence(at(low("", "y", dy)), at(F.col("y1") + dy / 2))).alias("cy"))
    corner = (F.col("a.cx") == at(F.greatest(low("a.", "x", dx), low("b.", "x", dx)))) & (F.col("a.cy") == at(F.greatest(low("a.", "y", dy), low("b.", "y", dy))))
    same = (F.col("a.grp") == F.col("b.grp")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    return own.alias("a").join(own.alias("b"), same & (F.col("a.id") != F.col("b.id")) & corner)


def measures(boxes: DataFrame, margin: float = 10.0) -> DataFrame:
    """Per pair id < other whose gaps are at most `margin`: share of the smaller area, of the shorter side in x and y, and whether one contains the other."""
    both = touching(boxes, margin, margin).where("a.id < b.id")
    side = lambda t, n: F.col(f"{t}.{n}1") - F.col(f"{t}.{n}0")
    gap = lambda n: F.greatest(F.col(f"a.{n}0"), F.col(f"b.{n}0")) - F.least(F.col(f"a.{n}1"), F.col(f"b.{n}1"))
    share = lambda n: overlap_1d(F.col(f"a.{n}0"), F.col(f"a.{n}1"), F.col(f"b.{n}0"), F.col(f"b.{n}1")) / F.nullif(F.least(side("a", n), side("b", n)), F.lit(0.0))
    return both.where((gap("x") <= margin) & (gap("y") <= margin)).select(
        F.col("a.grp").alias("grp"),
        F.col("a.id").alias("id"),
        F.col("b.id").alias("other"),
        F.round(overlap_area() / F.nullif(F.least(area("a"), area("b")), F.lit(0.0)), 6).alias("share"),
        F.round(share("x"), 6).alias("share_x"),
        F.round(share("y"), 6).alias("share_y"),
        (contains("a", "b", margin) | contains("b", "a", margin)).alias("nested"),
    )


def _without(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """boxes without the a of pairs; an id may stand on several boxes, so its place tells which of them is meant."""
    names = ["grp", "id", "x0", "y0", "x1", "y1"]
    lost = pairs.select(*[F.col(f"a.{n}").alias(f"_{n}") for n in names]).distinct()
    same = F.lit(True)
    for n in names:
        same = same & (F.col(n) == F.col(f"_{n}"))
    return boxes.join(lost, same, "left_anti")


def drop_contained(boxes: DataFrame, margin: float = 10.0) -> DataFrame:
    """Without boxes inside a larger one (of equal ones the lesser id stays)."""
    larger = (area("b") > area("a")) | ((area("b") == area("a")) & (F.col("b.id") < F.col("a.id")))
    return _without(boxes, touching(boxes, margin, margin).where(contains("b", "a", margin) & larger))


def drop_overlapping(boxes: DataFrame, most: float = 0.5) -> DataFrame:
    """Of two boxes that share `most` of the smaller or more, the larger stays (the first on a tie)."""
    larger = (area("b") > area("a")) | ((area("b") == area("a")) & (F.col("b.id") < F.col("a.id")))
    return _without(boxes, touching(boxes).where((overlap_area() >= most * F.least(area("a"), area("b"))) & (overlap_area() > 0) & larger))


def near_edges(boxes: DataFrame, dx: float = 100.0, dy: float = 40.0) -> DataFrame:
    """(grp, a, b), a < b: boxes whose gaps are at most dx and dy."""
    gap = lambda n: F.greatest(F.col(f"a.{n}0"), F.col(f"b.{n}0")) - F.least(F.col(f"a.{n}1"), F.col(f"b.{n}1"))
    return touching(boxes, dx, dy).where((F.col("a.id") < F.col("b.id")) & (gap("x") <= dx) & (gap("y") <= dy)).select(F.col("a.grp").alias("grp"), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def per_group(df: DataFrame, key: str, order: list[str], fn: Callable[[list[tuple]], list[tuple]], schema: T.StructType) -> DataFrame:
    """fn over the rows of each group, sorted by `order`: one shuffle, then a stream of batches that holds one group at a time.

    For groups that are pages or sheets; far less per group than a grouped pandas call.
    """
    at, names = df.columns.index(key), schema.names
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][at] != row[at]:
                    out += fn(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], names=names)
        if held and (out := fn(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], names=names)

    ship(df.sparkSession)
    return by_key(df, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def components(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """boxes' (grp, id), each once, + root, the least id reachable inside the group."""
    both = boxes.select("grp", "id", F.lit(None).cast(boxes.schema["id"].dataType).alias("to")).unionByName(edges.select("grp", F.col("a").alias("id"), F.col("b").alias("to")))

    def run(rows: list[tuple]) -> list[tuple]:
        up = {i: i for _, i, to in rows if to is None}

        def find(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for _, a, b in rows:
            if b is not None:
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        return [(rows[0][0], i, find(i)) for i in up]

    schema = T.StructType([boxes.schema["grp"], boxes.schema["id"], T.StructField("root", boxes.schema["id"].dataType)])
    return per_group(both, "grp", ["to", "id"], run, schema)


def nms(boxes: DataFrame, most: float = 0.35) -> DataFrame:
    """boxes(grp, id, x0, y0, x1, y1, score): greedily by score (then id), a box stays if it overlaps no kept one by more than `most` of their union."""
    names = ["grp", "id", "x0", "y0", "x1", "y1", "score"]
    own = boxes.select(*names, (-F.col("score")).alias("down"))

    def run(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for r in rows:
            _, _, x0, y0, x1, y1, _, _ = r
            for k in kept:
                both = max(0.0, min(x1, k[4]) - max(x0, k[2])) * max(0.0, min(y1, k[5]) - max(y0, k[3]))
                if both / ((x1 - x0) * (y1 - y0) + (k[4] - k[2]) * (k[5] - k[3]) - both + 1e-9) > most:
                    break
            else:
                kept.append(r)
        return [k[:7] for k in kept]

    return per_group(own, "grp", ["down", "id"], run, T.StructType([boxes.schema[n] for n in names]))
