"""Order-dependent searches on hand-made cases."""

import random

from pyspark.sql import functions as F

from docloom.operators import regions as R


def test_bordered():
    grid = [(r, c, f"{r}{c}", True, r == 1) for r in (1, 2, 3) for c in (2, 3, 4)] + [(7, 1, "x", True, True), (7, 2, "y", False, True)]
    assert R.bordered(grid) == [(1, 3, 2, 4)]
    assert R.bordered([(r, c, None, True, True) for r in (1, 2) for c in (1, 2)]) == []


def test_discrete():
    cells = [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "d"), (4, 1, "alone"), (1, 5, "p"), (1, 6, " "), (2, 5, "q"), (2, 6, "r")]
    assert R.discrete(cells) == [(1, 2, 1, 2), (1, 2, 5, 6)]


def test_superscripts(spark):
    rows = [(1, 1, 0.0, 50.0, 10.0, 10.0, "word"), (1, 2, 52.0, 56.0, 8.0, 5.0, "2"), (1, 3, 200.0, 210.0, 10.0, 5.0, "far")]
    got = R.superscripts(spark.createDataFrame(rows, "page int, id int, x0 double, x1 double, y double, size double, text string"), 10.0)
    assert {(r.id, r.text) for r in got.collect()} == {(1, "word<sup>2</sup>"), (3, "far")}


def test_split_lines(spark):
    ink = [9.0] * 30 + [0.0] * 6 + [9.0] * 30 + [0.0] * 3 + [9.0] * 20 + [0.0] * 10
    got = spark.createDataFrame([(ink,), ([1.0] * 10,), ([0.0] * 40,)], "p array<double>").select(R.split_lines(F.col("p")).alias("l")).collect()
    assert [tuple(x) for x in got[0].l] == [(0, 30), (36, 99)]
    assert [[tuple(x) for x in r.l] for r in got[1:]] == [[(0, 10)], [(0, 40)]]


def test_closure_against_search(spark):
    random.seed(5)
    links = [(g, random.randrange(30), random.randrange(30)) for g in range(4) for _ in range(20)]
    want = set()
    for g in range(4):
        seen, todo = {0}, [0]
        while todo:
            x = todo.pop()
            for h, a, b in links:
                if h == g and x in (a, b):
                    y = b if a == x else a
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        want |= {(g, x) for x in seen}
    got = R.connector_closure(spark.createDataFrame(links, "sheet int, a int, b int"), spark.createDataFrame([(g, 0) for g in range(4)], "sheet int, id int"))
    assert {(r.sheet, r.id) for r in got.collect()} == want
