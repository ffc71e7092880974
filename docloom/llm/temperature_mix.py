"""Mixing sources to target weights by temperature; DataFrame functions only.

With p the token shares of the sources, the mixture is w ~ p^a, 0 <= a <= 1:
a = 1 leaves the corpus as it is, a = 0 makes the sources even. Entropy and
repeats fall as a grows. Bisection finds the least a at which the entropy of w
has come down to `entropy` times that of even sources and no source repeats
more than `max_repeat` times to fill its share of the budget; a corpus that is
more even than asked for stays as it is (a = 1).

Weights become draws by block permutations: a source's documents are dealt by
hash to blocks, blocks are ordered by hash, and so are documents in a block.
A source's share of the budget is so many whole passes and a part of one; the
part takes blocks in order, and documents of the last block in order, until
the next document would go over it.

Scale: aggregations to the sources and to blocks of about `block_tokens`; the
windows run over the documents of a block, the SHELF blocks of a shelf, and the
shelves of a source (20,000 for a source of 8e12 tokens). Five halvings are
looked at in one job: a step reads the written per-source table at 31 exponents,
and only those 31 rows reach the driver.

Nulls and odd cases: null text has no token; a null source is a source of its
own; documents without tokens are drawn as often as their source makes whole
passes (never more than that); repeated rows are dealt as one unit and so drawn
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import materialise, require, text_or_empty

WORDS = r"[^\x20\x09-\x0D]+"
SHELF = 4096


def count_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORDS)).cast("long")


def solve_exponent(sources: DataFrame, total: int, budget: float, entropy: float, max_repeat: float, passes: int = 8) -> float:
    """The least exponent in [0, 1] with entropy <= entropy * ln(number of sources) and repeats <= max_repeat; 1 if none."""
    p = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))
    low, high = 0.0, 1.0
    for _ in range(passes):
        grid = [low + (high - low) * i / 32 for i in range(1, 32)]
        a = F.col("a")
        at = p.select("p", F.explode(F.array(*[F.lit(x) for x in grid])).alias("a"))
        rows = (
            at.groupBy("a")
            .agg(F.sum(F.pow("p", a)).alias("z"), F.sum(F.pow("p", a) * F.ln("p")).alias("s"), F.max(F.pow("p", a - 1)).alias("m"), F.count("*").alias("n"))
            .collect()
        )  # 31 rows
        good = [r.a for r in rows if math.log(r.z) - r.a * r.s / r.z <= entropy * math.log(r.n) + 1e-12 and budget / total * r.m / r.z <= max_repeat]
        bad = [r.a for r in rows if r.a not in set(good)]
        low, high = max([low, *bad]), min([high, *(x for x in good if x > max([low, *bad]))])
    return high


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float | None = None, entropy: float = 0.95, max_repeat: float = 4.0, seed: int = 7, block_tokens: int = 100_000, tokens_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, n_tokens, exponent, weight, block, place, copies.

    budget: tokens to draw; the corpus's own number if None. tokens_col: a column
    with each document's tokens by some tokenizer; else its words count, as SQL
    functions have no tokenizer. copies counts the
    draws of the document; (block, place) is its place in its source's order.
    """
    require(docs, id_col, source_col, tokens_col or text_col)
    counted = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)) if tokens_col else count_words(F.col(text_col))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("source_key"), counted.alias("n_tokens"))
    # ties of the first hash are settled by the second and the id; rows that are alike in all three are one unit
    rows = materialise(rows, "mix-rows")
    sources = materialise(rows.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens")), "mix-sources", narrow=True)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        z = F.lit(0).cast("long")
        return rows.select("doc_id", "source", "n_tokens", F.lit(1.0).alias("exponent"), F.lit(0.0).alias("weight"), z.alias("block"), z.alias("place"), F.lit(1).cast("long").alias("copies"))
    spend = float(total if budget is None else budget)
    a = solve_exponent(sources, total, spend, entropy, max_repeat)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))).otherwise(0.0)
    norm = sources.select(F.sum(power)).first()[0]
    weight = F.round(power / F.lit(norm), 12)
    share = F.round(weight * F.lit(spend)).cast("long")
    passes = F.when(F.col("tokens") > 0, F.floor(share / F.col("tokens"))).otherwise(1)
    plan = sources.select(

        F.col("source_key").alias("plan_key"),
        weight.alias("weight"),
        passes.cast("long").alias("passes"),
        F.when(F.col("tokens") > 0, share - passes * F.col("tokens")).otherwise(0).cast("long").alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("long").alias("n_blocks"),
    )
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("n_tokens"))
    dealt = rows.join(plan, rows.source_key == plan.plan_key).withColumn("h", order).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("h")), F.col("n_blocks")))
    blocks = dealt.groupBy("source_key", "block", "rest").agg(F.sum("n_tokens").alias("block_tokens"))
    # shelves of blocks, in the order of their hash, and blocks in theirs: no window is longer than SHELF, but for that over a source's shelves
    blocks = blocks.withColumn("shelf", F.floor(F.col("block") / SHELF))
    shelves = blocks.groupBy("source_key", "shelf").agg(F.sum("block_tokens").alias("shelf_tokens"), F.count("*").alias("shelf_blocks"))
    by_shelf = W.partitionBy("source_key").orderBy(F.xxhash64(F.lit(seed + 3), F.col("source_key"), F.col("shelf")), "shelf")
    ahead = lambda x: F.sum(x).over(by_shelf) - F.col(x)
    shelves = shelves.select(F.col("source_key").alias("s_key"), F.col("shelf").alias("s_shelf"), ahead("shelf_tokens").alias("tokens_ahead"), ahead("shelf_blocks").alias("blocks_ahead"))
    blocks = blocks.join(shelves, (F.col("source_key") == F.col("s_key")) & (F.col("shelf") == F.col("s_shelf")))
    by_hash = W.partitionBy("source_key", "shelf").orderBy(F.xxhash64(F.lit(seed + 2), F.col("source_key"), F.col("block")), "block")
    before = F.col("tokens_ahead") + F.sum("block_tokens").over(by_hash) - F.col("block_tokens")
    blocks = blocks.withColumn("before", before).withColumn("nth", F.row_number().over(by_hash)).select(
        F.col("source_key").alias("b_key"),
        F.col("block").alias("b_block"),
        (F.col("blocks_ahead") + F.col("nth")).cast("long").alias("nth"),
        F.when(F.col("before") + F.col("block_tokens") <= F.col("rest"), F.lit(1)).when(F.col("before") < F.col("rest"), F.col("rest") - F.col("before") + 1).otherwise(F.lit(0)).cast("long").alias("left"),
    )
    # left: 1 all of it, 0 none, else one more than the tokens still to take
    placed = dealt.join(blocks, (F.col("source_key") == F.col("b_key")) & (F.col("block") == F.col("b_block")))
    inside = W.partitionBy("source_key", "block").orderBy("h", "doc_id", "n_tokens")
    run = F.sum("n_tokens").over(inside)  # rows that are alike count together
    extra = F.when(F.col("left") == 1, 1).when(F.col("left") == 0, 0).otherwise((F.col("run") <= F.col("left") - 1).cast("int"))
    # documents without tokens are never the extra draw
    copies = F.col("passes") + F.when(F.col("n_tokens") > 0, extra).otherwise(0)
    return placed.withColumn("run", run).withColumn("place", F.rank().over(inside).cast("long")).select("doc_id", "source", "n_tokens", F.lit(a).alias("exponent"), "weight", F.col("nth").alias("block"), "place", copies.cast("long").alias("copies"))


def schedule(mixed: DataFrame) -> DataFrame:
    """One row per draw: doc_id, source, epoch, block, place. Documents of no draw have none."""
    return mixed.where("copies > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch"), "block", "place")


def op8(docs: DataFrame) -> DataFrame:
    return mix(docs)
