"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints link at `radius` or fewer differing bits. Bits are grouped
into partitions, correlated bits together; partition i gets a threshold t_i
(-1: unused, else even) with sum(t_i + 1) > radius, so that two fingerprints
within the radius are within t_i bits in some partition i. A dynamic programme
picks the number of partitions and their unequal thresholds from bit
frequencies over all fingerprints: rows made plus expected candidates. Each
distinct fingerprint stands under the keys of the ball of radius t_i / 2 around
its value in partition i, so two that are within t_i bits there share a key.

Links are looked for in two ways, so that a large group costs no pairs within
itself. First stars: under each key every fingerprint is held against one
member, another one each round, and what links becomes one component. Then
every pair that shares a key, is within the radius and is not in one component
yet. Nothing is left out: a pair that is skipped is in one component already.

keep_one_similar() is the pipeline's rule: sets of 5-word shingles, a radius
that reaches Jaccard 0.8, and every link verified on the shingle sets.

Scale: everything after fingerprinting works on distinct fingerprints, so a
group of identical texts is one node. Nothing but 65 x 64 bit counts reaches
the driver. Hot join keys are left to AQE's skew split: both sides of each join
are plain exchanges. Comparisons under a key grow with the square of what
stands under it; the dynamic programme answers a larger corpus with longer keys.

Nulls and odd cases: null text counts as empty; no words give fingerprint zero,
which links as any other; fewer words than a shingle hash the whole sequence;
repeated rows are kept; null doc_ids are ignored when a component is named (a
component of null ids only has a null name). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise, require, small_batches

SEED = 42
BITS = 64
_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # byte value -> its bits, lowest first
_LANES = np.arange(8) * 256


def fingerprint_bytes(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return digest(b" ".join(words), SEED)
    join = b" ".join
    return fingerprint_of(np.array([digest(join(words[i : i + width]), SEED) for i in range(n - width + 1)], np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) per row of docs, repeats included; fp as a signed long."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint_bytes(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return chosen.mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Over all fingerprints: how many, and the 64 x 64 matrix of how often two bits are both set."""

    def run(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            raw = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(raw)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,097 rows at most
    got = {r.cell: r.n for r in rows}
    return got.get(BITS * BITS, 0), np.array([got.get(i, 0) for i in range(BITS * BITS)]).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of even size; each group takes the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        first = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def differing(p: np.ndarray) -> np.ndarray:
    """Chances that two fingerprints differ in 0, 1, 2, ... of these bits, each set with chance p."""
    dist = np.zeros(len(p) + 1)
    dist[0] = 1
    for q in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return dist


def shared_keys(width: int, rho: int, d: int) -> int:
    """How many values of `width` bits are within rho bits of each of two values that differ in d."""
    return sum(comb(d, i) * comb(width - d, j) for i in range(d + 1) for j in range(width - d + 1) if max(i, d - i) + j <= rho)


#: What it costs to make, move and sort a row, in comparisons.
ROW = 8


def allocate(n: int, both: np.ndarray, radius: int = 3, most_parts: int = 8, most_rho: int = 3) -> list[tuple[list[int], int]]:
    """Partitions with the radii of their balls (half their thresholds), at the least cost of rows and expected comparisons."""
    n = max(n, 1)  # an empty table too gets the plan of fewest rows
    p = np.diag(both) / n
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(1, most_parts + 1):
        groups = group_bits(n, both, m)
        # state: sum of (threshold + 1) so far -> (cost, radii)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            dist, after = differing(p[g]), {}
            choices = [(-1, 0, 0.0)]
            for rho in range(most_rho + 1):
                rows = sum(comb(len(g), i) for i in range(rho + 1))
                meet = sum(dist[d] * shared_keys(len(g), rho, d) for d in range(min(2 * rho, len(g)) + 1))
                choices.append((rho, 2 * rho + 1, ROW * n * rows + n * n / 2 * meet))
            for used, (cost, rhos) in states.items():
                for rho, adds, more in choices:
                    k = min(used + adds, radius + 1)
                    if k not in after or cost + more < after[k][0]:
                        after[k] = (cost + more, [*rhos, rho])
            states = after
        if radius + 1 in states and states[radius + 1][0] < best[0]:
            best = (states[radius + 1][0], [(g, rho) for g, rho in zip(groups, states[radius + 1][1], strict=True) if rho >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keys(fp: Column, plan: list[tuple[list[int], int]], ball: bool = True) -> Column:
    """The array of a fingerprint's keys, each with its way: the partition and the bits flipped. Without `ball` its own value in each partition only."""

    def part(k: int, group: list[int], rho: int) -> Column:
        # a constant per partition keeps the keys of different partitions apart
        own = xxhash.xxh64_intdigest(bytes([k]), SEED)
        flips = [c for i in range((rho if ball else 0) + 1) for c in combinations(range(len(group)), i)]
        ways = F.array(*[F.struct(F.lit(_signed(own ^ sum(1 << group[b] for b in c))).cast("long").alias("key"), F.lit(k << 24 | (max(c, default=-1) + 1) << 16 | min(c, default=0) << 8 | len(c)).alias("way")) for c in flips])
        value = fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))
        return F.transform(ways, lambda x: F.struct(value.bitwiseXOR(x["key"]).alias("key"), x["way"].alias("way")))

    return F.concat(*[part(k, group, rho) for k, (group, rho) in enumerate(plan)])


def once(way_a: Column, way_b: Column, xor: Column, plan: list[tuple[list[int], int]]) -> Column:
    """Of all keys that two fingerprints share, exactly one: of the first partition where they are close enough, with the lower half of the differing bits flipped on side a."""
    field = lambda way, at: F.shiftright(way, at).bitwiseAND(F.lit(255))
    n_a, n_b = field(way_a, 0), field(way_b, 0)
    halves = (n_b >= n_a) & (n_b <= n_a + 1) & ((n_a == 0) | (field(way_a, 16) <= field(way_b, 8)))
    for j, (group, rho) in enumerate(plan):
        halves = halves & ((field(way_a, 24) <= j) | (F.bit_count(xor.bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))) > 2 * rho))
    return halves


#: Up to so many pairs a node are verified at once; of more, the nearest go first, as they may spare the others.
PAIRS = 4
Near = Callable[[str, str], Column]


def star_pairs(nodes: DataFrame, plan: list[tuple[list[int], int]], near: Near, turn: int) -> DataFrame:
    """(a, b) once per pair: each node with the nearest of its keys' stars that is in another component. nodes: (node, fp, .., size, c).

    A key's star is its member of least hash, another hash each turn.
    """
    own = nodes.columns
    rows = nodes.select(*own, F.explode(keys(F.col("fp"), plan, ball=False)).alias("k")).select(*own, "k.key")
    stars = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), *[F.col(x).alias(f"{x}_b") for x in own])).alias("s"), F.min("c").alias("c_lo"), F.max("c").alias("c_hi"))
    stars = stars.where("c_lo < c_hi").select(F.col("key").alias("key_b"), "s.*")
    met = rows.toDF(*[f"{x}_a" for x in rows.columns]).join(stars, (F.col("key_a") == F.col("key_b")) & (F.col("c_a") != F.col("c_b")) & near("a", "b"))
    bits = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    nearest = met.groupBy("node_a").agg(F.min(F.struct(bits.alias("bits"), F.col("node_b").alias("other"))).alias("p"))
    return nearest.select(F.least("node_a", "p.other").alias("a"), F.greatest("node_a", "p.other").alias("b")).distinct()


def open_pairs(nodes: DataFrame, plan: list[tuple[list[int], int]], near: Near, most: int | None = None) -> DataFrame:
    """(a, b, bits) once per pair of different components that shares a key and is near; bits: their distance. nodes: (node, fp, size, c), with `most` also their wide fingerprints, which are within `most` bits."""
    rows = nodes.select("*", F.explode(keys(F.col("fp"), plan)).alias("k")).select(*nodes.columns, "k.key", "k.way")
    a, b = (rows.toDF(*[f"{x}_{side}" for x in rows.columns]) for side in "ab")
    xor = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    # comparing is the work here, however small the tables: a merge join spreads it, a broadcast would leave it to a few tasks
    met = a.join(b.hint("merge"), (F.col("key_a") == F.col("key_b")) & (F.col("c_a") < F.col("c_b")) & near("a", "b") & once(F.col("way_a"), F.col("way_b"), xor, plan) & (F.lit(True) if most is None else differing_bits("a", "b", WIDE) <= most))
    bits = F.bit_count(xor) if most is None else differing_bits("a", "b", WIDE)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), bits.alias("bits"))


def within_bits(most: int) -> Near:
    return lambda a, b: F.bit_count(F.col(f"fp_{a}").bitwiseXOR(F.col(f"fp_{b}"))) <= most


def labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with c: the root of their component, or the node itself."""
    named = roots.toDF("member", "root")
    return nodes.join(named, nodes.node == named.member, "left").select(*nodes.columns, F.coalesce("root", "node").alias("c"))


def link(fps: DataFrame, radius: int = 3, plan: list[tuple[list[int], int]] | None = None, turns: int = 2) -> DataFrame:
    """(node, root) of the components of fingerprints that link at `radius` or fewer differing bits; those that link to none may be missing.

    fps: one column fp, distinct.
    """
    if plan is None:
        plan = allocate(*bit_counts(fps), radius)
    nodes, near = fps.select(F.col("fp").alias("node"), "fp", F.lit(0).alias("size")), within_bits(radius)
    found, roots = None, None
    for turn in range(turns):
        own = nodes.withColumn("c", F.col("node")) if roots is None else labelled(nodes, roots)
        got = materialise(star_pairs(own, plan, near, turn), "links", narrow=True)
        found = got if found is None else found.union(got)
        roots = components(found)
    rest = open_pairs(labelled(nodes, roots), plan, near).select("a", "b")
    return components(found.union(rest))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node of its component. edges: (a, b) of longs.

    Alternating large-star and small-star steps; each round is one written table (the large star's shuffle serves both uses of it),
    and every star is built by a map-side combined minimum and a join that AQE may split.
    """
    now = materialise(edges.where("a <> b").distinct(), "edges", narrow=True)
    for _ in range(most_rounds):
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")).toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: neighbours above u go to u's minimum
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the lower neighbours of u, and u, go to u's minimum; here every edge has b < a
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(down, large.a == down.u).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        small = materialise(small, "stars", narrow=True)
        # done when every node has one edge only and no root is itself a child
        ends = small.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(small.select("b", F.lit(0), F.lit(1)))
        unsettled = (F.col("child") > 1) | (F.col("child") > 0) & (F.col("root") > 0)
        if not ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("root").alias("root")).agg(F.count_if(unsettled)).first()[0]:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = small
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id (the least id reachable)."""
    rows = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes", narrow=True)
    roots = link(nodes.select("fp"), radius)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "root_name")
    # written, so that the last join gets both sides by plain exchanges
    by_fp = materialise(named.join(names, named.root == names.root_name).select(F.col("fp").alias("fp_name"), "component_id"), "by_fp", narrow=True)
    return rows.join(by_fp, rows.fp == by_fp.fp_name).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """docs with one row of each component: the one of the least id (null last), the first of repeated rows."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(0).field(text_col).to_pylist()
            fps = np.array([fingerprint_bytes(t, width) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["row", "fp"])

    # numbered when written, so the numbers stay
    marked = docs.select(F.struct("*").alias("row")).mapInArrow(run, f"row {kind}, fp long").withColumn("rid", F.monotonically_increasing_id())
    rows = materialise(marked, "fingerprints")
    own = F.col("row").getField(id_col)
    nodes = materialise(rows.groupBy("fp").agg(F.min(F.struct(own.isNull().alias("none"), own.alias("id"), F.col("rid"))).alias("first")), "nodes", narrow=True)
    roots = link(nodes.select("fp"), radius)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), "first")
    winners = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("keep"))
    # winners grow with the corpus: always a merge join, never one side sent to all
    return rows.join(winners.hint("merge"), rows.rid == winners.keep, "left_semi").select("row.*")


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; of the whole sequence where it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))], np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
    ones = (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _TABLE).ravel()
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


#: Words of 64 bits of a wide fingerprint: all sets get the first WIDE_FIRST, those that may have a neighbour all WIDE.
WIDE, WIDE_FIRST = 8, 2
_MIX = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint of 64 * words bits: each hash is mixed that many ways, and a bit is 1 if set in over half of them."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 4096):
        with np.errstate(over="ignore"):
            z = hashes[at : at + 4096, None] + _MIX[:words]
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


WORDS = ["fp", *(f"w{i}" for i in range(1, WIDE))]


def differing_bits(a: str, b: str, words: int) -> Column:
    each = [F.bit_count(F.col(f"{w}_{a}").bitwiseXOR(F.col(f"{w}_{b}"))) for w in WORDS[:words]]
    return sum(each[1:], each[0])


def expected_bits(similarity: float, bits: int, spread: float) -> int:
    """How many of `bits` differ between sets of equal size and this similarity, and `spread` standard errors more."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + spread * np.sqrt(bits * p * (1 - p)))


def similar_sizes(similarity: float, spread: float) -> Near:
    """The first words differ in no more bits than the similarity lets expect, and the sizes allow it."""
    most = expected_bits(similarity, 64 * WIDE_FIRST, spread)
    return lambda a, b: (differing_bits(a, b, WIDE_FIRST) <= most) & (F.least(f"size_{a}", f"size_{b}") >= F.lit(similarity) * F.greatest(f"size_{a}", f"size_{b}"))


def suspects(nodes: DataFrame, plan: list[tuple[list[int], int]], near: Near) -> DataFrame:
    """The fp of nodes that share a key with another one that is near; each looks only until it has found one. nodes: (node, fp, .., size)."""
    own = ["size", *WORDS[:WIDE_FIRST]]
    rows = nodes.select(*own, F.explode(keys(F.col("fp"), plan)).alias("k")).select(*own, "k.key")
    a, b = (rows.toDF(*[f"{x}_{side}" for x in rows.columns]) for side in "ab")
    met = a.join(b.hint("merge"), (F.col("key_a") == F.col("key_b")) & (F.col("fp_a") != F.col("fp_b")) & near("a", "b"), "left_semi")
    alike = nodes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    return met.select(F.col("fp_a").alias("fp")).union(alike).distinct()


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """The (a, b) of pairs whose shingle sets have Jaccard `similarity` or more. texts: (node, text)."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = shingle_set(x, width), shingle_set(y, width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ta, tb = texts.toDF("node_a", "text_a"), texts.toDF("node_b", "text_b")
    sides = pairs.select("a", "b").join(ta, F.col("a") == F.col("node_a")).join(tb, F.col("b") == F.col("node_b"))
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, radius: int = 11, spread: float = 2.3, width: int = 5, turns: int = 2, steps: int = 3) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one of the least id (null last), the first of repeated rows.

    Two texts link where their sets of `width`-word shingles have Jaccard `similarity` or more; groups are the components of links. A node is a
    distinct shingle set, fingerprinted over the set. Pairs within `radius` of the first 64 bits are all looked at, and farther ones that share a
    key, as long as their fingerprints differ in no more bits than sets of that similarity are expected to, and `spread` standard errors more.

    Nodes with no such neighbour at all, by 128 bits, leave first; the others get 512 bits, which tell pairs far from the similarity before any
    text is read. Among them, `turns` rounds of stars are verified on the texts, then all pairs between components, in `steps` steps from the nearest
    to those whose wide fingerprints just allow the similarity: so most of a large group is one component before its many far pairs are looked
    at, and those inside it need no look. Texts without words are all one node.
    """
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(0).field(text_col).to_pylist()]
            first = np.array([wide_of(x, WIDE_FIRST) for x in sets], np.uint64).reshape(-1, WIDE_FIRST).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array([len(x) for x in sets], pa.int32()), *(pa.array(np.ascontiguousarray(w)) for w in first.T)], names=["row", "node", "size", *WORDS[:WIDE_FIRST]])

    longs = lambda names: ", ".join(f"{w} long" for w in names)
    # numbered when written, so the numbers stay
    marked = docs.select(F.struct("*").alias("row")).mapInArrow(run, f"row {kind}, node long, size int, {longs(WORDS[:WIDE_FIRST])}").withColumn("rid", F.monotonically_increasing_id())
    rows = materialise(marked, "fingerprints")
    own = F.col("row").getField(id_col)
    first = F.min(F.struct(own.isNull().alias("none"), own.alias("id"), F.col("rid"))).alias("first")
    nodes = materialise(rows.groupBy("node").agg(*[F.min(w).alias(w) for w in WORDS[:WIDE_FIRST]], F.min("size").alias("size"), first), "nodes", narrow=True)
    some = nodes.where("size > 0").select("node", *WORDS[:WIDE_FIRST], "size", "first.rid")
    near = similar_sizes(similarity, spread)
    plan = allocate(*bit_counts(some), radius)
    odd = suspects(some, plan, near)
    odd = materialise(some.join(odd.withColumnRenamed("fp", "fp_odd").hint("merge"), F.col("fp") == F.col("fp_odd"), "left_semi"), "suspects", narrow=True)
    wanted = odd.select(F.col("rid").alias("wanted")).hint("merge")
    texts = materialise(rows.select("rid", "node", F.col("row").getField(text_col).alias("text")).join(wanted, F.col("rid") == F.col("wanted"), "left_semi").select("node", "text"), "suspect-texts")

    def widen(batches):
        for batch in batches:
            wide = np.array([wide_of(shingle_set(t, width), WIDE) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(w)) for w in wide.T)], names=["wide_node", *WORDS])

    wide = texts.mapInArrow(widen, f"wide_node long, {longs(WORDS)}").drop(*WORDS[:WIDE_FIRST])
    odd = materialise(odd.drop("rid").join(wide, F.col("node") == F.col("wide_node")).drop("wide_node"), "wide", narrow=True)
    # fewer nodes take fewer and shorter keys
    short = allocate(*bit_counts(odd), radius, most_parts=radius + 1)
    most_at_once = PAIRS * odd.count()
    roots = odd.sparkSession.createDataFrame([], "node long, root long")

    def look(pairs: DataFrame) -> None:
        nonlocal roots
        roots = components(roots.union(materialise(verified(pairs, texts, similarity, width), "verified", narrow=True)).toDF("a", "b"))

    for turn in range(turns):
        look(star_pairs(labelled(odd.select("node", *WORDS[:WIDE_FIRST], "size"), roots), plan, near, turn))
    for step in range(steps):
        # steps of even width from the similarity up to 1
        most = expected_bits(similarity + (1 - similarity) * (steps - 1 - step) / (steps + 1), 64 * WIDE, spread)
        todo = materialise(open_pairs(labelled(odd, roots), short, near, most), "open-pairs")
        if todo.count() > most_at_once:
            # of each node the nearest pair first, then what is still open
            ways = todo.select(F.col("a").alias("u"), F.col("b").alias("v"), "bits", "a", "b").union(todo.select(F.col("b"), F.col("a"), "bits", "a", "b"))
            look(ways.groupBy("u").agg(F.min(F.struct("bits", "v", "a", "b")).alias("p")).select("p.a", "p.b").distinct())
            one, two = roots.toDF("node_a", "root_a"), roots.toDF("node_b", "root_b")
            left = todo.join(one, F.col("a") == F.col("node_a"), "left").join(two, F.col("b") == F.col("node_b"), "left")
            todo = materialise(left.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "open-pairs", narrow=True)
        look(todo)
    named = nodes.join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(F.coalesce("root", "node").alias("root"), "first")
    winners = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("keep"))
    # winners grow with the corpus: always a merge join, never one side sent to all
    return rows.join(winners.hint("merge"), rows.rid == winners.keep, "left_semi").select("row.*")


def op10(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
