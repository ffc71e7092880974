"""Quality scores by naive-Bayes support vectors.

Features are indicators of n-grams of two kinds: of words in lower case (1 and
2), hashed, and of the words' shapes (1 to 3): case, length, closing sign,
digits, and whether the word equals the one before it. An n-gram of shapes has
one indicator per share of the text that it makes up (any, 2, 8, 25 and 60 %),
so a long text with a little noise differs from a noisy one.
Indicators are scaled by the classes' log-count ratio; a linear hinge-loss
model is fitted to them by dual coordinate descent, and its margin becomes a
probability by a logistic fit on the training rows.

Training takes at most `most` labelled rows, half of them per class, chosen by
hash, and of each at most `most_words` words from a place chosen by hash, so
that what reaches the driver is bounded in bytes; every class has its share of
the loss. All statistics of a score come from the whole text.

Nulls and odd cases: null and empty texts have no n-gram and get the score of
the bias alone, clipped into 0..1; labels that are null or whose document is
missing are not used; several labels of one document all count; repeated rows
each get a row; where training rows lack one of the classes every score is the
share of label 1 (0.5 without any). Labels, lang, source and ids are no inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import held_out, materialise, require, small_batches
from docloom.llm.linear import dual_descent, logistic_scale

SHAPE_BUCKETS, WORD_BUCKETS = 1 << 16, 1 << 18
BUCKETS = SHAPE_BUCKETS + WORD_BUCKETS
SHARES = (0.0, 0.02, 0.08, 0.25, 0.6)
MEMO = 1 << 18


def _shape(word: str) -> int:
    """A small number for the word's case, length, closing signs and digits."""
    case = 1 if word.islower() else 2 if word.isupper() else 3 if word[:1].isupper() else 0
    n = len(word)
    size = 0 if n < 2 else 1 if n < 4 else 2 if n < 9 else 3 if n < 15 else 4 if n < 25 else 5
    last = word[-1]
    twice = n > 1 and word[-2] == last
    sign = 0 if last.isalnum() else 1 if last in ".?" else 2 if last in ",;:" else 3 if last == "!" else 4 if last in "*#$%&" else 5 if last == "|" else 6 if last in ")]}>\"'" else 7
    digits = any("0" <= x <= "9" for x in word)
    return 1 + case + 4 * (size + 6 * (sign + 8 * (2 * digits + twice)))


class Shapes:
    """Numbers, shapes and hashes of words; starts anew when full."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.shape, self.hash = np.zeros(MEMO, np.int64), np.zeros(MEMO, np.int64)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Identity (within this call), shape and hash of each word."""
        got = list(map(self.codes.get, words))
        if None in got:
            fresh = {w for w, c in zip(words, got, strict=True) if c is None}
            if len(self.codes) + len(fresh) > len(self.shape):
                self.codes, fresh = {}, set(words)
                if len(fresh) > len(self.shape):
                    self.shape, self.hash = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
            for w in fresh:
                c = self.codes[w] = len(self.codes)
                self.shape[c] = _shape(w)
                self.hash[c] = xxhash.xxh32_intdigest(w.lower().encode("utf-8", "surrogatepass"), 3)
            got = list(map(self.codes.get, words))
        ids = np.array(got, np.int64)
        return ids, self.shape[ids], self.hash[ids]


_shapes = Shapes()


def features(text: str | None) -> np.ndarray:
    """Sorted buckets of the indicators that hold for the text."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int32)
    ids, s, h1 = _shapes.of(words)
    again = np.zeros(len(ids), np.int64)
    again[1:] = ids[1:] == ids[:-1]
    s = s + 4096 * again
    out = []
    total = len(ids)
    for n in (1, 2, 3):
        if total < n:
            break
        h = np.full(total - n + 1, n, np.int64)
        for i in range(n):
            h = (h * 1_000_003 + s[i : total - n + 1 + i]) & 0x7FFFFFFFFFFF
        grams, count = np.unique(h, return_counts=True)
        share = count / len(h)
        for level, least in enumerate(SHARES):
            own = grams[share > least]
            if not len(own):
                break
            mixed = (own * 8 + level) * 0x9E3779B1
            out.append((mixed ^ (mixed >> 17)) % SHAPE_BUCKETS)
    pairs = (h1[:-1] * 0x9E3779B1 + h1[1:]) & 0x7FFFFFFFFFFF
    out += [SHAPE_BUCKETS + h % WORD_BUCKETS for h in (h1, pairs ^ (pairs >> 21))]
    return np.unique(np.concatenate(out)).astype(np.int32)


class Model:
    """weights: of an indicator, ratio already applied; a row's margin is the sum over its indicators by root of their number, plus bias."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def score(self, found: np.ndarray) -> float:
        margin = float(self.weights[found].sum()) / max(1.0, np.sqrt(len(found))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -40, 40))))


def fit(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> Model:
    """y in {0, 1}."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    count = np.zeros((2, BUCKETS))
    for label in (0, 1):
        for r in (r for r, own in zip(rows, y, strict=True) if own == label):
            count[label][r] += 1
    p, q = count[1] + smooth, count[0] + smooth
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    scaled = [(r, ratio[r] / max(1.0, np.sqrt(len(r)))) for r in rows]
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 * len(y) / (y > 0).sum(), 0.5 * len(y) / (y <= 0).sum())
    w, bias = dual_descent(scaled, sign, BUCKETS, c=share)
    margin = np.array([w[i] @ v + bias for i, v in scaled])
    a, b = logistic_scale(margin, y)
    return Model((w * ratio).astype(np.float32), bias, max(a, 0.0), b)


def piece(text: str | None, most: int) -> str:
    """At most `most` words from one place of the text, which its own digest chooses."""
    words = (text or "").split()
    if len(words) <= most:
        return text or ""
    at = xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"), 4) % (len(words) - most)
    return " ".join(words[at : at + most])


def training_rows(docs: DataFrame, labels: DataFrame, most: int, most_words: int) -> DataFrame:
    """(label, found) of at most about `most` labelled rows outside the held-out part, half per class, by hash."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label"))
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    chance = lambda k: min(1.0, most / 2 / counts[k]) if counts.get(k) else 0.0
    place = F.pmod(F.xxhash64(F.lit("fit"), "label_id"), F.lit(1_000_000)) / 1e6
    chosen = materialise(usable.where(place < F.when(F.col("label") == 1, chance(1)).otherwise(chance(0))), "chosen-labels", narrow=True)
    # about `most` ids by construction, so this side may be sent to all
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("label", "text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array([features(piece(t, most_words)) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["label", "found"])

    return texts.mapInArrow(run, "label int, found array<int>")


def score_quality(docs: DataFrame, labels: DataFrame, most: int = 6000, most_words: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score) for each row of docs."""
    require(docs, id_col, text_col)
    require(labels, "doc_id", "quality")
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got = training_rows(own, labels, most, most_words).toArrow()
    found = [x.values.to_numpy() if x.values is not None else np.zeros(0, np.int32) for x in got.column("found").combine_chunks()] if got.num_rows else []
    y = got.column("label").to_numpy() if got.num_rows else np.zeros(0, int)
    order = sorted(range(len(y)), key=lambda i: (y[i], found[i].tobytes()))
    model = fit([found[i] for i in order], np.asarray(y)[order] if len(y) else y)
    shared = spark.sparkContext.broadcast(model)  # 1.3 MB

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m.score(features(t)) for t in b.column(2).to_pylist()], pa.float64())], names=["doc_id", "held_out", "score"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, labels).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
