"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one binary classifier per bit works on
hashed character n-grams (1 to 4, words in lower case with their ends marked,
root-frequency weights of unit length). A text's bit margins are decoded to the
language of least weighted loss: a bit's loss counts by how well that bit tells
that language on training rows. A text whose two best languages are close is
flagged ambiguous.

Training takes at most `most` documents, evenly by language, chosen by hash, and
of each at most `most_chars` signs from a place chosen by hash, as a whole and
cut into a few short snippets so that short texts are met. So what reaches the
driver is bounded in bytes. Predictions read whole texts.

Nulls and odd cases: null texts and texts without a letter are `und` with
score 0; ties go to the lesser name; a null lang is not learned from; with one language every text with
letters gets it at score 1; without any training row all are `und`; repeated
rows each get a row; very long texts are read whole. lang, source and ids are
no inputs of a prediction.
"""

from __future__ import annotations

import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import held_out, require, small_batches
from docloom.llm.linear import dual_descent

BUCKETS = 1 << 15
NOT_LETTERS = re.compile(r"[\W\d_]+")
UND = "und"


def letters(text: str | None) -> str:
    """The text's runs of letters in lower case, a space between them. Numbers of other kinds than digits (fractions, Roman, circled) are no letters."""
    if not text:
        return ""
    clean = NOT_LETTERS.sub(" ", text.lower()).strip()
    if clean and not clean.replace(" ", "").isalpha():
        clean = " ".join("".join(c if c.isalpha() else " " for c in clean).split())
    return clean


def piece(clean: str, most: int, at: int) -> str:
    """Whole words from one place of the text, about `most` signs; at: any number, says which."""
    if len(clean) <= most:
        return clean
    begin = at % (len(clean) - most)
    return clean[begin : begin + most].partition(" ")[2].rpartition(" ")[0] or clean[begin : begin + most]


def features(clean: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of the n-grams; the squares of the weights sum to 1."""
    code = np.frombuffer(f" {clean} ".encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32)
    count = np.zeros(BUCKETS, np.int64)
    h, n = np.zeros(len(code), np.uint32), len(code)
    for k in range(min(4, n)):
        h = h[: n - k] * np.uint32(0x01000193) + code[k:] * np.uint32(0x9E3779B1) + np.uint32(k + 1)
        count += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    idx = np.flatnonzero(count)
    return idx, np.sqrt(count[idx] / count.sum()).astype(np.float32)


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """k rows of +1 and -1: every split of the languages up to 5 of them, else the best of random codes by least distance."""
    if k == 1:
        return np.ones((1, 1), np.int8)
    if k <= 5:
        splits = [s for s in product((1, -1), repeat=k) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int8).T
    rng, best, width = np.random.default_rng(seed), (-1, None), int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, width))
        code = code[:, np.abs(code.sum(0)) < k]
        gap = min((code[a] != code[b]).sum() for a in range(k) for b in range(a))
        if gap > best[0]:
            best = (gap, code)
    return best[1]


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray, heat: float):
        self.langs, self.code, self.weights, self.bias, self.trust, self.heat = langs, code, weights, bias, trust, heat

    def losses(self, clean: str) -> np.ndarray:
        idx, val = features(clean)
        f = val @ self.weights[idx] + self.bias
        return (self.trust * np.logaddexp(0, -4 * self.code * f)).sum(1)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the gap of the scores of the best two."""
        clean = letters(text)
        if not clean or not self.langs:
            return UND, 0.0, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0, 1.0
        d = self.losses(clean) * self.heat
        p = np.exp(d.min() - d)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.langs[order[0]], float(p[order[0]]), float(p[order[0]] - p[order[1]])


def snippets(clean: str, rng: np.random.Generator, times: int = 3) -> list[str]:
    words = clean.split()
    out = [clean]
    for _ in range(times if len(words) > 3 else 0):
        size = int(rng.integers(2, 25))
        at = int(rng.integers(0, max(1, len(words) - size)))
        out.append(" ".join(words[at : at + size]))
    return out


def fit(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], *([np.zeros((0, 0))] * 4), 1.0)
    code = codewords(len(names))
    if len(names) == 1:
        return Model(names, code, *([np.zeros((0, 0))] * 3), 1.0)
    rng = np.random.default_rng(1)
    rows, own = [], []
    for t, g in sorted(zip(texts, langs, strict=True), key=lambda x: (x[1], x[0])):
        for s in snippets(t, rng):
            idx, val = features(s)
            rows.append((idx.astype(np.int32), val))
            own.append(names.index(g))
    own = np.array(own)
    even = len(own) / len(names) / np.bincount(own, minlength=len(names))[own]
    fitted = [dual_descent(rows, code[own, j].astype(float), BUCKETS, c=4 * even, epochs=6, squared=True) for j in range(code.shape[1])]
    weights, bias = np.stack([w for w, _ in fitted], 1).astype(np.float32), np.array([b for _, b in fitted], np.float32)
    margin = np.stack([v @ weights[i] + bias for i, v in rows])
    right = (margin * code[own] > 0).astype(float)
    trust = np.stack([right[own == g].mean(0) for g in range(len(names))])
    trust = np.maximum(trust, 1e-3)
    trust /= trust.sum(1, keepdims=True)
    return Model(names, code, weights, bias, trust, 4.0)


def training_rows(docs: DataFrame, most: int, most_langs: int = 1000) -> DataFrame:
    """(lang, text) of about `most` rows, evenly by language, by hash of the id. Chances stand in the plan, one per language, so texts aren't shuffled."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages to learn from")
    place = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) / 1e6
    # most / len(counts) rows a language, by its count
    chance = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, most / len(counts) / n)))]) if counts else None
    return usable.where(F.lit(False) if chance is None else place < F.try_element_at(chance, F.col("lang"))).select("lang", "text")


def identify(docs: DataFrame, most: int = 2400, most_chars: int = 4000, model: Model | None = None, least_gap: float = 0.2) -> DataFrame:
    """(row struct of docs' columns, lang_pred, score, ambiguous) for each row of docs (doc_id, text; lang to learn from)."""
    require(docs, "doc_id", "text", *([] if model else ["lang"]))
    spark = docs.sparkSession
    small_batches(spark)
    if model is None:

        def clean(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([piece(letters(t), most_chars, zlib.crc32((t or "").encode("utf-8", "surrogatepass"))) for t in b.column(1).to_pylist()])], names=["lang", "clean"])

        got = training_rows(docs.select("doc_id", "text", "lang"), most).mapInArrow(clean, "lang string, clean string").where("clean <> ''").toArrow()
        model = fit(got.column("clean").to_pylist(), got.column("lang").to_pylist())
    shared = spark.sparkContext.broadcast(model)  # a MB for a handful of languages
    rows = docs.select(F.struct("*").alias("row"))

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column(0).field("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] != UND and g[2] < least_gap for g in got], pa.bool_())],
                names=["row", "lang_pred", "score", "ambiguous"],
            )

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def op7(docs: DataFrame) -> DataFrame:
    found = identify(docs.select("doc_id", "text", "lang"))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
