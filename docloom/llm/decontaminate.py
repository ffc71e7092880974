"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of template words
are hashed on both sides and joined on the hash. Matched windows of a document
and an item bring the values of their slots: where every value of the item
stands for one value of the document, throughout, and every value of the
document for one of the item, the document re-states the item with other
parameters; where they scatter or fall together, the match is a coincidence.
Hits are judged by occurrence: those of one document, item and alignment
(position in the document less position in the item, a few words of slack). A
document is contaminated by an item if the windows of one occurrence cover
`cover` of the item's windows or more and are consistent, or if a run of
`verbatim` of them or more is written as in the item.

Scale: documents' windows pass a fixed-size bitmap of the item windows' hashes
(8 MB at most, built by aggregation) inside the scan, so only windows that can
match are shuffled, whatever the corpus holds. The join itself is on 64-bit
hashes; slot values travel with the windows that passed. Counts per (document,
item) are distinct counts, combined map-side.

Nulls and odd cases: null and empty texts and items match nothing; items of
fewer than `LEAST` template words are no evidence and match nothing; items
shorter than the window match by their whole sequence; repeated documents are
each reported; a null id is reported as null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import materialise, require, small_batches

WINDOW, LEAST, LITERALS = 6, 4, 3
#: Words that may be put in or left out between two hits of one occurrence.
SLACK = 3
MAP_BITS = 26
STRIP = ".,;:!?\"'()[]{}<>*#$%&|_`~“”‘’«»…–—"
NUMBER = re.compile(r"[+\-−]?[$€£¥]?[0-9][0-9.,:/]*(?:e[+\-]?[0-9]+)?[%°]?(?:st|nd|rd|th)?")
MEASURE = re.compile(r"([+\-−]?[$€£¥]?[0-9][0-9.,]*)([a-zµ°²³/]{1,6})")
PERCENT = STRIP.replace("%", "")
END = frozenset(".!?:")
DIGIT = re.compile("[0-9]")
UNITS = frozenset("mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons lb lbs pound pounds oz ounce ounces ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent dollar dollars euro euros cent cents usd eur gbp k kmh mph km/h m/s hz khz mhz ghz w kw v volt volts a amp amps j kj cal kcal degree degrees °c °f".split())
PLAIN, NUM, NAME, UNIT = 0, 1, 2, 3
_SLOT = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_BASE = np.uint64(0x9FB21C651E98DF25)


def describe(word: str) -> tuple[int, int]:
    """A word's literal hash (0 for punctuation alone) and its marks: kind, plus 4 if it may be a unit, plus 8 if it ends a sentence."""
    plain = word.isalpha()
    bare = word if plain else word.strip(STRIP)
    if not bare:
        return 0, (4 if word.strip(PERCENT) == "%" else 0) + (8 if _ends(word) else 0)
    low = bare.lower()
    marks = 4 if low in UNITS else 0
    if plain or DIGIT.search(low) is None:
        if len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
            marks += NAME
    elif NUMBER.fullmatch(low) or ((m := MEASURE.fullmatch(low)) and m[2] in UNITS):
        marks += NUM
    elif len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
        marks += NAME
    if not plain:
        marks += 8 if _ends(word) else 0
        if word.strip(PERCENT) == "%":
            marks |= 4
    return xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 11) | 1, marks


def _ends(word: str) -> bool:
    return word.rstrip("\"')]}*#$%&”’»")[-1:] in END


class Vocabulary:
    """What describe() says of each distinct word, by number. Starts anew when full."""

    def __init__(self, most: int = 1 << 18):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.hash = np.zeros(self.most, np.uint64)
        self.marks = np.zeros(self.most, np.int8)

    def codes(self, words: list[str]) -> np.ndarray:
        got = list(map(self.code.get, words))
        if None in got:
            fresh = {w for w, c in zip(words, got, strict=True) if c is None}
            if len(self.code) + len(fresh) > self.most:
                fresh = set(words)
                self.most = max(self.most, len(fresh))
                self.clear()
            at = len(self.code)
            self.code.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            found = list(map(describe, fresh))
            self.hash[at : at + len(fresh)] = np.array([h for h, _ in found], np.uint64)
            self.marks[at : at + len(fresh)] = [m for _, m in found]
            got = list(map(self.code.get, words))
        return np.array(got, np.int64)


_words = Vocabulary()


def template(text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Hash and kind of each template word, and the words as written; words of punctuation alone are left out.

    A capital after the end of a sentence, or at the start, is no name; a unit is one only after a number.
    """
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), words
    c = _words.codes(words)
    h, marks = _words.hash[c], _words.marks[c]
    kind, unit = marks & 3, marks & 4 > 0
    starts = np.append(True, marks[:-1] & 8 > 0)
    kind[starts & (kind == NAME)] = PLAIN
    kind[1:][unit[1:] & (kind[:-1] == NUM)] = UNIT
    h = np.where(kind == PLAIN, h, _SLOT[kind])
    keep = h != 0
    if not keep.all():
        return h[keep], kind[keep], [w for w, k in zip(words, keep, strict=True) if k]
    return h, kind, words


def windows(h: np.ndarray, kind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `width` words, and whether it has enough literal words to be evidence."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.full(n, width, np.uint64)
    literal = np.zeros(n, np.int16)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ h[i : i + n]) * _BASE
            out ^= out >> np.uint64(29)
            literal += kind[i : i + n] == PLAIN
    return out, literal >= min(LITERALS, width - 1)


def _slots(kind: np.ndarray, words: list[str], at: int, width: int) -> list[str]:
    return [words[i].strip(STRIP).lower() for i in range(at, at + width) if kind[i] != PLAIN]


_SCHEMA = "id {id}, text_key long, window long, slots array<string>, at int"


def _rows(ids: list, texts: list, kind_of: pa.DataType, widths: list[int] | None, bits: np.ndarray | None):
    """Windows of texts: all (widths None: items), or those whose bit is set."""
    out_id, out_k, out_w, out_s, out_a = [], [], [], [], []
    for key, text in zip(ids, texts, strict=True):
        h, kind, words = template(text or "")
        for width in [min(WINDOW, len(h))] if widths is None else widths:
            if width < LEAST:
                continue
            w, good = windows(h, kind, width)
            if bits is not None:
                cell = (w >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                good &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            hits = np.flatnonzero(good).tolist()
            own = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 12) >> 1 if hits else 0
            for at in hits:
                out_id.append(key)
                out_k.append(own)
                out_w.append(int(w[at]) - (1 << 64) if int(w[at]) >> 63 else int(w[at]))
                out_s.append(_slots(kind, words, at, width))
                out_a.append(at)
    return pa.RecordBatch.from_arrays([pa.array(out_id, kind_of), pa.array(out_k, pa.int64()), pa.array(out_w, pa.int64()), pa.array(out_s, pa.list_(pa.string())), pa.array(out_a, pa.int32())], names=["id", "text_key", "window", "slots", "at"])


def item_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    chosen = bench.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            yield _rows(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(0).type, None, None)

    return chosen.mapInArrow(run, _SCHEMA.format(id=chosen.schema["id"].dataType.simpleString()))


def bitmap(items: DataFrame) -> bytes:
    """2^26 bits, compressed: bit (window >> 38) is set for each item window. At most 2^20 rows of 64 bits come to the driver."""
    cell = F.shiftrightunsigned("window", 64 - MAP_BITS)
    lanes = items.select(F.shiftright(cell, 6).alias("lane"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(window, {64 - MAP_BITS}) % 64 as int))").alias("bit")).groupBy("lane").agg(F.bit_or("bit").alias("bits"))
    got = lanes.toPandas()
    whole = np.zeros(1 << (MAP_BITS - 6), np.int64)
    whole[got["lane"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return zlib.compress(whole.tobytes(), 1)


_maps: dict[str, np.ndarray] = {}


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = 0.3, agree: float = 0.8, verbatim: float = 0.5) -> DataFrame:
    """One row per (document id, item): doc_id, item_id, n_windows of the item, n_matched, coverage, slot_agreement, contaminated: of the occurrence that says most."""
    require(docs, id_col, text_col)
    require(bench, "item_id", "text")
    spark = docs.sparkSession
    small_batches(spark)
    items = materialise(item_windows(bench), "item-windows", narrow=True)
    packed = bitmap(items)
    shared, key = spark.sparkContext.broadcast(packed), hashlib.sha256(packed).hexdigest()
    # the widths in use: items shorter than the window have their own
    sizes = bench.select(F.col("text").alias("t"))

    def widths_of(batches):
        for b in batches:
            got = {min(WINDOW, len(template(t or "")[0])) for t in b.column(0).to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(w for w in got if w >= LEAST), pa.int32())], names=["w"])

    widths = sorted(r.w for r in sizes.mapInArrow(widths_of, "w int").distinct().collect())  # at most WINDOW rows
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        if key not in _maps:
            _maps.clear()
            _maps[key] = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for b in batches:
            yield _rows(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(0).type, widths, _maps[key])

    found = materialise(chosen.mapInArrow(run, _SCHEMA.format(id=chosen.schema["id"].dataType.simpleString())), "doc-windows")
    d = found.select(F.col("id").alias("doc_id"), "text_key", F.col("window").alias("w"), F.col("slots").alias("d_slots"), F.col("at").alias("d_at"))
    nth = F.row_number().over(W.partitionBy("id", "text_key").orderBy("at"))
    i = items.select(F.col("id").alias("item_id"), "window", F.col("slots").alias("i_slots"), F.col("at").alias("i_at"), nth.alias("nth"))
    hits = d.join(i, d.w == i.window).select("doc_id", "text_key", "item_id", "w", "d_slots", "i_slots", "nth", (F.col("d_at") - F.col("i_at")).alias("shift")).distinct()
    near = W.partitionBy("doc_id", "text_key", "item_id").orderBy("shift")
    # an occurrence: hits whose alignments follow each other at SLACK words or less
    fresh = F.coalesce((F.col("shift") - F.lag("shift").over(near) > SLACK).cast("int"), F.lit(0))
    hits = hits.withColumn("fresh", fresh).withColumn("place", F.sum("fresh").over(near.rangeBetween(W.unboundedPreceding, 0)))
    own, keys = ["doc_id", "text_key", "item_id", "place"], ["doc_id", "item_id"]
    # windows written as in the item, one after the other
    hits = hits.withColumn("verbatim", F.col("i_slots") == F.col("d_slots"))
    aligned = W.partitionBy(*own, "shift", "verbatim")
    hits = hits.withColumn("run", F.col("nth") - F.dense_rank().over(aligned.orderBy("nth")))
    hits = hits.withColumn("run", F.count("*").over(W.partitionBy(*own, "shift", "verbatim", "run")))
    # each slot value of the item with each value it stands for in the occurrence
    slots = F.explode_outer(F.arrays_zip("i_slots", "d_slots"))
    pairs = hits.select(*own, "w", F.when(F.col("verbatim"), F.col("run")).otherwise(0).alias("run"), slots.alias("p"))
    pair = F.struct(F.col("p.i_slots").alias("i"), F.col("p.d_slots").alias("d"))
    some = F.col("p").isNotNull()
    occurrences = pairs.groupBy(*own).agg(
        F.count_distinct("w").alias("n_matched"),
        F.max("run").alias("longest"),
        F.count_distinct(F.when(some, F.col("p.i_slots"))).alias("n_values"),
        F.count_distinct(F.when(some, F.col("p.d_slots"))).alias("n_stands"),
        F.count_distinct(F.when(some, pair)).alias("n_pairs"),
    )
    per_item = items.groupBy("id").agg(F.countDistinct("window").alias("n_windows"))
    agreed = F.when(F.col("n_pairs") > 0, F.least("n_values", "n_stands") / F.col("n_pairs")).otherwise(1.0)
    judged = occurrences.join(per_item, F.col("item_id").eqNullSafe(F.col("id"))).select(
        *keys, "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), agreed.alias("slot_agreement"), (F.col("longest") / F.col("n_windows")).alias("verbatim")
    )
    # a verbatim run passes by itself
    judged = judged.withColumn("contaminated", ((F.col("coverage") >= cover) & (F.col("slot_agreement") >= agree)) | (F.col("verbatim") >= verbatim))
    best = F.max(F.struct("contaminated", "coverage", "slot_agreement", "n_matched", "n_windows")).alias("o")
    return judged.groupBy(*keys).agg(best).select(*keys, "o.n_windows", "o.n_matched", "o.coverage", "o.slot_agreement", "o.contaminated")


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, all columns. Texts, not ids, decide, so ids may be null or repeated."""
    require(docs, text_col)
    digest = F.unhex(F.sha2(F.col(text_col), 256))
    bad = matches(docs.select(digest.alias("doc_id"), F.col(text_col).alias("text")), bench).where("contaminated").select(F.col("doc_id").alias("bad")).distinct()
    rows = docs.select(F.struct("*").alias("row"), digest.alias("digest"))
    return rows.join(bad, F.col("digest") == F.col("bad"), "left_anti").select("row.*")


def op4(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The contaminated (document, item) pairs."""
    return matches(docs, bench).where("contaminated")
