"""Quality rules with suffix-array repetition.

A text's words get a suffix array (prefix doubling, many texts at once) and the
longest common prefix of neighbours. The longest LCP interval that holds a
suffix is the longest repeat that starts there; the union of these spans is
what maximal repeats of `min_repeat` words or more cover. A text fails if they
cover more than `max_covered` of its words or if one repeat is longer than
`longest` words. The base rules (few words, repeated 5-word windows) come
first: a text that fails them isn't kept.

Texts are handled in blocks of about BLOCK words (a longer text alone), so
memory is bounded by the longest text: about a hundred bytes a word.

Nulls and odd cases: null and empty texts have no word and fail the base rules;
repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import require, small_batches

BLOCK = 60_000
#: Up to so many words a table of ranks by doubling is kept; a longer text is walked instead, in memory of a few numbers a word.
LEVELS = 1 << 18
BLANKS, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"


def longest_repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """At each position, the length in words of the longest prefix of its suffix that occurs at another position.

    ids: a number per word, equal only for equal words of one text; doc: the text of each position.
    """
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)

    def fresh_runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
        starts = np.flatnonzero(first)
        return starts[np.cumsum(first) - 1], first

    # a rank is the place of the first suffix of its group; the cell past the end never equals one
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    order = np.argsort(ids, kind="stable")
    start, first = fresh_runs(ids[order])
    rank[order] = start
    small = n <= LEVELS
    levels = [rank.astype(np.int32)]
    alone = first & np.append(first[1:], True)
    active, k = order[~alone], 1
    while len(active):
        ahead = np.minimum(active + k, n)
        second = np.where((ahead < n) & (doc[np.minimum(ahead, n - 1)] == doc[active]), rank[ahead], -1)
        key = rank[active] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        base = rank[active]
        start_key, first = fresh_runs(key)
        start_base, _ = fresh_runs(base)
        rank[active] = base + start_key - start_base
        if small:
            levels.append(rank.astype(np.int32))
        alone = first & np.append(first[1:], True)
        active = active[~alone]
        k *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank[:n]] = np.arange(n)
    best = np.zeros(n, np.int64)
    if not small:
        a, length = suffix[1:], shared_prefixes(ids, doc, rank, suffix)[1:]
        np.maximum.at(best, a, length)
        np.maximum.at(best, suffix[:-1], length)
        return best
    a, b = suffix[:-1], suffix[1:]
    some = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[some], b[some]
    length = np.zeros(len(some), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        same = levels[j][np.minimum(a + length, n)] == levels[j][np.minimum(b + length, n)]
        length[same & (np.minimum(a + length, n) < n)] += 1 << j
    np.maximum.at(best, a, length)
    np.maximum.at(best, b, length)
    return best


def shared_prefixes(ids: np.ndarray, doc: np.ndarray, rank: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """By rank: the longest common prefix of a suffix and the one before it, in one walk over the text (after Kasai and others) and without a table."""
    n = len(ids)
    # the end of each position's text bounds its prefix; equal words are of one text only
    word, place, order = (memoryview(np.ascontiguousarray(x, np.int32)) for x in (ids, rank[:n], suffix))
    out, k = np.zeros(n, np.int32), 0
    to = memoryview(out)
    for i in range(n):
        r = place[i]
        if r:
            j = order[r - 1]
            top = n - max(i, j)
            while k < top and word[i + k] == word[j + k]:
                k += 1
            to[r] = k
            k = k - 1 if k else 0
        else:
            k = 0
    return out.astype(np.int64)


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Whether each position lies in a repeat of `least` words or more."""
    n = len(best)
    at = np.flatnonzero(best >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + best[at], -1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[str | None], min_repeat: int = 4) -> list[tuple[int, int, int, int, int, int, int]]:
    """Per text: words, their code points, symbols, repeated lines, words in repeated 5-word windows, words in repeats of min_repeat or more, longest repeat."""
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    out: list = []
    at = 0
    while at < len(split):
        upto, size = at, 0
        while upto < len(split) and (upto == at or size + len(split[upto]) <= BLOCK):
            size += len(split[upto])
            upto += 1
        numbers: list[int] = []
        sizes = []
        offset = 0
        for words in split[at:upto]:
            own: dict[bytes, int] = {}
            numbers.extend([own.setdefault(w, offset + len(own)) for w in words])
            offset += len(own)
            sizes.append(len(words))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        best = longest_repeats(np.array(numbers, np.int64), doc)
        ends = np.cumsum(sizes)
        five, many = np.append(0, np.cumsum(covered(best, 5))), np.append(0, np.cumsum(covered(best, min_repeat)))
        for i, end in enumerate(ends.tolist()):
            text, begin = texts[at + i] or "", end - sizes[i]
            lines = [x for x in text.split("\n") if x.strip(BLANKS)]
            out.append(
                (
                    sizes[i],
                    len(text) - sum(map(text.count, BLANKS)),
                    sum(map(text.count, SYMBOLS)),
                    len(lines) - len(set(lines)),
                    int(five[end] - five[begin]),
                    int(many[end] - many[begin]),
                    int(best[begin:end].max()) if end > begin else 0,
                )
            )
        at = upto
    return out


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 4, max_covered: float = 0.2, longest: int = 100) -> DataFrame:
    """One row per row of docs: doc_id, the seven measures, base_failed, kept."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            rows = measure(b.column(1).to_pylist(), min_repeat)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(NAMES)))], names=["doc_id", *NAMES])

    kind = own.schema["doc_id"].dataType.simpleString()
    found = own.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NAMES))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    good = (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & good)


def op6(docs: DataFrame) -> DataFrame:
    return repetition(docs)
