"""Token counts through a digest cache.

Content is normalised (null becomes the empty text, nothing else, so counts
stay exact) and addressed by SHA-256; a tokenizer version is the digest of its
file. Counts are stored under (version, content). A call joins the content
digests to the stored counts, encodes each missing content once and appends
those counts; then every row reads its count from the cache.

The cache is a Parquet folder, partitioned by version, with one writer at a
time; an append shows up whole or not at all (Spark's commit), so a job that
dies midway leaves the cache as it was.

Encoding is exact and cheap: a pre-token never spans the point just before a
space that a non-space follows, so a text is cut there, and pieces seen before
in this worker are looked up. Texts that hold a special token's string go to
the tokenizer whole. Tokenizers for which that cut isn't proven (any but
byte-level BPE without a normaliser) encode whole texts.

Nulls and odd cases: null text has 0 bytes and 0 tokens; repeated rows each
get their row; very long texts are encoded whole; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import fresh_path, materialise, require, small_batches, text_or_empty

#: Before a space that a non-space follows; the listed marks count as spaces, to be safe.
CUT = re.compile("[ ](?=[^\\s᠎​﻿])")
MEMO = 250_000
_loaded: dict[str, Counter] = {}


class Counter:
    """Counts tokens of texts with one tokenizer file."""

    def __init__(self, kind: str, content: bytes):
        self.kind, self.memo = kind, {}
        if kind == "model":
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_proto=content)
            return
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(content.decode("utf-8"))
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(content)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE" and not any(" " in x for x in self.special)

    def whole(self, text: str) -> int:
        return len(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.kind == "model":
            return len(self.piece.encode(text))
        if not self.cuts or any(x in text for x in self.special):
            return self.whole(text)
        first, *rest = CUT.split(text)
        memo = self.memo
        got = list(map(memo.get, rest))
        if None in got:
            new = list({w for w, n in zip(rest, got, strict=True) if n is None})
            if len(memo) + len(new) > MEMO:
                memo.clear()
            own = {}
            for i in range(0, len(new), 4096):
                part = new[i : i + 4096]
                own.update(zip(part, map(len, self.tok.encode_batch_fast([" " + w for w in part], add_special_tokens=False)), strict=True))
            if len(own) <= MEMO:
                memo.update(own)
            got = [own[w] if n is None else n for w, n in zip(rest, got, strict=True)]
        return self.whole(first) + sum(got)


def version_of(kind: str, content: bytes) -> str:
    return hashlib.sha256(kind.encode() + b"\0" + content).hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """(content, n_tokens) under this version; None where nothing is stored yet."""
    try:
        found = spark.read.schema("content binary, n_tokens long, version string").parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.where(F.col("version") == version).select("content", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text_col: str = "text") -> DataFrame:
    """docs' columns other than text_col, with n_bytes and n_tokens; new counts go to `cache`.

    tokenizer: path of a tokenizers .json or sentencepiece .model file that the
    driver can read; executors get its bytes (a few MB) by broadcast.
    """
    require(docs, text_col)
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, "rb") as f:
        content = f.read()
    kind = "model" if tokenizer.endswith(".model") else "json"
    version = version_of(kind, content)
    shared = spark.sparkContext.broadcast(content)
    text = text_or_empty(F.col(text_col))
    texts = docs.select(F.unhex(F.sha2(text, 256)).alias("content"), text.alias("text"))

    stored = read_cache(spark, cache, version)
    if stored is not None:
        unseen = materialise(texts.select("content").distinct().join(stored, "content", "left_anti"), "unseen")
        texts = texts.join(unseen, "content", "left_semi")
    distinct = texts.groupBy("content").agg(F.first("text").alias("text"))

    def encode(batches):
        if version not in _loaded:
            _loaded[version] = Counter(kind, shared.value)
        counter = _loaded[version]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([counter.count(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["content", "n_tokens"])

    new = distinct.mapInArrow(encode, "content binary, n_tokens long")
    new.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)

    counts = read_cache(spark, cache, version)
    keep = [F.col(c) for c in docs.columns if c != text_col and c.lower() not in ("n_bytes", "n_tokens")]
    rows = docs.select(F.struct(*keep).alias("row") if keep else F.lit(1).alias("row"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("key"))
    return rows.join(counts, rows.key == counts.content).select(*(["row.*"] if keep else []), "n_bytes", "n_tokens")


def op2(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """A call of its own cache, so that the figures are those of a first run."""
    cache = fresh_path(docs.sparkSession, "token-cache")
    found = count_tokens(docs.select("doc_id", "text"), tokenizer, cache)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
