"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage works on what the one before kept, written as Parquet and read
again; a stage's decisions take effect on its output. All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, langid_ecoc, line_spread, simhash_gph, temperature_mix
from docloom.llm.common import materialise, table
from docloom.session import made, sweep


#: A text that is ambiguous and whose best language is no likelier than this, little over chance among four, is in none of them.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that are in no language the others are in; where none could be learned, all with letters stay."""
    found = langid_ecoc.identify(docs)
    none = F.col("ambiguous") & (F.col("score") < LEAST_SCORE)
    return found.where(F.col("row.text").rlike(r"\p{L}") & ~none).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, whatever their share of the text; n_chars follows the text."""
    cleaned = line_spread.remove_boilerplate(docs)
    columns = [F.col("text") if c == "text" else F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return cleaned.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles of similarity 0.8 or more."""
    return simhash_gph.keep_one_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its source's weight, its number of draws, and its place in the source's order."""
    return temperature_mix.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixture", mixture),
]

#: SQL cannot express language ID or fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; what a stage wrote on the way goes when the next one's result is written."""
    docs, since = table(spark, sf_dir, "documents"), len(made(spark))
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        sweep(spark, since, keep=1)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
