"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import fresh_path, materialise, shared_folder, ship, table

__all__ = ["fresh_path", "held_out", "materialise", "shared_folder", "ship", "small_batches", "table", "text_or_empty", "words_of"]

#: A word, as the contracts define it: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch may hold, as texts may be long; sends the package to the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(f"({WORD})"), F.lit(1))


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
