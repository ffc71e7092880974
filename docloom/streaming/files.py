"""The same conversion over a folder that files keep arriving in. Stateless: a file's result equals the batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.sources.detect import GLOB, file_type
from docloom.sources.files import MOST, elements, markdown

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_elements(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", GLOB).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    content = F.when(raw.length <= MOST, raw.content)
    return elements(raw.select("path", content.alias("content"), file_type(raw.path, content).alias("file_type")))


def stream_markdown(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's files as Markdown, appended to `out`; ends when all present files are done."""

    def write(batch: DataFrame, _: int) -> None:
        markdown(batch).write.mode("append").parquet(out)

    return stream_elements(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
