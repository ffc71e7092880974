"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on any other
    master that folder would be different disks, so this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="docloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/docloom/{label}-{uuid.uuid4().hex}"
    made(spark).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """Paths given out in this session so far, in order."""
    sc = spark.sparkContext
    if not hasattr(sc, "_docloom_made"):
        sc._docloom_made = []
    return sc._docloom_made


def sweep(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what was written under the paths given out since a point, but for the last `keep` of them.

    For a caller that has its result written: frames that still read these paths fail afterwards.
    """
    paths = made(spark)
    end = len(paths) - keep
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths[since:end]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    del paths[since:end]


def materialise(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    narrow: rows are a few numbers each, so at most three files per core, however many shuffle partitions there are.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    (df.coalesce(3 * spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, each as often as it does; what isn't files counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in found if n < 1 << 60)


def by_key(df: DataFrame, *keys: str, most: int = 8 << 20) -> DataFrame:
    """df dealt by its keys for a sort of each part: at most about `most` bytes of input files a part, so a task's memory doesn't grow with the input.

    Left to itself, Spark merges parts up to 64 MB as they are shuffled, which are some 15 times that in a sort.
    """
    parts = -(-file_bytes(df) // most)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def over_all(df: DataFrame, *keys: str, most: int = 64 << 10) -> DataFrame:
    """df dealt over all cores before much work for each row: Spark reads a small file in one task, however much is to be done with its rows."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-file_bytes(df) // most)), *keys)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they may have another working folder."""
    sc = spark.sparkContext
    if getattr(sc, "_docloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="docloom-ship-"), "docloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(home):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.join("docloom", os.path.relpath(os.path.join(top, n), home)))
    sc.addPyFile(path)
    sc._docloom_shipped = True
