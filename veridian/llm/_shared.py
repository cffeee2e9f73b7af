"""Where intermediate tables live, and how they are written and read again.

All lineage is cut through tables in the folder that the cluster shares
(``spark.checkpoint.dir``), so a lost executor costs only its own tasks.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a URI.  Only a local[...] session may fall back to a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="veridian-")
        spark.conf.set("spark.checkpoint.dir", "file://" + root)
        root = "file://" + root
    return (root if "://" in root else "file://" + root).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark drops the shuffle files of a statement when the statement ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a recovery point with no lineage.

    The shuffle files behind it go at once, for nothing after it needs them.
    """
    spark = df.sparkSession
    path, before = new_folder(spark, name), spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *folders: str) -> None:
    """Remove folders that no later step reads."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def folder_of(df: DataFrame) -> str:
    """The folder behind a table made by :func:`materialize`."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later step reads."""
    for t in tables:
        if t.inputFiles():
            delete(t.sparkSession, folder_of(t))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text and sets of a batch that goes to or from a Python worker, in bytes.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """From now on batches of this session hold ``most`` bytes at most (a longer row stays whole), however long the rows are.

    By default they hold 10,000 rows or 64 MB, which an executor keeps in the JVM and in Python for each of its tasks.
    A smaller limit of the session is left as it is.
    """
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", spark.conf.get(BATCH_BYTES).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= most:
        spark.conf.set(BATCH_BYTES, str(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, n_bytes: int, each: int = 64 << 20) -> int:
    """As many partitions as the session asks for, or more if a task would read over ``each`` bytes."""
    return max(shuffle_partitions(spark), -(-n_bytes // each))
