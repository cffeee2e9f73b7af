"""Tables between the steps of an operator, in the folder that the cluster shares.

A written table has no lineage: a lost executor costs the tasks that it ran, not the rounds before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from veridian.session import scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to a new folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`written` that no later step reads."""
    for table in tables:
        files = table.inputFiles() if table is not None else []
        if files:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
