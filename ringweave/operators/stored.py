"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master has a temporary one where that is unset; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ringweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, *by: str, n: int | None = None, moves: bool = True) -> DataFrame:
    """df written to the shared folder in n buckets of `by`, as many as a shuffle has partitions by default, and read back: joins and groups on `by` don't move its rows. Without `moves`, its rows lie by bucket as they are."""
    spark = df.sparkSession
    table, n = f"{name.replace('-', '_')}_{uuid.uuid4().hex}", n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, *by) if moves else df).write.bucketBy(n, *by).sortBy(*by).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table, format="parquet")
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files are an external table's
    return found
