"""Tables written to the folder that driver and executors share, so that a lost executor costs a reread only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where the session names none and runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints/modlake"


class Rounds:
    """Written tables of a job that goes on in rounds; lineage ends at each of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written = path
        return out

    def free(self, *tables: DataFrame) -> None:
        """Deletes tables that no plan still to be run reads."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._written)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
