"""Intermediate tables in the shared folder that the session names, and helpers on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulegrain.session import scratch_path


class Scratch:
    """Tables of one operator run.  They hold what later steps read, so that a lost executor costs
    a reread and not a recomputation; `drop` removes one that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_path(spark, name)
        self.paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((table, path))
        return table

    def drop(self, table: DataFrame) -> None:
        found = next(path for kept, path in self.paths if kept is table)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
