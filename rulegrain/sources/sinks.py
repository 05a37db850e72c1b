"""Writers: versioned datasets, text reports and the per-content result cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegrain.sources.readers import exists


def write_dataset(df: DataFrame, root: str, version: str, fmt: str = "parquet") -> str:
    """Write one version below `root`; earlier versions stay readable."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def write_text_report(lines: DataFrame, path: str, order: list[str], text: str = "line") -> None:
    """Lines in a total order.  Part files keep it by name, so a large report needs no
    single task; read them in name order."""
    ordered = lines.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    ordered.select(text).write.mode("overwrite").text(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


class KeyedTable:
    """A table with one row a `key`, in folders by the hash of the key.

    A merge reads and rewrites only the buckets that hold a touched key; the others stay as
    they are.  New buckets are written aside first, since a table cannot be overwritten while it is
    read, but for the first merge, which reads nothing; the same merge run again gives the same table.
    Files are packed by zstd, which halves digests."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self._stored().filter("key IS NOT NULL").drop("bucket")

    def merge(self, rows: DataFrame, removed: DataFrame | None = None) -> list[int]:
        """Put `rows` (one a key) in place of rows of the same keys, take `removed` keys out; returns
        the buckets that were rewritten, of which there are `self.buckets` at most."""
        names = self.read().columns
        new = self._bucketed(rows.select(*names))
        if not exists(self.spark, f"{self.path}/rows"):
            self._write(new)
            return sorted(r[0] for r in self._stored().select("bucket").distinct().collect())
        gone = self._bucketed(removed.select("key")) if removed is not None else new.select("key", "bucket").limit(0)
        touched = [r[0] for r in new.select("bucket").union(gone.select("bucket")).distinct().collect()]
        if touched:
            keys = new.select("key").unionByName(gone.select("key"))
            kept = self._stored().filter(F.col("bucket").isin(touched) & F.col("key").isNotNull()).join(
                keys, "key", "left_anti")
            # a bucket that loses all its rows gets a row without a key, so that it is overwritten as well
            empty = gone.select("bucket").distinct().select(
                *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.read().schema.fields], "bucket")
            aside = f"{self.path}/aside"
            kept.unionByName(new).unionByName(empty).write.mode("overwrite").parquet(aside, compression="zstd")
            self._write(self.spark.read.schema(f"{self.schema}, bucket int").parquet(aside))
        return sorted(touched)

    def _write(self, rows: DataFrame) -> None:
        (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(f"{self.path}/rows", compression="zstd"))


class ResultCache:
    """Results keyed by content hash in an append-only Parquet folder; of several results of one
    content the one appended last counts, within one append the largest by its columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        stored = self._stored()
        columns = [c for c in stored.columns if c != "batch"]
        last = F.max(F.struct("batch", *[c for c in columns if c != "source_sha256"]))
        return stored.groupBy("source_sha256").agg(last.alias("last")).select(*[
            F.col("source_sha256") if c == "source_sha256" else F.col(f"last.{c}").alias(c) for c in columns])

    def append(self, results: DataFrame) -> None:
        before = self._stored().agg(F.max("batch")).first()[0] if exists(self.spark, self.path) else None
        number = 0 if before is None else before + 1
        results.withColumn("batch", F.lit(number).cast("bigint")).write.mode("append").parquet(self.path)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch bigint").parquet(self.path)
