"""Where Spark keeps the state of keyed streams."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_state_store(spark: SparkSession) -> None:
    """Keyed processors need the store that holds state on disk, with changes in the checkpoint folder."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
