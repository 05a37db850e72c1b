"""The grouping and joining queries on tables whose keys are a third one value."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SOURCE = "/root/testdata/sf0.001"
HOT = {
    "lineitem": "l_orderkey, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN 7 ELSE l_suppkey END AS l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate",
    "orders": "o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "events": "event_id, ts, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id, event_type, value, props",
    "documents": "doc_id, CASE WHEN doc_id % 3 = 0 THEN first(text) OVER () ELSE text END AS text, lang, source, n_chars",
    "part": "p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'small ring' ELSE p_name END AS p_name, p_brand, p_type, p_size, p_retailprice",
}
KEYS = ["r08_statutory_tier", "j19_intake_scoring", "a05_chain_divergence", "a06_severity_tally",
        "a08_content_dedup", "j01_splice", "j02_snapshot_diff", "j04_map_results_back", "j09_hospital_lookup",
        "w01_slug_assignment", "w02_name_labels", "w08_rate_limit_admission", "t07_build_corpus"]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder, con = str(tmp_path_factory.mktemp("skewed")), duckdb.connect()
    for path in glob.glob(f"{SOURCE}/*.parquet"):
        name = os.path.basename(path)
        columns = HOT.get(name[:-len(".parquet")], "*")
        con.execute(f"COPY (SELECT {columns} FROM '{path}') TO '{folder}/{name}' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("key", KEYS)
def test_hot_keys(spark, skewed, key):
    problem = compare(spark, duck(skewed), skewed, key, entry.queries(), entry.oracle_sql(), empty_ok=True)
    assert problem is None, problem


LOW = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def test_hot_join_is_split(spark):
    """A third of all records share one content: the fan-out of its result is split over tasks."""
    from pyspark.sql import functions as F

    from rulegrain.operators import splice

    before = {k: spark.conf.get(k, None) for k in LOW}
    try:
        for key, value in LOW.items():
            spark.conf.set(key, value)
        records = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.col("id").cast("string")).alias("source_sha256"), F.sha2(F.col("id").cast("string"), 512).alias("filler"))
        results = spark.range(30_000).filter("id % 3 <> 0 OR id = 0").select(
            F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("source_sha256"),
            F.lit("p").alias("policy"), F.lit(None).cast("string").alias("error"))
        joined = splice.map_results(records, results)
        assert joined.filter("status = 'extracted'").count() == 30_000
        done = joined.select("id", "status", "filler")
        done.collect()
        assert "SortMergeJoin(skew=true)" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
