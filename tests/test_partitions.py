"""Partitions of keys follow the rows."""

from pyspark.sql import functions as F

from rillflow.operators import graph
from rillflow.sources import log, shared


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)
    d = "/root/testdata/sf0.001"
    n = -(-log.table(spark, d, "lineitem").count() // 500)
    assert n > 8
    for q in (log.dag, graph.start_tasks, graph.undefined_deps):
        assert q(spark, d).select(F.spark_partition_id()).rdd.getNumPartitions() == n
