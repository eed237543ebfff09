"""Invocations and their parents."""

from pyspark.sql import functions as F

from rillflow.operators import invocations


def test_invocations_without_parent_are_not_all_in_one_task(spark):
    inv = spark.range(4000).select(F.col("id").alias("invocation_id"), F.when(F.col("id") % 5 == 0, F.col("id") - 1).alias("parent_id"))
    p = spark.range(4000).select(F.col("id").alias("p_id"), (F.col("id") * 2).alias("x"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = invocations.with_parents(inv, p).withColumn("part", F.spark_partition_id())
        assert max(r["count"] for r in got.groupBy("part").count().collect()) < 2000
        rows = {r.invocation_id: (r.p_id, r.x) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert rows == {i: (i - 1, 2 * i - 2) if i % 5 == 0 and i else (None, None) for i in range(4000)}


def test_parent_scope_deals_out_orphans(spark):
    plan = invocations.parent_scope(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(parent_id" in next(x for x in plan.splitlines() if "Join LeftOuter" in x)
