"""The invocation fold over a stream of events.

State is a handful of last-writer values per invocation, merged as events come in any order; nothing is
dropped as late, and a query over the same events in one batch gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.log import EV_LIVE, TASK_KINDS
from ..sources.shared import shared_dir


def state(events: DataFrame) -> DataFrame:
    """user_id, status, output since the last creation; works on batches and streams alike."""
    at = F.struct("ts", "event_id")
    own, done = ~F.col("event_type").isin(*TASK_KINDS), F.col("event_type") == "purchase"
    g = events.groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "signup", at)).alias("created"),
        F.max(F.when(own, F.struct("ts", "event_id", "event_type"))).alias("last"),
        F.max(F.when(done, F.struct("ts", "event_id", "value"))).alias("completed"),
    )
    fresh = F.struct("completed.ts", "completed.event_id") >= F.col("created")
    return g.filter("created IS NOT NULL").select("user_id", F.when(F.col("last.event_type") == "purchase", "SUCCEEDED").otherwise("IN_PROGRESS").alias("status"), F.when(fresh, F.col("completed.value")).alias("output"))


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows that the last batch to tell of each key has written."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in ("user_id", "batch")]
    kept = rows.groupBy("user_id").agg(F.max_by(F.struct(*names), "batch").alias("r"))
    return kept.select("user_id", *[F.col(f"r.{n}").alias(n) for n in names])


def follow(events: DataFrame, at: str) -> None:
    """Fold a stream until it has read all there is: each batch appends the states that it changed, under its number.

    A batch that is run again after a failure replaces what it wrote before."""

    def append(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{at}/state/batch={batch}")

    run = state(events).writeStream.outputMode("update").option("checkpointLocation", f"{at}/log").trigger(availableNow=True)
    run.foreachBatch(append).start().awaitTermination()


@query("WITH" + EV_LIVE + " SELECT user_id, CASE arg_max(event_type, (ts, event_id)) FILTER (WHERE aggregate_type = 'invocation') WHEN 'InvocationCompleted' THEN 'SUCCEEDED' ELSE 'IN_PROGRESS' END AS status, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'InvocationCompleted') AS output FROM live GROUP BY user_id")
def stream_invocation_state(spark: SparkSession, d: str) -> DataFrame:
    """The whole event log through a stream that ends when it has read all."""
    schema, at = spark.read.parquet(f"{d}/events.parquet").schema, folder(spark)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    follow(stream, at)
    return latest(spark, f"{at}/state")
