"""Queries over task chains: runs, overlays, outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.log import CHAIN, chain

C = "WITH" + CHAIN + " "


def finished() -> Column:
    return F.coalesce(F.col("status").isin("SUCCEEDED", "FAILED", "ABORTED", "SKIPPED"), F.lit(False))


@query(C + "SELECT t.invocation_id, t.task_id, coalesce(r.status, 'UNKNOWN') AS status FROM chain t LEFT JOIN (SELECT * FROM chain WHERE status IS NOT NULL) r USING (invocation_id, task_id)")
def task_run_status(spark: SparkSession, d: str) -> DataFrame:
    """Every declared task with its run's status."""
    t = chain(spark, d)
    runs = t.filter("status IS NOT NULL").select("invocation_id", "task_id", "status")
    return t.select("invocation_id", "task_id").join(runs, ["invocation_id", "task_id"], "left").select("invocation_id", "task_id", F.coalesce("status", F.lit("UNKNOWN")).alias("status"))


@query(C + "SELECT invocation_id, task_id, coalesce(status, 'SCHEDULED') AS status, row_number() OVER (PARTITION BY invocation_id ORDER BY task_id % 2, task_id) AS line FROM chain")
def status_report(spark: SparkSession, d: str) -> DataFrame:
    """A line per task: static ones (even) first, then dynamic ones, by id."""
    line = F.row_number().over(Window.partitionBy("invocation_id").orderBy(F.col("task_id") % 2, "task_id"))
    return chain(spark, d).select("invocation_id", "task_id", F.coalesce("status", F.lit("SCHEDULED")).alias("status"), line.cast("long").alias("line"))


@query(C + "SELECT invocation_id, task_id FROM chain WHERE status IS NULL")
def open_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Declared tasks without a run."""
    t = chain(spark, d).select("invocation_id", "task_id", "status")
    return t.select("invocation_id", "task_id").join(t.filter("status IS NOT NULL"), ["invocation_id", "task_id"], "left_anti")


@query(C + "SELECT invocation_id, task_id FROM chain WHERE status = 'FAILED'")
def failed_tasks(spark: SparkSession, d: str) -> DataFrame:
    return chain(spark, d).filter("status = 'FAILED'").select("invocation_id", "task_id")


@query(C + "SELECT invocation_id, bool_and(status IS NOT NULL) AS finished FROM chain GROUP BY invocation_id")
def all_finished(spark: SparkSession, d: str) -> DataFrame:
    return chain(spark, d).groupBy("invocation_id").agg(F.bool_and(finished()).alias("finished"))


@query(C + "SELECT invocation_id, bool_and(coalesce(status, '') = 'SUCCEEDED') AS successful FROM chain GROUP BY invocation_id")
def all_successful(spark: SparkSession, d: str) -> DataFrame:
    return chain(spark, d).groupBy("invocation_id").agg(F.bool_and(F.coalesce(F.col("status") == "SUCCEEDED", F.lit(False))).alias("successful"))


@query(C + "SELECT invocation_id, 'task ' || min(task_id) || ' failed' AS reason FROM chain WHERE status = 'FAILED' GROUP BY invocation_id")
def abort_reason(spark: SparkSession, d: str) -> DataFrame:
    """The message of the first failed task by id (a rule of our own: the order is not fixed otherwise)."""
    failed = chain(spark, d).filter("status = 'FAILED'").groupBy("invocation_id").agg(F.min("task_id").alias("t"))
    return failed.select("invocation_id", F.concat(F.lit("task "), F.col("t").cast("string"), F.lit(" failed")).alias("reason"))


@query(
    C
    + """SELECT invocation_id, CASE WHEN bool_and(coalesce(status, '') = 'SUCCEEDED') THEN arg_max(output, task_id) END AS output,
  CASE WHEN NOT bool_and(coalesce(status, '') = 'SUCCEEDED') THEN 'not all tasks succeeded' END AS error FROM chain GROUP BY invocation_id"""
)
def invocation_output(spark: SparkSession, d: str) -> DataFrame:
    """The last task's output, if every task succeeded."""
    g = chain(spark, d).groupBy("invocation_id").agg(F.bool_and(F.coalesce(F.col("status") == "SUCCEEDED", F.lit(False))).alias("ok"), F.max_by("output", "task_id").alias("o"))
    return g.select("invocation_id", F.when(F.col("ok"), F.col("o")).alias("output"), F.when(~F.col("ok"), "not all tasks succeeded").alias("error"))


@query(C + "SELECT invocation_id, task_id, CASE WHEN status = 'SUCCEEDED' THEN CASE WHEN function_ref = 'assistant' THEN 'length ' || length(output) ELSE output END END AS output FROM chain")
def forced_output(spark: SparkSession, d: str) -> DataFrame:
    """An override replaces a successful task's output and may use it; others have none."""
    override = F.when(F.col("function_ref") == "assistant", F.concat(F.lit("length "), F.length("output").cast("string"))).otherwise(F.col("output"))
    return chain(spark, d).select("invocation_id", "task_id", F.when(F.col("status") == "SUCCEEDED", override).alias("output"))


@query(C + "SELECT t.invocation_id, t.task_id, p.output AS upstream, CASE WHEN p.task_id IS NULL AND t.task_id > 0 THEN 'no such task' END AS error FROM chain t LEFT JOIN chain p ON t.invocation_id = p.invocation_id AND p.task_id = t.task_id - 1")
def scope_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The output of the task before, as an input expression sees it: a null and an error, never an exception."""
    t = chain(spark, d)
    p = t.select(F.col("invocation_id").alias("i"), (F.col("task_id") + 1).alias("n"), F.col("output").alias("upstream"))
    both = t.join(p, (F.col("invocation_id") == F.col("i")) & (F.col("task_id") == F.col("n")), "left")
    return both.select("invocation_id", "task_id", "upstream", F.when(F.col("n").isNull() & (F.col("task_id") > 0), "no such task").alias("error"))


@query(
    C
    + """, s AS (SELECT invocation_id, task_id, 'static' AS origin FROM chain WHERE task_id % 2 = 0), dyn AS (SELECT invocation_id, task_id, 'dynamic' AS origin FROM chain WHERE task_id % 2 = 1 OR task_id = 0)
SELECT invocation_id, task_id, coalesce(dyn.origin, s.origin) AS origin FROM s FULL JOIN dyn USING (invocation_id, task_id)"""
)
def dynamic_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Static and dynamic tasks; a dynamic one replaces the static one of the same id."""
    t = chain(spark, d).select("invocation_id", "task_id")
    s = t.filter("task_id % 2 = 0").withColumn("s", F.lit("static"))
    dyn = t.filter("task_id % 2 = 1 OR task_id = 0").withColumn("d", F.lit("dynamic"))
    return s.join(dyn, ["invocation_id", "task_id"], "full").select("invocation_id", "task_id", F.coalesce("d", "s").alias("origin"))


@query(
    "WITH RECURSIVE"
    + CHAIN
    + """, walk AS (SELECT invocation_id, task_id AS start, task_id, output FROM chain UNION ALL
  SELECT w.invocation_id, w.start, c.task_id, c.output FROM walk w JOIN chain c ON c.invocation_id = w.invocation_id AND c.task_id = w.task_id + 1 WHERE length(w.output) % 2 = 1)
SELECT invocation_id, start AS task_id, max(task_id) AS resolved FROM walk GROUP BY invocation_id, start"""
)
def dynamic_output_resolution(spark: SparkSession, d: str) -> DataFrame:
    """An output of odd length stands for the next task's output, over and over.

    Not a loop: the task that resolves each is the next one at or after it that has an even length or is last."""
    t = chain(spark, d)
    onward = Window.partitionBy("invocation_id").orderBy("task_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    end = F.when((F.length("output") % 2 == 0) | F.col("output").isNull(), F.col("task_id"))
    return t.select("invocation_id", "task_id", F.coalesce(F.min(end).over(onward), F.max("task_id").over(onward)).alias("resolved"))


@query(
    C
    + """, edges AS (SELECT a.invocation_id, a.task_id, b.task_id AS dep_id FROM chain a JOIN chain b ON a.invocation_id = b.invocation_id AND b.task_id = a.task_id - 1)
SELECT e.invocation_id, e.task_id, e.dep_id, 'DATA' AS dep_type FROM edges e UNION ALL SELECT e.invocation_id, e.task_id, e.dep_id + 100, 'DYNAMIC_OUTPUT' FROM edges e WHERE e.dep_id % 2 = 0"""
)
def inject_dynamic_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each even task has a dynamic child (its id plus 100); what depends on the task depends on the child as well."""
    t = chain(spark, d).select("invocation_id", "task_id")
    edges = t.join(t.select("invocation_id", (F.col("task_id") + 1).alias("task_id"), F.col("task_id").alias("dep_id")), ["invocation_id", "task_id"])
    children = t.filter("task_id % 2 = 0").select("invocation_id", F.col("task_id").alias("dep_id"), (F.col("task_id") + 100).alias("child"))
    more = edges.join(children, ["invocation_id", "dep_id"]).filter("task_id != child").select("invocation_id", "task_id", F.col("child").alias("dep_id"), F.lit("DYNAMIC_OUTPUT").alias("dep_type"))
    return edges.select("invocation_id", "task_id", "dep_id", F.lit("DATA").alias("dep_type")).unionByName(more)


@query(C + "SELECT function_ref, min(invocation_id * 100 + task_id) AS first_task FROM chain GROUP BY function_ref")
def distinct_function_refs(spark: SparkSession, d: str) -> DataFrame:
    """Each function reference once, with its first task."""
    return chain(spark, d).groupBy("function_ref").agg(F.min(F.col("invocation_id") * 100 + F.col("task_id")).alias("first_task"))


@query(C + "SELECT invocation_id, task_id, coalesce(s.function_ref, t.function_ref) AS function_ref, CASE WHEN s.function_ref IS NULL THEN 'spec' ELSE 'status' END AS origin FROM chain t LEFT JOIN (SELECT invocation_id, task_id, upper(function_ref) AS function_ref FROM chain WHERE status = 'SUCCEEDED') s USING (invocation_id, task_id)")
def status_spec_overlay(spark: SparkSession, d: str) -> DataFrame:
    """A task as its status has it, filled from the specification."""
    t = chain(spark, d)
    s = t.filter("status = 'SUCCEEDED'").select("invocation_id", "task_id", F.upper("function_ref").alias("resolved"))
    both = t.join(s, ["invocation_id", "task_id"], "left")
    return both.select("invocation_id", "task_id", F.coalesce("resolved", "function_ref").alias("function_ref"), F.when(F.col("resolved").isNull(), "spec").otherwise("status").alias("origin"))
