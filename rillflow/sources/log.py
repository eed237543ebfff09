"""The driver's tables read as workflow data: an event log, task chains, invocations, small graphs.

Each source has its SQL beside it, as CTEs for the oracle queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import parts, spread

#: What each event of the table stands for.
EVENT_TYPES = {"signup": "InvocationCreated", "view": "TaskStarted", "click": "TaskSucceeded", "error": "TaskFailed", "purchase": "InvocationCompleted"}
TASK_KINDS = ("view", "click", "error")
#: Events after which an aggregate is complete.
TERMINAL = ("InvocationCompleted", "InvocationCanceled", "InvocationFailed", "WorkflowDeleted")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: task events belong to a task run and have the invocation as parent."""
    t = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    task = F.col("event_type").isin(*TASK_KINDS)
    kinds = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
    return t.select(
        "event_id",
        "ts",
        "user_id",
        F.element_at(kinds, F.col("event_type")).alias("event_type"),
        F.when(task, "taskrun").otherwise("invocation").alias("aggregate_type"),
        F.when(task, F.concat_ws("/", user, F.get_json_object("props", "$.k"))).otherwise(user).alias("aggregate_id"),
        F.when(task, "invocation").alias("parent_type"),
        F.when(task, user).alias("parent_id"),
        "value",
        "props",
    )


EV = """
ev AS (SELECT event_id, ts, user_id,
    CASE event_type WHEN 'signup' THEN 'InvocationCreated' WHEN 'view' THEN 'TaskStarted' WHEN 'click' THEN 'TaskSucceeded' WHEN 'error' THEN 'TaskFailed' ELSE 'InvocationCompleted' END AS event_type,
    CASE WHEN event_type IN ('view', 'click', 'error') THEN 'taskrun' ELSE 'invocation' END AS aggregate_type,
    CASE WHEN event_type IN ('view', 'click', 'error') THEN user_id::VARCHAR || '/' || (props->>'$.k') ELSE user_id::VARCHAR END AS aggregate_id,
    CASE WHEN event_type IN ('view', 'click', 'error') THEN 'invocation' END AS parent_type,
    CASE WHEN event_type IN ('view', 'click', 'error') THEN user_id::VARCHAR END AS parent_id, value, props
  FROM events)"""


def order() -> Column:
    """Append order of an aggregate's events."""
    return F.struct("ts", "event_id")


def since_created(ev: DataFrame) -> DataFrame:
    """The events from each invocation's last InvocationCreated on: a repeated one starts it anew.

    One aggregate per invocation (combined before the shuffle) joined back; no window over a hot key."""
    last = ev.filter(F.col("event_type") == "InvocationCreated").groupBy(F.col("user_id").alias("u")).agg(F.max(order()).alias("lc"))
    return ev.join(last, F.col("user_id") == F.col("u")).filter(order() >= F.col("lc")).drop("u", "lc")


EV_LIVE = EV + """,
lc AS (SELECT user_id, max((ts, event_id)) AS lc FROM ev WHERE event_type = 'InvocationCreated' GROUP BY user_id),
live AS (SELECT ev.* FROM ev JOIN lc USING (user_id) WHERE (ev.ts, ev.event_id) >= lc.lc)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task chains: an invocation per conversation, a task per turn that requires the turn before it.

    status is that of the task's run, null where it has none."""
    t = table(spark, sf_dir, "conversations")
    i, task = F.col("conv_id"), F.col("turn")
    status = F.when(task > i % 4, None).when((i + task) % 11 == 0, "FAILED").otherwise("SUCCEEDED")
    return t.select(i.alias("invocation_id"), task.alias("task_id"), F.col("role").alias("function_ref"), F.col("text").alias("output"), status.alias("status"))


CHAIN = """
chain AS (SELECT conv_id AS invocation_id, turn AS task_id, role AS function_ref, text AS output,
    CASE WHEN turn > conv_id % 4 THEN NULL WHEN (conv_id + turn) % 11 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status FROM conversations)"""


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invocations."""
    t, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    deadline = F.when(key % 3 == 0, None).otherwise(F.col("o_orderdate") + F.make_dt_interval(mins=(key % 20).cast("int")))
    return t.select(
        key.alias("invocation_id"),
        (F.col("o_custkey") % 50).alias("workflow_id"),
        F.when(key % 5 == 0, key - 1).alias("parent_id"),
        F.col("o_orderdate").alias("created_at"),
        deadline.alias("deadline"),
        F.when(F.col("o_orderstatus") == "O", "IN_PROGRESS").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
        "o_custkey",
    )


ORD = """
inv AS (SELECT o_orderkey AS invocation_id, o_custkey % 50 AS workflow_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 END AS parent_id, o_orderdate AS created_at,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + to_minutes(CAST(o_orderkey % 20 AS INTEGER)) END AS deadline,
    CASE o_orderstatus WHEN 'O' THEN 'IN_PROGRESS' WHEN 'F' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, o_totalprice AS price, o_orderpriority AS priority, o_custkey FROM orders)"""


def dag_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow_id, task_id, deps: each order as a graph of its line numbers, a row for each task.

    A line requires the one of half its number and, from the fourth on, the one before it. Some first lines also
    require the third (a cycle), some second ones a line that no order has; lines that are missing leave gaps.
    Lines without an order require nothing."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("workflow_id"), F.col("l_linenumber").cast("long").alias("task_id"))
    t = spread(t, parts(t), "workflow_id", "task_id").distinct()
    n, w = F.col("task_id"), F.col("workflow_id")
    deps = F.array(F.when(n > 1, F.floor(n / 2)), F.when(n > 3, n - 1), F.when((n == 1) & (w % 13 == 0), 3), F.when((n == 2) & (w % 11 == 0), 102))
    return t.select("workflow_id", "task_id", F.array_compact(F.when(w.isNotNull(), deps).otherwise(F.array())).alias("deps"))


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow_id, task_id, dep_id: dag_tasks() with a row for each edge, one without dep_id for a task that requires nothing."""
    return dag_tasks(spark, sf_dir).select("workflow_id", "task_id", F.explode_outer("deps").alias("dep_id"))


DAG = """t AS (SELECT DISTINCT l_orderkey AS workflow_id, l_linenumber::BIGINT AS task_id FROM lineitem),
e AS (SELECT *, task_id // 2 AS dep_id FROM t WHERE task_id > 1 UNION ALL SELECT *, task_id - 1 FROM t WHERE task_id > 3 UNION ALL SELECT *, 3 FROM t WHERE task_id = 1 AND workflow_id % 13 = 0 UNION ALL SELECT *, 102 FROM t WHERE task_id = 2 AND workflow_id % 11 = 0),
dag AS (SELECT t.workflow_id, t.task_id, e.dep_id FROM t LEFT JOIN e ON t.workflow_id = e.workflow_id AND t.task_id = e.task_id)"""
