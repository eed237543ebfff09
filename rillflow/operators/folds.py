"""Entity state as a fold of its events: last-writer aggregates, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.log import EV, EV_LIVE, events, order, since_created

LIVE = "WITH" + EV_LIVE + " "


def last(value: Column, when: Column) -> Column:
    """The value set by the last event that sets it."""
    return F.max_by(F.when(when, value), F.when(when, order()))


def kind(*types: str) -> Column:
    return F.col("event_type").isin(*types)


#: What each event makes of an invocation, and of a task run.
INVOCATION_STATES = {"InvocationCreated": "IN_PROGRESS", "InvocationCanceled": "ABORTED", "InvocationCompleted": "SUCCEEDED", "InvocationFailed": "FAILED"}
TASK_STATES = {"TaskStarted": "IN_PROGRESS", "TaskSucceeded": "SUCCEEDED", "TaskFailed": "FAILED", "TaskSkipped": "SKIPPED"}


def known(ev: DataFrame, *types: str) -> DataFrame:
    """The events; the job fails at one of another type."""
    return ev.filter(F.when(kind(*types), True).otherwise(F.raise_error(F.concat(F.lit("unsupported event: "), F.coalesce("event_type", F.lit("null")))).cast("boolean")))


def state_of(states: dict[str, str], event_type: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in states.items() for x in kv]), F.col(event_type))


def invocation_state(ev: DataFrame) -> DataFrame:
    """user_id, status, output, error, dynamic_tasks, generation from each invocation's last creation on.

    ev: user_id, event_id, ts, event_type, aggregate_type, value, task_id. Task events change nothing, an added task
    joins the dynamic ones and leaves the status, and output and error stay until they are set again."""
    own = known(since_created(ev).filter("aggregate_type = 'invocation'"), *INVOCATION_STATES, "InvocationTaskAdded")
    state = own.groupBy("user_id").agg(
        last(F.col("event_type"), kind(*INVOCATION_STATES)).alias("t"),
        last(F.col("value"), kind("InvocationCompleted")).alias("output"),
        last(F.col("value"), kind("InvocationCanceled", "InvocationFailed")).alias("error"),
        F.count_distinct(F.when(kind("InvocationTaskAdded"), F.col("task_id"))).alias("dynamic_tasks"),
        F.count(F.lit(1)).alias("generation"),
    )
    return state.select("user_id", state_of(INVOCATION_STATES, "t").alias("status"), "output", "error", "dynamic_tasks", "generation")


def task_state(ev: DataFrame) -> DataFrame:
    """task_run_id, status, output, error, generation: a start makes a run anew, at generation 2; each later event adds one."""
    key, at = F.col("aggregate_id"), order()
    runs = known(ev.filter("aggregate_type = 'taskrun'"), *TASK_STATES)
    starts = runs.filter(kind("TaskStarted")).groupBy(key.alias("run")).agg(F.max(at).alias("started"))
    live = runs.join(starts, key == F.col("run"), "left").filter(F.col("started").isNull() | (at >= F.col("started")))
    state = live.groupBy(key.alias("task_run_id")).agg(
        F.max_by("event_type", at).alias("t"),
        last(F.col("value"), kind("TaskSucceeded")).alias("output"),
        last(F.col("value"), kind("TaskFailed")).alias("error"),
        (F.count(F.lit(1)) + F.max(F.when(F.col("started").isNotNull(), 1).otherwise(0))).alias("generation"),
    )
    return state.select("task_run_id", state_of(TASK_STATES, "t").alias("status"), "output", "error", "generation")


def every_type(spark: SparkSession, d: str) -> DataFrame:
    """The log with purchases spread over all that an invocation can come to, and some errors as skipped runs."""
    n, t = F.col("event_id"), F.col("event_type")
    ends = F.when(n % 5 == 1, "InvocationCanceled").when(n % 5 == 2, "InvocationFailed").when(n % 5 == 3, "InvocationTaskAdded").otherwise("InvocationCompleted")
    spread = F.when(t == "InvocationCompleted", ends).when((t == "TaskFailed") & (n % 7 == 0), "TaskSkipped").otherwise(t)
    return events(spark, d).withColumns({"event_type": spread, "task_id": F.get_json_object("props", "$.k")})


EVERY = "WITH" + EV + """,
every AS (SELECT * REPLACE (CASE WHEN event_type = 'InvocationCompleted' THEN CASE event_id % 5 WHEN 1 THEN 'InvocationCanceled' WHEN 2 THEN 'InvocationFailed' WHEN 3 THEN 'InvocationTaskAdded' ELSE 'InvocationCompleted' END
    WHEN event_type = 'TaskFailed' AND event_id % 7 = 0 THEN 'TaskSkipped' ELSE event_type END AS event_type), row_number() OVER (PARTITION BY aggregate_type, aggregate_id ORDER BY ts, event_id) AS seq FROM ev)"""


@query(EVERY + """, c AS (SELECT user_id, max(seq) AS created FROM every WHERE event_type = 'InvocationCreated' GROUP BY user_id), live AS (SELECT e.* FROM every e JOIN c USING (user_id) WHERE e.aggregate_type = 'invocation' AND e.seq >= c.created)
SELECT user_id, CASE arg_max(event_type, seq) FILTER (WHERE event_type <> 'InvocationTaskAdded') WHEN 'InvocationCreated' THEN 'IN_PROGRESS' WHEN 'InvocationCanceled' THEN 'ABORTED' WHEN 'InvocationCompleted' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
  arg_max(value, seq) FILTER (WHERE event_type = 'InvocationCompleted') AS output, arg_max(value, seq) FILTER (WHERE event_type IN ('InvocationCanceled', 'InvocationFailed')) AS error,
  count(DISTINCT props->>'$.k') FILTER (WHERE event_type = 'InvocationTaskAdded') AS dynamic_tasks, count(*) AS generation FROM live GROUP BY user_id""")
def invocation_projection(spark: SparkSession, d: str) -> DataFrame:
    return invocation_state(every_type(spark, d))


WORKFLOW_STATES = {"WorkflowCreated": "QUEUED", "WorkflowParsed": "READY", "WorkflowParsingFailed": "FAILED", "WorkflowDeleted": "DELETED"}


def workflow_state(ev: DataFrame) -> DataFrame:
    """workflow_id, status, error, generation of workflow events (workflow_id, event_type, event_id, ts, value); the job fails at any other event."""
    state = known(ev, *WORKFLOW_STATES).groupBy("workflow_id").agg(F.max_by("event_type", order()).alias("t"), last(F.col("value"), kind("WorkflowParsingFailed")).alias("error"), F.count(F.lit(1)).alias("generation"))
    return state.select("workflow_id", state_of(WORKFLOW_STATES, "t").alias("status"), "error", "generation")


@query("""WITH we AS (SELECT user_id AS workflow_id, event_id, ts, value, CASE event_type WHEN 'signup' THEN 'WorkflowCreated' WHEN 'view' THEN 'WorkflowParsed' WHEN 'error' THEN 'WorkflowParsingFailed' ELSE 'WorkflowDeleted' END AS t FROM events WHERE event_type <> 'click')
SELECT workflow_id, CASE arg_max(t, (ts, event_id)) WHEN 'WorkflowCreated' THEN 'QUEUED' WHEN 'WorkflowParsed' THEN 'READY' WHEN 'WorkflowParsingFailed' THEN 'FAILED' ELSE 'DELETED' END AS status, arg_max(value, (ts, event_id)) FILTER (WHERE t = 'WorkflowParsingFailed') AS error, count(*) AS generation FROM we GROUP BY workflow_id""")
def workflow_projection(spark: SparkSession, d: str) -> DataFrame:
    """Workflow state, with the log's events read as workflow events (those of successful tasks are none)."""
    read_as = {"InvocationCreated": "WorkflowCreated", "TaskStarted": "WorkflowParsed", "TaskFailed": "WorkflowParsingFailed", "InvocationCompleted": "WorkflowDeleted"}
    ev = events(spark, d).filter(kind(*read_as)).withColumn("event_type", state_of(read_as, "event_type"))
    return workflow_state(ev.withColumnRenamed("user_id", "workflow_id"))


@query(EVERY + """, t AS (SELECT *, coalesce(max(CASE WHEN event_type = 'TaskStarted' THEN seq END) OVER (PARTITION BY aggregate_id), 0) AS started FROM every WHERE aggregate_type = 'taskrun')
SELECT aggregate_id AS task_run_id, CASE arg_max(event_type, seq) WHEN 'TaskStarted' THEN 'IN_PROGRESS' WHEN 'TaskSucceeded' THEN 'SUCCEEDED' WHEN 'TaskSkipped' THEN 'SKIPPED' ELSE 'FAILED' END AS status,
  arg_max(value, seq) FILTER (WHERE event_type = 'TaskSucceeded') AS output, arg_max(value, seq) FILTER (WHERE event_type = 'TaskFailed') AS error, max(seq) - min(seq) + 1 + CASE WHEN max(started) > 0 THEN 1 ELSE 0 END AS generation
FROM t WHERE seq >= started GROUP BY aggregate_id""")
def task_projection(spark: SparkSession, d: str) -> DataFrame:
    return task_state(every_type(spark, d))


@query(LIVE + """SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'TaskSucceeded') AS last_output, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'TaskFailed') AS last_error,
  arg_max(event_id, (ts, event_id)) AS last_event FROM live GROUP BY user_id""")
def lww_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Each attribute keeps its own last setter; a later event of another kind doesn't clear it."""
    return since_created(events(spark, d)).groupBy("user_id").agg(last(F.col("value"), kind("TaskSucceeded")).alias("last_output"), last(F.col("value"), kind("TaskFailed")).alias("last_error"), F.max_by("event_id", order()).alias("last_event"))


@query(LIVE + "SELECT user_id, count(*) AS generation, max(ts) AS updated_at FROM live WHERE aggregate_type = 'invocation' GROUP BY user_id")
def generation_updated(spark: SparkSession, d: str) -> DataFrame:
    own = since_created(events(spark, d)).filter(F.col("aggregate_type") == "invocation")
    return own.groupBy("user_id").agg(F.count(F.lit(1)).alias("generation"), F.max("ts").alias("updated_at"))
