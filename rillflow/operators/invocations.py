"""Queries over invocations: lists, deadlines, parents, state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.log import ORD, invocations, table

#: The clock of all time predicates, so that results repeat.
NOW = "1998-01-01 00:10:00"
INV = "WITH" + ORD + " "


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def due() -> Column:
    """The deadline; without one, ten minutes after creation."""
    return F.coalesce("deadline", F.col("created_at") + F.expr("INTERVAL 10 MINUTES"))


def terminal(status: str = "status") -> Column:
    return F.col(status).isin("SUCCEEDED", "FAILED", "ABORTED")


def of_workflows(inv: DataFrame, *workflows: int) -> DataFrame:
    """The invocations of some workflows; without any named, all."""
    return inv.filter(F.col("workflow_id").isin(*workflows)) if workflows else inv


def no_parent() -> Column:
    """No parent, or one without an id."""
    return F.coalesce(F.col("parent_id").cast("string"), F.lit("")) == ""


@query(INV + "SELECT invocation_id, workflow_id, status FROM inv WHERE workflow_id IN (3, 17, 42) AND coalesce(CAST(parent_id AS VARCHAR), '') = ''")
def list_invocations(spark: SparkSession, d: str) -> DataFrame:
    return of_workflows(invocations(spark, d), 3, 17, 42).filter(no_parent()).select("invocation_id", "workflow_id", "status")


@query(INV + "SELECT invocation_id, status FROM inv WHERE status NOT IN ('SUCCEEDED', 'FAILED', 'ABORTED')")
def non_terminal(spark: SparkSession, d: str) -> DataFrame:
    return invocations(spark, d).filter(~terminal()).select("invocation_id", "status")


@query(INV + f"SELECT invocation_id, TIMESTAMP '{NOW}' > coalesce(deadline, created_at + INTERVAL 10 MINUTE) AS exceeded FROM inv")
def deadline_exceeded(spark: SparkSession, d: str) -> DataFrame:
    return invocations(spark, d).select("invocation_id", (now() > due()).alias("exceeded"))


@query(INV + f"SELECT invocation_id FROM inv WHERE status = 'IN_PROGRESS' AND created_at + INTERVAL 1 SECOND < TIMESTAMP '{NOW}' AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = inv.o_custkey AND c.c_acctbal > 0)")
def stale_entities(spark: SparkSession, d: str) -> DataFrame:
    """Open invocations last seen over a second ago that no live controller (a customer in credit) holds."""
    live = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    old = invocations(spark, d).filter(~terminal() & (F.col("created_at") + F.expr("INTERVAL 1 SECOND") < now()))
    return old.join(live, "o_custkey", "left_anti").select("invocation_id")


@query(INV + "SELECT invocation_id, least(created_at + to_minutes(CAST(1 + invocation_id % 15 AS INTEGER)), coalesce(deadline, created_at + INTERVAL 10 MINUTE)) AS task_deadline FROM inv")
def task_deadline(spark: SparkSession, d: str) -> DataFrame:
    """The earlier of start plus the task's timeout and the invocation's deadline."""
    timeout = F.make_dt_interval(mins=(1 + F.col("invocation_id") % 15).cast("int"))
    return invocations(spark, d).select("invocation_id", F.least(F.col("created_at") + timeout, due()).alias("task_deadline"))


def with_parents(inv: DataFrame, parents: DataFrame) -> DataFrame:
    """inv with the columns of its parent in ``parents``, whose key is p_id; null where there is none.

    Invocations without a parent are dealt out by their own id, as a join by parent_id alone brings all of them to one task."""
    up = F.coalesce("parent_id", "invocation_id")
    return inv.join(parents, (up == F.col("p_id")) & F.col("parent_id").isNotNull(), "left")


@query(INV + "SELECT c.invocation_id, c.parent_id, p.status AS parent_status, coalesce(p.price, c.price) AS inherited FROM inv c LEFT JOIN inv p ON c.parent_id = p.invocation_id")
def parent_scope(spark: SparkSession, d: str) -> DataFrame:
    inv = invocations(spark, d)
    p = inv.select(F.col("invocation_id").alias("p_id"), F.col("status").alias("parent_status"), F.col("price").alias("p_price"))
    return with_parents(inv, p).select("invocation_id", "parent_id", "parent_status", F.coalesce("p_price", "price").alias("inherited"))


@query(INV + "SELECT i.invocation_id, c.c_name AS workflow FROM inv i JOIN customer c ON i.workflow_id = c.c_custkey WHERE c.c_acctbal > 0")
def invocation_workflow_join(spark: SparkSession, d: str) -> DataFrame:
    """Each invocation with its workflow, if that is READY (an account in credit)."""
    ready = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("workflow_id"), F.col("c_name").alias("workflow"))
    return invocations(spark, d).join(ready, "workflow_id").select("invocation_id", "workflow")


@query(INV + """SELECT c.invocation_id, coalesce(CASE WHEN c.price > 100000 THEN c.priority END, p.priority, 'none') AS priority, coalesce(c.deadline, p.deadline) AS deadline,
  'own=' || c.invocation_id || coalesce(';up=' || p.invocation_id, '') AS tags FROM inv c LEFT JOIN inv p ON c.parent_id = p.invocation_id""")
def scope_merge(spark: SparkSession, d: str) -> DataFrame:
    """A child's fields win and the parent's fill the gaps; maps merge by key."""
    inv = invocations(spark, d).withColumn("own", F.when(F.col("price") > 100000, F.col("priority")))
    p = inv.select(F.col("invocation_id").alias("p_id"), F.col("priority").alias("p_priority"), F.col("deadline").alias("p_deadline"))
    both = with_parents(inv, p)
    tags = F.map_concat(F.create_map(F.lit("own"), F.col("invocation_id")), F.when(F.col("p_id").isNotNull(), F.create_map(F.lit("up"), F.col("p_id"))).otherwise(F.create_map().cast("map<string,bigint>")))
    text = F.array_join(F.transform(F.map_entries(tags), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return both.select("invocation_id", F.coalesce("own", "p_priority", F.lit("none")).alias("priority"), F.coalesce("deadline", "p_deadline").alias("deadline"), text.alias("tags"))


@query("SELECT c_custkey AS workflow_id, CASE WHEN c_acctbal < 0 THEN 'retry parse' WHEN c_mktsegment = 'BUILDING' THEN 'parse' ELSE 'none' END AS action FROM customer")
def workflow_controller_action(spark: SparkSession, d: str) -> DataFrame:
    """A workflow that FAILED (in debit) is parsed again, a QUEUED one (BUILDING) parsed, others left alone."""
    action = F.when(F.col("c_acctbal") < 0, "retry parse").when(F.col("c_mktsegment") == "BUILDING", "parse").otherwise("none")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("workflow_id"), action.alias("action"))


@query(
    INV
    + f""", li AS (SELECT l_orderkey, count_if(l_linestatus = 'O') AS open_tasks, count_if(l_returnflag = 'R') AS failed FROM lineitem GROUP BY l_orderkey)
SELECT invocation_id, CASE WHEN workflow_id = 0 THEN 'missing workflow' WHEN status IN ('SUCCEEDED', 'FAILED') THEN 'none' WHEN TIMESTAMP '{NOW}' > coalesce(deadline, created_at + INTERVAL 10 MINUTE) THEN 'abort'
  WHEN coalesce(open_tasks, 0) = 0 AND coalesce(failed, 0) > 0 THEN 'fail' WHEN coalesce(open_tasks, 0) = 0 THEN 'complete' ELSE 'schedule' END AS action FROM inv LEFT JOIN li ON invocation_id = l_orderkey"""
)
def invocation_controller_action(spark: SparkSession, d: str) -> DataFrame:
    """The ordered guards of an invocation's evaluation, over its line items as tasks."""
    tasks = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("invocation_id")).agg(F.count_if(F.col("l_linestatus") == "O").alias("open_tasks"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    done = F.coalesce("open_tasks", F.lit(0)) == 0
    action = (
        F.when(F.col("workflow_id") == 0, "missing workflow")
        .when(terminal(), "none")
        .when(now() > due(), "abort")
        .when(done & (F.coalesce("failed", F.lit(0)) > 0), "fail")
        .when(done, "complete")
        .otherwise("schedule")
    )
    return invocations(spark, d).join(tasks, "invocation_id", "left").select("invocation_id", action.alias("action"))


@query(
    INV
    + f""", li AS (SELECT l_orderkey, count(*) AS tasks, count_if(l_linestatus = 'O') AS open_tasks, count_if(l_returnflag = 'R') AS failed, count_if(l_shipdate > TIMESTAMP '{NOW}') AS executing, count_if(l_returnflag = 'N' AND l_linestatus = 'O') AS started FROM lineitem GROUP BY l_orderkey)
SELECT invocation_id, CASE WHEN workflow_id = 0 THEN 'fail: no workflow' WHEN executing > 0 THEN 'retry: ' || executing || ' open task(s)' WHEN started > 0 THEN 'wait' WHEN status IN ('SUCCEEDED', 'FAILED') THEN 'done' WHEN TIMESTAMP '{NOW}' > coalesce(deadline, created_at + INTERVAL 10 MINUTE) THEN 'fail: deadline'
  WHEN invocation_id % 6 = 0 THEN 'fail: errors' WHEN coalesce(open_tasks, 0) = 0 THEN CASE WHEN failed > 0 THEN 'fail: not all tasks succeeded' ELSE 'complete' END WHEN failed > 0 THEN 'fail: aborted' ELSE 'schedule' END AS action FROM inv LEFT JOIN li ON invocation_id = l_orderkey"""
)
def invocation_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """All guards of an evaluation in their order, over line items as tasks: some still in the executor, some started, open or failed."""
    item = lambda c: F.count_if(c)
    status, flag = F.col("l_linestatus"), F.col("l_returnflag")
    tasks = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("invocation_id")).agg(item(status == "O").alias("open"), item(flag == "R").alias("failed"), item(F.col("l_shipdate") > F.lit(NOW).cast("timestamp")).alias("executing"), item((flag == "N") & (status == "O")).alias("started"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return invocations(spark, d).join(tasks, "invocation_id", "left").select("invocation_id", evaluation(F.col("workflow_id") != 0, n("executing"), n("started"), F.when(F.col("invocation_id") % 6 == 0, 1).otherwise(0), n("open"), n("failed")).alias("action"))


def evaluation(has_workflow: Column, executing: Column, started: Column, errors: Column, open_tasks: Column, failed: Column) -> Column:
    """What is done with an invocation (status, deadline, created_at): the first guard that holds."""
    return (
        F.when(~has_workflow, "fail: no workflow")
        .when(executing > 0, F.concat(F.lit("retry: "), executing.cast("string"), F.lit(" open task(s)")))
        .when(started > 0, "wait")
        .when(terminal(), "done")
        .when(now() > due(), "fail: deadline")
        .when(errors > 0, "fail: errors")
        .when((open_tasks == 0) & (failed > 0), "fail: not all tasks succeeded")
        .when(open_tasks == 0, "complete")
        .when(failed > 0, "fail: aborted")
        .otherwise("schedule")
    )


@query(INV + "SELECT invocation_id, created_at, row_number() OVER (ORDER BY created_at, invocation_id) AS position FROM inv ORDER BY created_at, invocation_id LIMIT 100")
def list_order(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred by time, as a listing shows them (a top-k, so no full sort)."""
    first = invocations(spark, d).select("invocation_id", "created_at").orderBy("created_at", "invocation_id").limit(100)
    return first.withColumn("position", F.row_number().over(Window.orderBy("created_at", "invocation_id")).cast("long"))
