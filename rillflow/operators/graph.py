"""Dependency graphs as node and edge tables: roots, waves, cycles, and what to schedule next."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..registry import query
from ..sources.log import CHAIN, DAG, chain, dag, dag_tasks, table
from ..sources.shared import importable, new_folder, parts, spread, stored

KEY = ["g", "task_id"]
#: Rows (tasks and edges) of a graph that is peeled in one piece; larger ones are peeled in rounds over all tasks.
GRAPH_ROWS = 4096


def chain_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (g, task_id, status) and edges (g, task_id, dep_id) of the task chains."""
    t = chain(spark, d).select(F.col("invocation_id").alias("g"), "task_id", "status")
    return t, t.filter("task_id > 0").select("g", "task_id", (F.col("task_id") - 1).alias("dep_id"))


NODES = "WITH" + CHAIN + ", nodes AS (SELECT invocation_id AS g, task_id, status FROM chain), edges AS (SELECT g, task_id, task_id - 1 AS dep_id FROM nodes WHERE task_id > 0)"
OPEN = NODES + ", open AS (SELECT g, task_id FROM nodes WHERE status IS NULL), oe AS (SELECT e.* FROM edges e JOIN open a USING (g, task_id) JOIN open b ON e.g = b.g AND e.dep_id = b.task_id), failed AS (SELECT DISTINCT g FROM nodes WHERE status = 'FAILED')"
ROOTS = OPEN + ", roots AS (SELECT g, task_id FROM open o WHERE NOT EXISTS (SELECT 1 FROM oe WHERE oe.g = o.g AND oe.task_id = o.task_id))"


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes: a dependency on anything else counts as met."""
    n = nodes.select("g", "task_id")
    return edges.join(n, KEY, "left_semi").join(n.withColumnRenamed("task_id", "dep_id"), ["g", "dep_id"], "left_semi").select("g", "task_id", "dep_id")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that wait for no other node."""
    return nodes.select("g", "task_id").join(edges_within(edges, nodes).select("g", "task_id"), KEY, "left_anti")


@query(OPEN + " SELECT g, task_id, dep_id FROM oe")
def open_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = chain_graph(spark, d)
    return edges_within(edges, nodes.filter("status IS NULL"))


@query(ROOTS + " SELECT g, task_id FROM roots")
def graph_roots(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = chain_graph(spark, d)
    return roots(nodes.filter("status IS NULL"), edges)


@query("WITH " + DAG + " SELECT workflow_id, task_id FROM dag GROUP BY workflow_id, task_id HAVING count(dep_id) = 0")
def start_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that require nothing."""
    return dag_tasks(spark, d).filter(F.size("deps") == 0).select("workflow_id", "task_id")


def _peel(n: int, task: np.ndarray, dep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wave of each of n tasks, 0 for those on or behind a cycle, and whether a task is on a cycle (or between two)."""
    wave, left, now, edges = np.zeros(n, np.int32), np.ones(n, bool), 1, (task, dep)
    for behind in (False, True):
        while True:
            waits = np.zeros(n, bool)
            waits[edges[0]] = True
            ready = left & ~waits
            if not ready.any():
                break
            if not behind:
                wave[ready] = now
            left, now = left & waits, now + 1
            open_ = left[edges[1]]
            edges = edges[0][open_], edges[1][open_]
        edges = edges[1], edges[0]
    return wave, left


def _peel_graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, task_id, dep_id, declared), sorted by g: each task with its wave and whether it is on a cycle; rows of graphs over GRAPH_ROWS as they are."""

    def out(t: pa.Table, wave: pa.Array, cyclic: pa.Array) -> list[pa.RecordBatch]:
        return t.append_column("wave", wave).append_column("cyclic", cyclic).combine_chunks().to_batches()

    def whole(t: pa.Table) -> list[pa.RecordBatch]:
        return out(t, pa.nulls(len(t), pa.int32()), pa.nulls(len(t), pa.bool_()))

    def codes(x: pa.Array) -> np.ndarray:
        return x.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def peeled(t: pa.Table) -> list[pa.RecordBatch]:
        g, ids = codes(t["g"]), codes(pa.chunked_array([*t["task_id"].chunks, *t["dep_id"].chunks]))
        task, dep = g * len(ids) + ids[: len(t)], g * len(ids) + ids[len(t) :]
        declared = np.flatnonzero(t["declared"].to_numpy())
        nodes, at = np.unique(task[declared], return_index=True)
        known = pc.and_(t["g"].is_valid(), pc.and_(t["task_id"].is_valid(), t["dep_id"].is_valid())).to_numpy()  # as in a join, nulls meet nothing
        edge = known & np.isin(task, nodes) & np.isin(dep, nodes)
        wave, cyclic = _peel(len(nodes), np.searchsorted(nodes, task[edge]), np.searchsorted(nodes, dep[edge]))
        return out(t.take(declared[at]), pa.array(wave), pa.array(cyclic))

    rest, large = None, None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if large is not None:
            same = pc.fill_null(pc.equal(t["g"], large), False) if large.is_valid else pc.is_null(t["g"])
            yield from whole(t.filter(same))
            t = t.filter(pc.invert(same))
        if not len(t):
            rest = None
            continue
        g = codes(t["g"])
        other = np.flatnonzero(g != g[-1])
        start = other[-1] + 1 if len(other) else 0
        if start:
            yield from peeled(t.slice(0, start))
            large = None
        rest = t.slice(start)
        if len(rest) > GRAPH_ROWS:
            yield from whole(rest)
            large, rest = rest["g"][0], None
    if rest is not None and len(rest):
        yield from peeled(rest)


def peeled(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (g, task_id, dep_id, declared) as tasks (g, task_id, wave, cyclic), and the rows of graphs too large for that, if any.

    A row is an edge if it has a dep_id, and declares its task if ``declared``. Each graph is peeled by one task, many at a time."""
    importable(rows.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    sorted_ = spread(rows.select(*KEY, "dep_id", "declared"), n, "g").sortWithinPartitions("g")
    done = stored(sorted_.mapInArrow(_peel_graphs, f"g {kind['g']}, task_id {kind['task_id']}, dep_id {kind['dep_id']}, declared boolean, wave int, cyclic boolean"), "peeled")
    large = done.filter("wave IS NULL").select(*KEY, "dep_id", "declared")
    return done.filter("wave IS NOT NULL").select(*KEY, "wave", "cyclic"), None if large.first() is None else large


def _apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of such rows."""
    return rows.filter("declared").select(*KEY).distinct(), rows.filter("dep_id IS NOT NULL").select(*KEY, "dep_id")


def _together(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """Such rows of nodes and edges, and into how many partitions they go."""
    edges = edges.select(*KEY, "dep_id", F.lit(False).alias("declared")).dropna()
    rows = stored(nodes.select(*KEY, F.lit(None).cast(edges.schema["dep_id"].dataType).alias("dep_id"), F.lit(True).alias("declared")).unionByName(edges), "graph-rows")
    return rows, parts(rows)


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """g, task_id, wave: 1 for tasks without dependencies, else one more than the latest dependency.

    Tasks on or behind a cycle have no wave."""
    return _waves(*_together(nodes, edges))


def _waves(rows: DataFrame, n: int) -> DataFrame:
    small, large = peeled(rows, n)
    found = small.filter("wave > 0").select(*KEY, "wave")
    return found if large is None else found.unionByName(waves_in_rounds(*_apart(large)))


def waves_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """waves() of graphs of any size.

    Peels one wave of all graphs at once, so the rounds are as many as the longest chain of tasks, not
    as the graphs."""
    spark, at = nodes.sparkSession, new_folder(nodes.sparkSession, "waves")
    edges = stored(edges_within(edges, nodes), "waves-edges")
    left, wave = nodes.select("g", "task_id").distinct(), 1
    keys = left.schema.fields
    while True:
        waits = edges.join(left.withColumnRenamed("task_id", "dep_id"), ["g", "dep_id"], "left_semi").select("g", "task_id").distinct().withColumn("waits", F.lit(True))
        # a round is written once; its tasks that wait are what the next one reads
        left.join(waits, KEY, "left").select(*KEY, F.coalesce("waits", F.lit(False)).alias("waits")).write.partitionBy("waits").parquet(f"{at}/wave={wave}")
        now = spark.read.schema(StructType([*keys, StructField("waits", BooleanType())])).parquet(f"{at}/wave={wave}")
        ready = now.filter("NOT waits").first() is not None
        left, wave = now.filter("waits").drop("waits"), wave + 1
        if not ready:
            break
    return spark.read.schema(StructType([*keys, StructField("waits", BooleanType()), StructField("wave", IntegerType())])).parquet(at).filter("NOT waits").select("g", "task_id", "wave")


@query("WITH RECURSIVE" + CHAIN + ", w AS (SELECT invocation_id AS g, task_id, 1 AS wave FROM chain WHERE task_id = 0 UNION ALL SELECT w.g, c.task_id, w.wave + 1 FROM w JOIN chain c ON c.invocation_id = w.g AND c.task_id = w.task_id + 1) SELECT g, task_id, max(wave) AS wave FROM w GROUP BY g, task_id")
def task_waves(spark: SparkSession, d: str) -> DataFrame:
    """Bulk-synchronous waves of the task chains."""
    return waves(*chain_graph(spark, d))


#: Each task with all that it waits for, over edges whose ends are both declared; and the tasks on cycles.
REACH = "WITH RECURSIVE " + DAG + """, inner_edges AS (SELECT d.* FROM dag d JOIN t ON d.workflow_id = t.workflow_id AND d.dep_id = t.task_id),
reach AS (SELECT workflow_id, task_id, dep_id FROM inner_edges UNION SELECT r.workflow_id, r.task_id, i.dep_id FROM reach r JOIN inner_edges i ON i.workflow_id = r.workflow_id AND i.task_id = r.dep_id),
cyclic AS (SELECT DISTINCT workflow_id, task_id FROM reach WHERE task_id = dep_id)"""


@query(REACH + """, stuck AS (SELECT workflow_id, task_id FROM cyclic UNION SELECT r.workflow_id, r.task_id FROM reach r JOIN cyclic c ON c.workflow_id = r.workflow_id AND c.task_id = r.dep_id),
free AS (SELECT t.* FROM t ANTI JOIN stuck s ON t.workflow_id = s.workflow_id AND t.task_id = s.task_id),
w AS (SELECT workflow_id, task_id, 1 AS wave FROM free f WHERE NOT EXISTS (SELECT 1 FROM inner_edges i WHERE i.workflow_id = f.workflow_id AND i.task_id = f.task_id)
  UNION SELECT w.workflow_id, i.task_id, w.wave + 1 FROM w JOIN inner_edges i ON i.workflow_id = w.workflow_id AND i.dep_id = w.task_id JOIN free f ON f.workflow_id = i.workflow_id AND f.task_id = i.task_id)
SELECT workflow_id, task_id, max(wave)::INTEGER AS wave FROM w GROUP BY workflow_id, task_id""")
def dag_waves(spark: SparkSession, d: str) -> DataFrame:
    """Waves of graphs where a task waits for the later of two; those on or behind a cycle have none."""
    return _waves(*dag_rows(spark, d)).withColumnRenamed("g", "workflow_id")


def dag_rows(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The graphs of dag() as rows for peeled(), and into how many partitions they go."""
    rows = dag(spark, d).withColumnRenamed("workflow_id", "g").withColumn("declared", F.lit(True))
    return rows, parts(table(spark, d, "lineitem"))


# What to do next, for every graph at once: abort after a failure, run the horizon, prepare what follows.


@query(ROOTS + " SELECT g, task_id, 'run' AS action FROM roots WHERE g NOT IN (SELECT g FROM failed) UNION ALL SELECT g, NULL, 'abort' FROM failed")
def schedule_horizon(spark: SparkSession, d: str) -> DataFrame:
    return horizon(*chain_graph(spark, d))


def horizon(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    failed = nodes.filter("status = 'FAILED'").select("g").distinct()
    run = roots(nodes.filter("status IS NULL"), edges).join(failed, "g", "left_anti").withColumn("action", F.lit("run"))
    return run.unionByName(failed.select("g", F.lit(None).cast("long").alias("task_id"), F.lit("abort").alias("action")))


#: What a cold start takes, in milliseconds, unless told.
COLD_START_MS = 1000


def prewarm_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The horizon, and every other open task prepared."""
    failed, open_nodes = nodes.filter("status = 'FAILED'").select("g"), nodes.filter("status IS NULL")
    rest = open_nodes.select("g", "task_id").join(failed, "g", "left_anti").join(roots(open_nodes, edges), KEY, "left_anti")
    return horizon(nodes, edges).unionByName(rest.withColumn("action", F.lit("prepare")))


def prewarm_horizon(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The horizon, and the tasks that are next once it is done."""
    failed, open_nodes = nodes.filter("status = 'FAILED'").select("g"), nodes.filter("status IS NULL")
    rest = open_nodes.join(failed, "g", "left_anti").join(roots(open_nodes, edges), KEY, "left_anti")
    return horizon(nodes, edges).unionByName(roots(rest, edges).withColumn("action", F.lit("prepare")))


#: Policies by name: (nodes, edges) -> g, task_id, action.
POLICIES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"horizon": horizon, "prewarm-all": prewarm_all, "prewarm-horizon": prewarm_horizon}
#: The order in which a graph's actions are taken.
ACTION_ORDER = ["abort", "prepare", "run"]


def schedule(nodes: DataFrame, edges: DataFrame, policy: str = "horizon", at: Column | None = None, cold_start_ms: int = COLD_START_MS) -> DataFrame:
    """g, task_id, action, expected_at, position: what a policy does with each graph, in the order it is done.

    expected_at is when a prepared task is wanted: now plus a cold start; null for other actions."""
    actions = POLICIES[policy](nodes, edges)
    wanted = (F.current_timestamp() if at is None else at) + F.make_dt_interval(secs=F.lit(cold_start_ms / 1000))
    w = Window.partitionBy("g").orderBy(F.array_position(F.array(*map(F.lit, ACTION_ORDER)), F.col("action")), "task_id")
    return actions.select("g", "task_id", "action", F.when(F.col("action") == "prepare", wanted).alias("expected_at"), F.row_number().over(w).cast("long").alias("position"))


PREPARE_ALL = ROOTS + " SELECT g, task_id, 'run' AS action FROM roots WHERE g NOT IN (SELECT g FROM failed) UNION ALL SELECT g, NULL, 'abort' FROM failed UNION ALL SELECT g, task_id, 'prepare' FROM open o WHERE g NOT IN (SELECT g FROM failed) AND NOT EXISTS (SELECT 1 FROM roots r WHERE r.g = o.g AND r.task_id = o.task_id)"


@query(PREPARE_ALL)
def schedule_prewarm_all(spark: SparkSession, d: str) -> DataFrame:
    return prewarm_all(*chain_graph(spark, d))


@query(
    ROOTS
    + """, next AS (SELECT g, task_id FROM open o WHERE NOT EXISTS (SELECT 1 FROM roots r WHERE r.g = o.g AND r.task_id = o.task_id)),
ne AS (SELECT oe.g, oe.task_id FROM oe JOIN next n ON oe.g = n.g AND oe.dep_id = n.task_id)
SELECT g, task_id, 'run' AS action FROM roots WHERE g NOT IN (SELECT g FROM failed) UNION ALL SELECT g, NULL, 'abort' FROM failed
UNION ALL SELECT g, task_id, 'prepare' FROM next n WHERE g NOT IN (SELECT g FROM failed) AND NOT EXISTS (SELECT 1 FROM ne WHERE ne.g = n.g AND ne.task_id = n.task_id)"""
)
def schedule_prewarm_horizon(spark: SparkSession, d: str) -> DataFrame:
    return prewarm_horizon(*chain_graph(spark, d))


@query("SELECT *, CASE WHEN action = 'prepare' THEN TIMESTAMP '1998-01-01 00:10:02.5' END AS expected_at, row_number() OVER (PARTITION BY g ORDER BY action, task_id) AS position FROM (" + PREPARE_ALL + ")")
def schedule_policy(spark: SparkSession, d: str) -> DataFrame:
    """A policy by name: actions in the order they are taken, tasks prepared for a cold start of 2.5 s from now."""
    now = F.lit("1998-01-01 00:10:00").cast("timestamp")
    return schedule(*chain_graph(spark, d), policy="prewarm-all", at=now, cold_start_ms=2500)


# Validation.


@query("WITH " + DAG + " SELECT workflow_id, task_id, dep_id FROM dag WHERE dep_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dag t WHERE t.workflow_id = dag.workflow_id AND t.task_id = dag.dep_id)")
def undefined_deps(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies on tasks that are not declared."""
    n = parts(table(spark, d, "lineitem"))
    edges = spread(dag(spark, d).filter("dep_id IS NOT NULL"), n, "workflow_id", "dep_id")
    tasks = dag_tasks(spark, d).select("workflow_id", F.col("task_id").alias("dep_id"))
    return edges.join(tasks, ["workflow_id", "dep_id"], "left_anti").select("workflow_id", "task_id", "dep_id")


def on_or_behind_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks that never become ready, in rounds."""
    return nodes.select("g", "task_id").distinct().join(waves_in_rounds(nodes, edges), KEY, "left_anti")


@query(REACH + " SELECT workflow_id, task_id FROM cyclic")
def cycle_detection(spark: SparkSession, d: str) -> DataFrame:
    """Tasks on a cycle: those behind one are peeled from the other end."""
    return on_cycles(*dag_rows(spark, d)).withColumnRenamed("g", "workflow_id")


def on_cycles(rows: DataFrame, n: int) -> DataFrame:
    """g, task_id on a cycle, of rows for peeled()."""
    small, large = peeled(rows, n)
    found = small.filter("cyclic").select(*KEY)
    if large is None:
        return found
    nodes, edges = _apart(large)
    stuck = stored(on_or_behind_cycles(nodes, edges), "stuck")
    back = edges_within(edges, stuck).select("g", F.col("dep_id").alias("task_id"), F.col("task_id").alias("dep_id"))
    return found.unionByName(on_or_behind_cycles(stuck, back))


@query(
    REACH
    + """, w AS (SELECT workflow_id, count(*) FILTER (WHERE dep_id IS NULL) AS starts, count(*) FILTER (WHERE dep_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.workflow_id = dag.workflow_id AND t.task_id = dag.dep_id)) AS gaps FROM dag GROUP BY workflow_id)
SELECT w.workflow_id, concat_ws(',', CASE WHEN gaps > 0 THEN 'undefined dependency' END, CASE WHEN c.workflow_id IS NOT NULL THEN 'cycle' END, CASE WHEN starts = 0 THEN 'no start task' END) AS errors FROM w LEFT JOIN (SELECT DISTINCT workflow_id FROM cyclic) c USING (workflow_id)"""
)
def workflow_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that each workflow breaks; none stops the others."""
    found = {"start": dag(spark, d).filter("dep_id IS NULL"), "gap": undefined_deps(spark, d), "cycle": cycle_detection(spark, d), "any": dag_tasks(spark, d)}
    rows = [df.select("workflow_id", *[F.lit(k == kind).alias(k) for k in found]) for kind, df in found.items()]
    n = parts(table(spark, d, "lineitem"))
    all_ = spread(reduce(DataFrame.unionByName, rows), n, "workflow_id").groupBy("workflow_id").agg(*[F.bool_or(k).alias(k) for k in found])
    rules = [(F.col("gap"), "undefined dependency"), (F.col("cycle"), "cycle"), (~F.col("start"), "no start task")]
    return all_.select("workflow_id", F.array_join(F.array_compact(F.array(*[F.when(c, m) for c, m in rules])), ",").alias("errors"))
