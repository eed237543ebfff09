"""Graphs of any shape and size: waves and cycles against a plain version."""

import random

import duckdb
import pytest

from rillflow.operators import graph
from rillflow.registry import ORACLES, QUERIES


def plain(nodes, edges):
    edges = {(g, t, d) for g, t, d in edges if (g, t) in nodes and (g, d) in nodes}
    wave, now = {}, 1
    while ready := [n for n in nodes if n not in wave and all((n[0], d) in wave for g, t, d in edges if (g, t) == n)]:
        wave |= dict.fromkeys(ready, now)
        now += 1
    stuck = {n for n in nodes if n not in wave}
    while free := {n for n in stuck if not any((g, d) == n and (g, t) in stuck for g, t, d in edges)}:
        stuck -= free
    return wave, stuck


@pytest.mark.parametrize("most", [1, 12, 4096])
def test_waves_and_cycles_of_odd_graphs(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "GRAPH_ROWS", most)
    r = random.Random(3)
    nodes = {(g, t) for g in range(30) for t in range(r.randrange(1, 14))}
    edges = [(g, r.randrange(15), r.randrange(15)) for g in range(31) for _ in range(r.choice([0, 4, 9]))]
    edges += [(5, None, 1), (5, 1, None), (None, 1, 1)]
    wave, cyclic = plain(nodes, [e for e in edges if None not in e])
    n = spark.createDataFrame([*nodes, *list(nodes)[:9], (None, 1), (None, 2)], "g long, task_id long")
    e = spark.createDataFrame(edges, "g long, task_id long, dep_id long")
    got = [tuple(x) for x in graph.waves(n, e).collect()]
    assert sorted(got, key=str) == sorted([(*k, v) for k, v in wave.items()] + [(None, 1, 1), (None, 2, 1)], key=str)
    assert sorted(map(tuple, graph.on_cycles(*graph._together(n, e)).collect())) == sorted(cyclic)


def test_ids_may_be_text(spark):
    n = spark.createDataFrame([("w", "a"), ("w", "b")], "g string, task_id string")
    assert sorted(map(tuple, graph.waves(n, spark.createDataFrame([("w", "b", "a")], "g string, task_id string, dep_id string")).collect())) == [("w", "a", 1), ("w", "b", 2)]


def test_small_graphs_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "waves_in_rounds", None)
    for q in (graph.dag_waves, graph.cycle_detection, graph.workflow_validation, graph.task_waves):
        assert q(spark, "/root/testdata/sf0.001").first() is not None


def test_validation_of_lines_without_order(spark, tmp_path):
    lines = [(None, 1), (None, 3), (None, 2), (13, 1), (13, 3), (7, 1), (22, 1), (22, 2), (5, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("workflow_validation", "cycle_detection", "undefined_deps", "start_tasks"):
        want = duck.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        got = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(want.fetchall(), key=str), name
