"""Exact top-k against brute force."""

import math

import numpy as np
import pytest

from rillflow.llm import annuli


def brute(rows, top=20, every=20):
    use = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(use):
        if q is None or q % every:
            continue
        got = sorted(((-sum(s * t for s, t in zip(x, y)), i is None, i) for b, (i, y) in enumerate(use) if b != a))[:top]
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(got, 1)]
    return sorted(out, key=str)


def check(spark, rows, monkeypatch=None):
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = annuli.search(table)
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_embeddings(spark):
    check(spark, [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()])


@pytest.mark.parametrize("rows_a_pivot", [50, 4096])
def test_clustered_ties_and_odd_rows(spark, monkeypatch, rows_a_pivot):
    monkeypatch.setattr(annuli, "ROWS_A_PIVOT", rows_a_pivot)
    monkeypatch.setattr(annuli, "BLOCK", 64)
    monkeypatch.setattr(annuli, "SHARE", 2)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.05).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]
    rows += [(20, None), (40, [float("nan")] * 8), (60, [None] * 8), (80, [float("inf")] + [0.0] * 7), (100, [1.0]), (120, []), (-20, [9.0] * 8), (None, [8.0] * 8), (140, [3.0] * 8), (140, [3.0] * 8)]
    check(spark, rows)


def test_few_and_no_rows(spark):
    check(spark, [(20, [1.0, 2.0]), (1, [3.0, -1.0])])
    check(spark, [(20, [1.0])])
    check(spark, [])


def test_large_components_stay_exact():
    a = np.array([[2.0**31, 1.0], [-(2.0**31), 3.0]])
    assert annuli.products(a, a).tolist() == [[2**62 + 1, -(2**62) + 3], [-(2**62) + 3, 2**62 + 9]]


def test_query_matches_its_sql(spark):
    import duckdb

    from rillflow.llm import queries

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in queries.op10_top_k(spark, d).collect())
    assert got == sorted(con.execute("SELECT query_id, rank, vec_id, score FROM (" + queries.TOP_K + ")").fetchall())


def test_join_holds_blocks_of_a_share_and_not_the_queries(spark):
    # the right side of the merge join is buffered whole for each key: it must be the vectors, which a share bounds
    table = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(200)], "vec_id long, embedding array<float>")
    plan = annuli.search(table)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join Inner") :]
    assert "rightHint=(strategy=merge)" in join.splitlines()[0]
    left, right = (join.index(x) for x in ("q#", "__row#"))
    assert left < right


def test_ids_beyond_doubles_beside_a_missing_one(spark):
    big = 2**53
    check(spark, [(None, [1.0, 1.0]), (big + 1, [1.0, 1.0]), (big + 3, [1.0, 1.0]), (20, [2.0, 1.0])])


def test_narrowest_type():
    assert [annuli.narrowest(x) for x in (0.0, 127.0**2, 127.0**2 + 1, 2.0**31, 2.0**70)] == [np.int8, np.int8, np.int16, np.int32, np.float64]
