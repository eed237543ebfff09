"""Resharding: the flow against the least that must move, and the laws of the layout."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rillflow.llm import sharding


@pytest.mark.parametrize("seed", range(20))
def test_flow_moves_the_fewest_bytes(seed):
    rng = random.Random(seed)
    old = [rng.randrange(0, 1000) for _ in range(rng.randrange(1, 9))]
    new = sharding.capacities(sum(old), rng.randrange(1, 9))
    moves = sharding.transfers(old, new)
    assert [sum(n for _, n in moves.get(i, [])) for i in range(len(old))] == old
    got = Counter()
    for parts in moves.values():
        for j, n in parts:
            got[j] += n
    assert [got[j] for j in range(len(new))] == new
    stays = sum(min(a, b) for a, b in zip(old, new))
    assert sum(n for i, parts in moves.items() for j, n in parts if j != i) == sum(old) - stays


def check(rows, spark, docs):
    got = sharding.report(docs).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, load = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, load


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, load = check([(r.doc_id, r.text) for r in docs.collect()], spark, docs)
    mean = sum(load.values()) / 40
    assert max(load.values()) < 1.04 * mean and min(load.values()) > 0.96 * mean, load
    assert sorted(map(str, got)) == sorted(map(str, sharding.report(docs.repartition(5)).collect()))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "é😀"), (None, "é😀"), (5, "x" * 300000), *[(i, "same") for i in range(10, 400)]]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, shard int")
    check(rows, spark, docs)
    assert sharding.report(docs.limit(0)).count() == 0


def test_rewrite_keeps_every_row(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * (i % 70)) for i in range(900)], "doc_id long, text string")
    changed = sharding.rewritten(docs, str(tmp_path / "out"), F.col("doc_id") % 4, 4)
    rows, moves = sharding.placed(docs, F.col("doc_id") % 4, 4)
    want = {(r.doc_id, r.shard) for r in rows.collect() if r.shard in changed}
    assert {(r.doc_id, r.shard) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    moved = sum(r["size"] for r in rows.collect() if r.shard != r.doc_id % 4)
    planned = sum(n for i, parts in moves.items() for j, n in parts if j != i)
    assert abs(moved - planned) < 100 * 8
