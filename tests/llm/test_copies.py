"""Near copies against all pairs of exact shingle sets."""

import random
import re

import numpy as np
import pytest

from rillflow.llm import copies, simhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    found, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted({r: min(d for (d, _), s in zip(rows, root) if s == r) for r in root}.values())


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")
    out = copies.keep_one(docs.repartition(3))
    assert out.columns == docs.columns
    return sorted(r.doc_id for r in out.collect())


def test_near_copies_of_all_sizes_against_all_pairs(spark):
    rng, texts = random.Random(2), [None, "", " ", "one", "ONE", "a b c d e", "a b c d f"]
    line = " ".join(f"common{i}" for i in range(14))
    for size in [6, 8, 9, 10, 12, 13, 20, 36, 68, 69, 130, 400]:
        for _ in range(3):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(words))
            for _ in range(5):
                near = list(words)
                for _ in range(rng.randrange(1, 2 + size // 35)):
                    near[rng.randrange(len(near))] = f"new{rng.randrange(99)}"
                texts.append(" ".join(near[rng.randrange(2) :] + [f"end{i}" for i in range(rng.randrange(1 + size // 9))]))
            texts.append(line + " " + " ".join(words[: rng.randrange(20)]))
    rows = list(enumerate(texts))
    want = plain_kept(rows)
    assert kept(spark, rows) == want and len(want) < len(rows) - 30


def test_a_chain_is_one_component_and_its_ends_are_not_compared_alone(spark):
    words = [f"w{i}" for i in range(104)]
    chain = [" ".join(words[4 * i : 4 * i + 64]) for i in range(10)]
    assert kept(spark, list(enumerate(chain))) == [0] == plain_kept(list(enumerate(chain)))


def test_copies_that_simhash_leaves_and_its_chance_hits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    assert kept(spark, rows) == plain_kept(rows)


def test_empty(spark):
    assert copies.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("tree", [8, 20])
def test_large_shards_are_dealt_out_and_lose_no_link(spark, monkeypatch, tree):
    monkeypatch.setattr(copies, "TREE", tree)
    rng, texts = random.Random(3), []
    for centre in range(2):
        words = [f"c{centre}w{i}" for i in range(90)]
        for _ in range(70):  # around the limit: some are linked only through others
            near = list(words)
            for _ in range(rng.randrange(9)):
                near[rng.randrange(len(near))] = f"new{rng.randrange(9)}"
            texts.append(" ".join(near))
    rows = list(enumerate(texts))
    assert kept(spark, rows) == plain_kept(rows)


def test_shards_of_many_units_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, 40).astype(np.uint32)) for _ in range(200)]
    fp = np.array([simhash.fingerprint(s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets], np.uint64)
    unit = np.sort(rng.integers(0, 12, 200))
    a, b = copies.Shards(unit, np.full(200, 2), np.arange(200), fp, sets).links()
    root = simhash.roots_of(a, b, 200)
    want = list(range(200))
    for i in range(200):
        for j in range(i):
            if unit[i] == unit[j] and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) and int(fp[i] ^ fp[j]).bit_count() <= copies.RADIUS:
                low, high = sorted((want[i], want[j]))
                want = [low if r == high else r for r in want]
    assert root.tolist() == want


def test_keep_one_keeps_columns_with_inner_names_and_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f", 5, 6, 7, 8), (1, "a b c d e f", 5, 6, 7, 8), (2, "a b c d e f", 1, 1, 1, 1), (3, "g h i j k l", 9, 9, 9, 9), (None, None, 0, 0, 0, 0), (None, "", 2, 2, 2, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, text_hash long, stays int, hash int")
    out = copies.keep_one(docs)
    assert out.columns == docs.columns
    got = sorted(map(tuple, out.collect()), key=str)
    assert [g for g in got if g[0]] == [rows[0], rows[3]] and len(got) == 3 and got[-1] in rows[4:]
