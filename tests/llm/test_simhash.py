"""SimHash components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from rillflow.llm import simhash


def plain_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    comp = list(range(len(fps)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= 4):
            comp[find(i)] = find(int(j))
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if least.get(r) is None else d if d is not None and d < least[r] else least[r]
    return [least[find(i)] for i in range(len(ids))]


def compare(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted(map(tuple, simhash.report(docs).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components([i for i, _ in rows], fps))), key=str)
    assert got == want


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    compare(spark, [(r.doc_id, r.text) for r in docs])


def test_odd_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(70000))
    compare(spark, [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "a b c d"), (7, "a b c d e"), (8, long), (9, long.upper()), (9, long), (None, "x y"), (11, "é É z\x1cq")])
    assert simhash.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("refine", [10**6, 40])
def test_dense_groups_in_many_trees(spark, monkeypatch, refine):
    monkeypatch.setattr(simhash, "TREE", 16)
    monkeypatch.setattr(simhash, "REFINE", refine)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 5, np.uint64)
    fps = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 7)), False)) for c in centres for _ in range(120)] + rng.integers(0, 2**64, 300, np.uint64).tolist()
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in fps], "fp long")
    roots = {r.fp: r.root for r in simhash.joined_up(simhash.links(nodes)).collect()}
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    want = plain_components(signed, fps)
    assert [roots.get(s, s) for s in signed] == want


def test_tree_search_is_exact():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**10, 400).astype(np.uint64) | (np.uint64(1) << np.uint64(63))
    tree = rng.integers(0, 5, 400)
    forest = simhash.Forest(tree, fp)
    got = {(int(q), int(n)) for a, b in forest.search(tree, fp, 2) for q, n in zip(a, b)}
    assert got == {(i, j) for i in range(400) for j in range(400) if tree[i] == tree[j] and int(fp[i] ^ fp[j]).bit_count() <= 2}


def test_keep_one(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(3, "same text here now"), (1, "same text here now"), (1, "same text here now"), (2, "other words stand here alone"), (None, "a null id here too"), (None, "and quite another one without any")]], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in simhash.keep_one(docs).collect()) == [0, 0, 1, 2]
