"""Mixing: sizes, targets and takes against plain Python."""

import re
from collections import defaultdict

import numpy as np

from rillflow.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string"


def rows_of(n=300):
    rng = np.random.default_rng(1)
    out = []
    for i in range(n):
        words = int(rng.integers(0, 400)) if i % 50 else 5000
        s = [None, "b", "a", "Z", "é", "\U0001f600", "￮"][int(rng.integers(0, 7))] if i % 3 else "hot"
        out.append((i, "  " + " \t\n"[i % 3].join(f"w{j}" for j in range(words)) + " ", "en", s, 0, "x"))
    return [*out, (1007, None, "en", "a", None, "x"), (1008, "", "en", "a", 0, "x"), out[5], out[5], (None, "one two", "en", None, 0, None)]


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 12345)) == list(range(n))


def test_targets_stop_and_are_shared_again():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    got = mixing.targets([1, 100, 1], [1, 2, 3])
    assert got[2] == 3.0 and got[0] == 3.0 and abs(sum(got) - 102) < 1e-9
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_takes(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.takes(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, count(r[1])) for r in rows)
    size, source = defaultdict(int), {r[0]: r[3] for r in rows}
    for r in rows:
        size[r[3]] += count(r[1])
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))])))
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - goal[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - goal[s]) <= 4 * mixing.BLOCK, (s, taken[s], goal[s])
    again = mixing.takes(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_texts_hold_the_words_taken(spark):
    docs = spark.createDataFrame(rows_of(120), SCHEMA)
    key = lambda r: (r.doc_id is None, r.doc_id)
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.takes(docs).collect():
        want[key(r)] += r.taken
    for r in mixing.mixed(docs).collect():
        got[key(r)] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.takes(docs).count() == 0 and mixing.mixed(docs).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)
    assert [(r.size, r.taken, r.target) for r in mixing.takes(nothing).collect()] == [(0, 0, 0.0)]


def test_inverse_permutation():
    for n in (1, 2, 3, 64, 1000):
        x = np.arange(n)
        assert (mixing.permute(mixing.permute(x, n, 77), n, 77, back=True) == x).all()


def test_small_sources_meet_their_targets_in_words(spark):
    sizes = {"a": 5000, "b": 200, "c": 70, "d": 30, "e": 10, "f": 1, "g": 777, None: 10}
    rows, i = [], 0
    for s, n in sizes.items():
        while n:
            m = min(n, 23)
            rows.append((i, " ".join(f"w{j}" for j in range(m)), "en", s, 0, None))
            i, n = i + 1, n - m
    for some in (rows, [r for r in rows if r[3] in ("b", "d", "g")]):
        docs, of = spark.createDataFrame(some, SCHEMA), {r[0]: r[3] for r in some}
        taken, goal, texts = defaultdict(int), {}, defaultdict(int)
        for r in mixing.takes(docs).collect():
            taken[of[r.doc_id]] += r.taken
            goal[of[r.doc_id]] = r.target
            assert 0 <= r.taken <= 3 * r.size
        for r in mixing.mixed(docs).collect():
            texts[of[r.doc_id]] += len(r.text.split())
        assert dict(taken) == {s: round(t) for s, t in goal.items()} == dict(texts)


def test_repeated_rows_and_ids_beyond_doubles_and_inner_names(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 8)
    inner = ["size", "src", "start", "__row", "__order", "__size", "__whole", "__hot", "uses", "part"]
    big = [2**60 + 1, 2**60 + 3, None]
    rows = [(i, f"w{i} x y", "s", 9, *inner) for i in big] + [(None, None, "s", 0, *inner)] * 100 + [(7, "same words here", "t", 0, *inner)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in inner))
    got = mixing.takes(docs).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == round(sum(r.size for r in got))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {*big, 7} and all(list(r[4:]) == inner for r in rows)
    assert sum(len(r.text.split()) for r in rows) == sum(r.taken for r in got)
    again = mixing.takes(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
