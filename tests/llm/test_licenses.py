"""Licence scans against a plain word scan, and near notices against edits made on purpose."""

import random
import re

from rillflow.llm import licenses

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def plain(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    hits = [(i, label) for label, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


ODD = [None, "", "Under the MIT License", "under-the_mit license! Under THE mit license", "cc by nc cc by nc by nc", "thunder the mit license", "éunder the mit license", "Apache License, Version 2.0", "Apache License, Version 2 CC-BY-NC", "Kunder the mit license", "word " * 30000 + "under the mit license"]


def test_documents_and_odd_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, ODD[2]), (10_002, ODD[2])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, labels string")
    got = licenses.report(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *plain(t)) for i, t in rows), key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.report(docs.limit(0)).count() == 0


def test_near_notices_are_found_with_spans():
    s = licenses.Scanner()
    f = s.scan("one two Relased undr the MIT licence here")
    assert f.base == [] and f.near == [("mit", 3, 6, 2)] and 0.8 < f.score < 1
    assert s.scan("under the mpl license").near == [] and s.scan("cc by nd").near == []
    rng = random.Random(5)
    n = licenses.notice("gnu general public license version 3", "gnu", "gpl-3")
    for _ in range(200):
        raw = list("gnu general public license version 3")
        for _ in range(n.errors):
            i = rng.randrange(4, len(raw) - 1)
            raw[i : i + rng.randrange(2)] = [rng.choice("abcxyz ")] * rng.randrange(2) or raw[i : i + 1]
        found = s.scan("filler words " * 5 + "".join(raw) + " more filler").near
        assert any(x[0] == "gpl-3" for x in found), "".join(raw)


def test_windows_miss_nothing_that_a_full_search_finds(spark):
    s = licenses.Scanner()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500").orderBy("doc_id").limit(25).collect():
        line = b" " + b" ".join((r.text or "").encode().translate(licenses.WORDS).split()) + b" "
        for n in s.notices[:2]:
            assert bool(n.pattern.search(line)) == any(n.pattern.search(line, a, b) for a, b in s.windows(line, n))


def test_an_edit_may_stand_at_every_position():
    s = licenses.Scanner()
    for phrase, _, label in licenses.NOTICES:
        if len(phrase) < licenses.CHARS_AN_ERROR:
            continue
        for i in range(len(phrase)):
            for raw in (phrase[:i] + phrase[i + 1 :], phrase[:i] + "q" + phrase[i + 1 :], phrase[:i] + "q" + phrase[i:]):
                assert any(x[0] == label and x[3] <= 2 for x in s.scan(f"some words {raw} and others").near), raw
    f = s.scan("permission is hereby grantd free of charge to any person obtaining a copy")
    assert f.near == [("mit", 0, 12, 1)] and f.score > 0.98
    assert [x[0] for x in s.scan("redistributon and use in source and binary forms").near] == ["bsd"]
    assert [x[0] for x in s.scan("apachee license version 2").near] == ["apache-2"]


def test_rival_notices_are_told_apart():
    s = licenses.Scanner()
    for raw in ("under the mpl license", "under the nist license", "creative commons attribution commercial", "creative commons attribution comercial", "cc by nd"):
        assert s.scan(raw).near == [], raw
    assert [x[0] for x in s.scan("creative commons attribution non commercial").near] == ["cc-by-nc"]


def test_long_texts_of_matches_and_of_near_misses_take_seconds():
    import time

    began, s = time.time(), licenses.Scanner()
    n = len(s.scan("cc by nc " * 40_000).base)
    assert n == 40_000 and len(s.scan("under the mit licence " * 20_000).near) == 20_000
    assert not s.scan("permission is hereby " * 40_000).near
    assert time.time() - began < 30
