"""PII findings against a plain Python version, and the method on a small corpus."""

import hashlib
import re

from rillflow.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ODD = [
    None,
    "",
    "a@b.c_d@e.f.g x@y",
    "é😀 me@x.org 1.2.3.4.5 256.1.1.1 001.02.3.0004",
    "4785380592391139 4785-3805-9239-1139 1 2 3",
    "+1 (743) 555-3824 +1 +12345678( +" + "1" * 16,
    "a" * 20000 + "@" + ".".join("b" * 5 for _ in range(4000)),
    "7" * 30000,
    "+" * 2000 + "1",
]


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, terms string")
    got = pii.report(docs).collect()
    assert len(got) == len(rows)
    want = {(i, hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for i, t in rows}
    assert {(r.doc_id, r.base_sha256) for r in got} == want
    return got


def test_matches_plain_python_on_odd_texts(spark):
    check(spark, [*enumerate(ODD), (2, ODD[2]), (None, ODD[3])])


def test_matches_plain_python_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = check(spark, [(r.doc_id, r.text) for r in docs])
    assert sum(r.n_ip for r in got) > 0


def test_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_terms_that_stand_only_beside_an_entity_are_masked(spark):
    filler = "lorem ipsum dolor sit amet " * 20
    rows = [(i, filler + f"badge write to u{i}@corp.example.com now " + filler) for i in range(12)] + [(100 + i, filler + " write now to") for i in range(40)]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "badge" not in got[3].text and "@" not in got[3].text and "<email>" in got[3].text
    assert "write" in got[3].text and got[3].n_chars == len(got[3].text)
    assert got[105].text == dict(rows)[105]


def test_matches_plain_python_on_random_strings(spark):
    import random

    rng = random.Random(9)
    alphabets = ["ab1.@-_ ", "0123456789. ", "0123456789 -", "+12() .-3x", "aé@.1+ \U0001f600\n"]
    rows = [(i, "".join(rng.choice(alphabets[i % 5]) for _ in range(rng.randrange(60)))) for i in range(3000)]
    check(spark, rows)


def test_strong_terms_are_masked_in_all_texts_and_rare_ones_count(spark):
    filler = "lorem ipsum dolor sit amet " * 60
    rows = [(i, filler + f" Badge me at u{i}@corp.example.com " + filler) for i in range(60)]
    rows += [(100 + i, filler + f" zorro me at v{i}@corp.example.com, " + filler) for i in range(4)]
    rows += [(200, filler + " the BADGE, a badger; badge\n" + filler), (201, "u1@corp.example.com " + filler + " badge " + filler), (202, filler + " once me at w@corp.example.com " + filler)]
    rows += [(300 + i, filler + " me at") for i in range(200)]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    before, got = dict(rows), {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for i in (3, 200, 201):
        assert not re.search(r"(?i)\bbadge\b", got[i]), i
    assert "a badger;" in got[200] and got[300] == before[300]
    assert all("zorro" not in got[100 + i] for i in range(4))
    assert "once" in got[202]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    filler = "lorem ipsum dolor sit amet " * 60
    rows = [(i, filler + f" Badge me at u{i}@corp.example.com " + filler) for i in range(60)]
    rows += [(100 + i, filler + f" me at {1 + i}.2.3.4 beacon, " + filler) for i in range(30)]
    rows += [(200 + i, filler + " zorro at one@corp.example.com. " + filler) for i in range(3)] + [(250, filler + "ask zorro"), (251, "zorros ask Zorro\n" + filler), (252, None), (253, "")]
    rows += [(300 + i, filler + " me at beacon" * (i < 18)) for i in range(200)]
    return rows


def test_terms_disclose_single_entities_and_become_their_class(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], DOCS)
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert got[200].count("<email>") == 1 and "zorro" not in got[200] + got[250]  # beside one value only, not rare in its class
    assert got[251].startswith("zorros ask <email-term>\nlorem") and got[252] is None and got[253] == ""
    assert all("beacon" not in got[100 + i] and "<ip-term>" in got[100 + i] for i in range(30)) and "<ip-term>" in got[300]
    assert got[330] == dict(rows)[330]


def test_many_terms_are_shuffled_with_the_same_result(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in [*corpus(), corpus()[0]]], DOCS)
    listed = sorted(map(tuple, pii.sanitise(docs).collect()), key=str)
    spans = sorted(map(tuple, pii.report(docs).collect()), key=str)
    monkeypatch.setattr(pii, "sized_broadcast", lambda df, most=0: df.hint("merge"))
    assert sorted(map(tuple, pii.sanitise(docs).collect()), key=str) == listed
    assert sorted(map(tuple, pii.report(docs).collect()), key=str) == spans


def test_masks_against_plain_python_on_random_strings(spark):
    import random

    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab1.@-_ +4é\U0001f600") for _ in range(rng.randrange(80))) * (1 + 40 * (i % 50 == 0))) for i in range(600)]
    rows += [(1000, ("+1 (743) 555-3824 " + "é" * 700) * 9), (1001, "a@b.c" + " x" * 3000 + "1.2.3.4")]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], DOCS)
    terms = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    for r in pii.sanitise(docs).collect():
        text, found = dict(rows)[r.doc_id], sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in terms[r.doc_id].split(",") if x))
        out, at = "", 0
        for s, e, k in found:
            if s >= at:
                out += text[at:s] + ("" if k == "term_removed" else f"<{k}>" if not k.startswith("term") else "?")
            at = max(at, e)
        assert r.text == out + text[at:] or "?" in out
        assert r.n_chars == len(r.text)


def test_a_long_text_of_matches_takes_seconds(spark):
    import time

    texts = ["me@x.org " * 60_000, "12," * 200_000, "+1 (743) 555-3824, 1.2.3.4 " * 15_000]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(texts)], DOCS)
    began = time.time()
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert time.time() - began < 90
    assert (got[0].n_email, got[1].n_card, got[2].n_phone, got[2].n_ip) == (60_000, 0, 15_000, 15_000)
    assert clean[0] == "<email> " * 60_000 and clean[1] == texts[1] and clean[2] == "<phone>, <ip> " * 15_000


def test_columns_with_inner_names_pass_through(spark):
    inner = ["row", "__d", "__h", "__t", "__marks", "marks", "pieces", "terms", "email", "m_ip", "g_ip", "some", "d", "h", "m", "g", "strong"]
    docs = spark.createDataFrame([(1, "me@x.org", *inner), (2, "none", *inner)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in inner))
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "<email>", *inner), (2, "none", *inner)]
