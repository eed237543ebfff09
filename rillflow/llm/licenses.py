"""Licence notices in texts: exact phrases, and near ones by seeds and bounded-error matching.

A notice within k edits of a phrase holds one of the phrase's k + 1 pieces unchanged (pigeonhole), so
exact finds of the pieces locate all candidates. A window around them that lacks over k of the phrase's characters
holds no such notice; in the others the regex library matches
the phrase with at most k errors, wherever they stand, and a match counts unless a rival of the notice
(the phrase with another word in place of its key word) is nearer. Texts are compared as words: ASCII letters in lower case, joined by single spaces.

Defined results: null and empty texts have no words and no labels, null first and last word, score 0;
repeated rows repeat; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_batches

#: Phrases that count wherever their words stand consecutively.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices that are matched with errors, their key word and label.
NOTICES = [
    ("under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "granted", "mit"),
    ("apache license version 2", "apache", "apache-2"),
    ("licensed under the apache license", "apache", "apache-2"),
    ("cc by nc", "nc", "cc-by-nc"),
    ("creative commons attribution noncommercial", "noncommercial", "cc-by-nc"),
    ("gnu general public license version 3", "gnu", "gpl-3"),
    ("gnu lesser general public license", "lesser", "lgpl"),
    ("redistribution and use in source and binary forms", "redistribution", "bsd"),
    ("mozilla public license version 2", "mozilla", "mpl-2"),
    ("all rights reserved", "reserved", "proprietary"),
]
#: Words in place of a key word that make another notice within reach of the errors.
RIVALS = {"mit": ("mpl", "nist"), "nc": ("nd", "sa"), "noncommercial": ("commercial",)}
#: One error for so many characters of a phrase.
CHARS_AN_ERROR = 10
#: Bytes to words: A-Z in lower case, digits, letters and all of beyond ASCII stay, the rest parts words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    phrase: bytes
    #: By errors less one, what finds a rival with no more errors.
    rivals: tuple[regex.Pattern | None, ...]
    label: str
    errors: int
    seeds: tuple[tuple[int, bytes], ...]
    #: The phrase's characters and how often they stand in it.
    letters: tuple[tuple[bytes, int], ...]
    pattern: regex.Pattern


def notice(phrase: str, key: str, label: str) -> Notice:
    raw, errors = phrase.encode(), len(phrase) // CHARS_AN_ERROR
    cuts = [len(raw) * i // (errors + 1) for i in range(errors + 2)]
    seeds = tuple((a, raw[a:b]) for a, b in zip(cuts, cuts[1:]))
    others = [regex.escape(phrase.replace(key, r).encode()) for r in RIVALS.get(key, ())]
    rivals = tuple(regex.compile(b"|".join(b"(?:%s){e<=%d}" % (o, e) for o in others)) if others else None for e in range(errors))
    return Notice(raw, rivals, label, errors, seeds, tuple((bytes([c]), n) for c, n in Counter(raw).items()), regex.compile(b"(?e)(?:" + regex.escape(raw) + b"){e<=%d}" % errors))


def places(line: bytes, what: bytes) -> Iterator[int]:
    at = line.find(what)
    while at >= 0:
        yield at
        at = line.find(what, at + 1)


@dataclass
class Scan:
    n_words: int
    base: list[tuple[int, str]]
    #: label, first and last word, edits
    near: list[tuple[str, int, int, int]]
    score: float


class Scanner:
    def __init__(self, notices: list[tuple[str, str, str]] = NOTICES) -> None:
        self.notices = [notice(*n) for n in notices]

    def windows(self, line: bytes, n: Notice) -> list[tuple[int, int]]:
        """Where a match may stand, merged where they meet."""
        spans = []
        for offset, seed in n.seeds:
            for at in places(line, seed):
                a, b = max(0, at - offset - n.errors), min(len(line), at - offset + len(n.phrase) + n.errors)
                if sum(max(0, m - line.count(c, a, b)) for c, m in n.letters) <= n.errors:
                    spans.append((a, b))
        spans.sort()
        out: list[tuple[int, int]] = []
        for a, b in spans:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def scan(self, text: str | None) -> Scan:
        words = (text or "").encode().translate(WORDS).split()
        line = b" " + b" ".join(words) + b" "
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        before = lambda at: int(np.searchsorted(spaces, at))  # noqa: E731  spaces before a place
        base = sorted((before(at), label) for phrase, label in BASE.items() for at in places(line, b" " + phrase.encode() + b" "))
        near, score = [], 1.0 if base else 0.0
        for n in self.notices:
            for a, b in self.windows(line, n):
                for m in n.pattern.finditer(line, a, b):
                    edits = sum(m.fuzzy_counts)
                    if edits and n.rivals[edits - 1] and n.rivals[edits - 1].search(line, max(0, m.start() - n.errors), m.end() + n.errors):
                        continue
                    begin, end = m.start() + (m[0][:1] == b" "), m.end() - (m[0][-1:] == b" ")
                    near.append((n.label, before(begin) - 1, before(end) - 1, edits))
                    score = max(score, 1 - edits / len(n.phrase))
        return Scan(len(words), base, sorted(set(near)), score)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and the scan of each whole text: n_words, base and near notices with the words they span."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner()
        base_kind = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        near_kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
        for b in cut(batches):
            found = [s.scan(t) for t in b.column(1).to_pylist()]
            base = [[{"word": w, "label": x} for w, x in f.base] for f in found]
            near = [[dict(zip(("label", "first_word", "last_word", "edits"), n)) for n in f.near] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.n_words for f in found], pa.int64()), pa.array(base, base_kind), pa.array(near, near_kind), pa.array([f.score for f in found], pa.float64())], ["doc_id", "n_words", "base", "near", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, base array<struct<word:long,label:string>>, near array<struct<label:string,first_word:long,last_word:long,edits:int>>, score double")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, first and last base place, labels and score."""
    base_labels = F.array_sort(F.array_distinct(F.col("base.label")))
    return spans(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.word")).alias("first_word"),
        F.array_max(F.col("base.word")).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("near.label"))), ",").alias("labels"),
        "score",
        F.size("near").cast("long").alias("n_near"),
    )
