"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded (shares of hashed word
shapes, of hashed words and of words repeated some places on, mean word length, size); gated attention weights, learnt from document labels
alone, say how much each passage counts; the weighted sum of the passages' representations is scored.

The model is fitted on TRAIN_DOCS labelled documents at most (those of the smallest hash of doc_id, one row
each, and no more of them than TRAIN_CHARS characters hold); everything else covers all rows. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts are one passage without words and get a score like any other;
repeated rows repeat; of rows that share a doc_id the model is fitted on the least text; a null doc_id is scored and not held out; without labels of both kinds the score
is the share of label 1 (0.5 without labels); an empty table gives an empty result; extra columns are
kept by scored() and accepted(), whatever their names, and ignored by report().
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from .common import cut, free_name, text_batches

PASSAGE = 32
#: Words back at which a word may be repeated: a share of the passage each.
LAGS = (1, 2, 3, 4, 5, 6, 8, 10)
SHAPES, WORDS, OTHER = 64, 128, 3 + len(LAGS)
SIZE = SHAPES + WORDS + OTHER
HIDDEN, GATE = 32, 16
TRAIN_DOCS, EPOCHS, BAGS, RATE, DECAY, SEED = 4000, 12, 64, 3e-3, 1e-4, 7
FOLDS, THRESHOLD = 5, 0.3
#: Characters of all texts that the model is fitted on: under 100 MB encoded.
TRAIN_CHARS = 1 << 25
#: Words whose codes are kept between batches.
CACHED_WORDS = 300_000


def shape(word: str) -> str:
    """The word with letters as X or x, digits as 9 and each run of a character once."""
    kinds = ("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return "".join(k for k, _ in groupby(kinds))


class PassageEncoder:
    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.codes) > CACHED_WORDS:
            self.codes = {}
        for w in words - self.codes.keys():
            s = zlib.crc32(shape(w).encode()) % SHAPES
            u = zlib.crc32(w.lower().strip(".,;:!?\"'()").encode()) % WORDS
            self.codes[w] = s | u << 8 | min(len(w), 255) << 16 | zlib.crc32(w.encode()) << 24

    def bags(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Encoded passages, and the first passage of each text."""
        split = [(t or "").split() for t in texts]
        self.learn(set().union(*split))
        n = np.array([len(s) for s in split], np.int64)
        passages = np.maximum(1, (n + PASSAGE // 2) // PASSAGE)
        first = np.cumsum(passages) - passages
        get = self.codes.__getitem__
        code = np.fromiter((c for s in split for c in map(get, s)), np.int64, int(n.sum()))
        inside = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(first, n) + np.minimum(inside // PASSAGE, np.repeat(passages - 1, n))
        total = int(passages.sum())
        x = np.zeros((total, SIZE), np.float32)
        count = np.bincount(at, minlength=total).astype(np.float32)
        each = np.maximum(count, 1)[:, None]
        x[:, :SHAPES] = np.bincount(at * SHAPES + (code & 255), minlength=total * SHAPES).reshape(total, -1) / each
        x[:, SHAPES : SHAPES + WORDS] = np.bincount(at * WORDS + (code >> 8 & 255), minlength=total * WORDS).reshape(total, -1) / each
        x[:, -3] = np.bincount(at, weights=code >> 16 & 255, minlength=total) / each[:, 0] / 8
        x[:, -2] = np.log1p(count) / 4
        x[:, -1] = count == 0
        for i, lag in enumerate(LAGS):
            same = (code[lag:] == code[:-lag]) & (at[lag:] == at[:-lag])
            x[:, SHAPES + WORDS + i] = np.bincount(at[lag:][same], minlength=total) / each[:, 0]
        return x, first


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Attention:
    """Gated attention over passages: w . (tanh(H V) * sigmoid(H U)), softmax in each bag."""

    p: dict[str, np.ndarray]
    constant: float | None = None

    @classmethod
    def new(cls, rng: np.random.Generator) -> Attention:
        draw = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
        p = {"W": draw(SIZE, HIDDEN) * 3, "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}
        return cls(p)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        bag = np.zeros(len(x), np.int64)
        bag[first[1:]] = 1
        bag = np.cumsum(bag)
        e = np.exp(s - np.maximum.reduceat(s, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "y": sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        h, t, g, a, bag = (f[k] for k in ("h", "t", "g", "a", "bag"))
        out = (f["y"] - label) / len(label)
        dz = out[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, first)[bag])
        dtg = ds[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        dp = dh * (1 - h * h)
        return {"W": x.T @ dp, "b": dp.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": f["z"].T @ out, "d": out.sum(keepdims=True)}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.full(len(first), self.constant) if self.constant is not None else self.forward(x, first)["y"].astype(np.float64)


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Attention:
    """Adam on the cross-entropy of the documents' labels."""
    rng = np.random.default_rng(SEED)
    model = Attention.new(rng)
    if len(set(labels.tolist())) < 2:
        model.constant = float(labels.mean()) if len(labels) else 0.5
        return model
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BAGS):
            take = order[i : i + BAGS]
            size = np.array([len(bags[j]) for j in take])
            grad = model.gradients(np.concatenate([bags[j] for j in take]), np.cumsum(size) - size, labels[take])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) ** 0.5
            for k, v in model.p.items():
                d = grad[k] + DECAY * v
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d * d
                v -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo FOLDS."""
    return F.crc32(doc_id.cast("string")) % FOLDS


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Attention:
    """The model, from TRAIN_DOCS labelled documents outside the held-out fold at most."""
    known = labels.filter(F.col(label).isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").alias("__id")).agg(F.min(label).alias("__label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_DOCS)
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = PassageEncoder()
        for b in cut(batches):
            x, first = e.bags(b.column(2).to_pylist())
            ends = [*first[1:].tolist(), len(x)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[i:j].astype(np.float16).tobytes() for i, j in zip(first.tolist(), ends)], pa.binary())], ["id", "label", "bag"])

    # the ids chosen are TRAIN_DOCS at most
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "__label").agg(F.min("text").alias("text"))
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of TRAIN_DOCS rows
    texts = texts.withColumn("__chars", so_far).filter(F.col("__chars") <= TRAIN_CHARS).select(F.col("doc_id").cast("long"), F.col("__label").cast("int"), "text")
    rows = texts.mapInArrow(run, "id long, label int, bag binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], r["bag"]))
    bags = [np.frombuffer(r["bag"], np.float16).astype(np.float32).reshape(-1, SIZE) for r in rows]
    return fit(bags, np.array([r["label"] for r in rows], np.float32))


def scored(docs: DataFrame, model: Attention, column: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1 of every whole text, in a column that docs has not."""
    text_batches(docs.sparkSession)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = PassageEncoder()
        gc.disable()  # nothing here is cyclic
        try:
            for b in cut(batches):
                y = shared.value.score(*e.bags(b.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(y, pa.float64())], [*b.schema.names, column])
        finally:
            gc.enable()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), trained(docs, labels)).drop("text")
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted to be of quality, unchanged."""
    name = free_name(docs, "score")
    return scored(docs, trained(docs, labels), name).filter(F.col(name) >= THRESHOLD).select([f"`{c}`" for c in docs.columns])
