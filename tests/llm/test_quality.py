"""Quality: gradients against differences, held-out accuracy, odd rows."""

import zlib

import numpy as np

from rillflow.llm import quality


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = quality.Attention.new(rng)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, first, y = rng.random((7, quality.SIZE)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, first)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = model.gradients(x, first, y)
    for k, v in model.p.items():
        for i in rng.integers(0, v.size, 4):
            flat = v.reshape(-1)
            keep, flat[i] = flat[i], flat[i] + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-5 - grad[k].reshape(-1)[i]) < 1e-6


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = quality.report(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out]
    print("held out", len(held), "AUC", auc(held.score.values, held.quality.values), "accuracy", ((held.score >= 0.3) == held.quality).mean(), "clean kept", held[held.quality == 1].predicted.mean(), "bad caught", 1 - held[held.quality == 0].predicted.mean())
    assert auc(held.score.values, held.quality.values) > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.98


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "w " * 50000, 1), (None, "x", 1), (3, "w", 1), (3, "w", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = quality.report(docs, lab).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert quality.accepted(docs, lab).columns == docs.columns
    assert quality.report(docs.limit(0), labels).count() == 0
