"""Separator scans against plain splitting, and counts against the tokenizers library."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from rillflow.llm import bpe, separators


def blocks_of(files, size):
    return [(f, i, np.array(t[i * size : (i + 1) * size], "<u2").tobytes()) for f, t in enumerate(files) for i in range(-(-len(t) // size))]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_scan_stitches_across_blocks(spark, size):
    rng = np.random.default_rng(size)
    files = [rng.choice([9, 1, 2, 3, 4, 5], int(n), p=[0.1, 0.5, 0.1, 0.1, 0.1, 0.1]).tolist() for n in rng.integers(1, 300, 6)] + [[9], [1, 1], [9, 9, 9], [1] * 50 + [9]]
    got = separators.scan(spark.createDataFrame(blocks_of(files, size), "file long, block long, tokens binary"), 9)
    want = set()
    for f, t in enumerate(files):
        start, ordinal = 0, 0
        for i, x in enumerate(t):
            if x == 9:
                want.add((f, ordinal, start, i - start))
                start, ordinal = i + 1, ordinal + 1
        if start < len(t):
            want.add((f, ordinal, start, len(t) - start))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_counts_match_the_library(spark):
    library = Tokenizer.from_file(bpe.default_path())
    library.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(9001, None), (9002, ""), (9002, ""), (None, "a b"), (9003, "x<|endoftext|>y"), (9004, "long " * 90000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, file int")
    got = sorted(((r.doc_id, r.n_tokens) for r in separators.report(docs).collect()), key=str)
    assert got == sorted(((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    assert separators.report(docs.limit(0)).count() == 0
