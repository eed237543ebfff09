"""BPE against the tokenizers library."""

import hashlib
import time

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillflow.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.default_path())
LIBRARY.no_padding()
LIBRARY.no_truncation()


@pytest.fixture(scope="module")
def own():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.Encoder(bpe.Vocabulary(f.read()))


def same(own, text):
    known = own.batch([text])
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert own.ids(next(known)) == want, text[:200]
    next(known, None)
    assert own.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


ODD = ["", " ", "a   b\n  c \t d ", " a", "  ", "a", "aaa aaaa aaaaaaaa" * 5, "a" * 3000, "x<|endoftext|> y<|endoftext|>", "a\u0085b  c\x1c\x1d d​e f\t\n\r\x0b\x0c  g", "I'm we'll 'S don't", "日本語 😀😀 é é ½ ² Ⅷ ٣", "\x00\x01\x7f", "=" * 500, "\n" * 200 + "x", "ǅ ʰ ª"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(own, text):
    same(own, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(own, text):
    same(own, text)


def test_documents(own):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    t = time.time()
    for text in texts:
        if text is not None:
            same(own, text)
    print(sum(map(len, texts)) / (time.time() - t) / 1e6, "MB/s")


def test_operator(spark):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, "a", "a"])] + [(None, "word", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.ids_sha256, r.n_tokens) for r in bpe.digests(docs).collect()}
    sha = lambda t: hashlib.sha256(",".join(map(str, t)).encode()).hexdigest()
    want = set()
    for i, t, _ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.add((i, sha(ids), len(ids)))
    assert got == want and bpe.digests(docs).count() == len(rows)
    assert {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs)).collect()} == {(i, t or "") for i, t, _ in rows}
    assert bpe.digests(docs.limit(0)).count() == 0
