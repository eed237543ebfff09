"""Token counts by a separator scan of flat, unindexed token files.

A token file is a run of 16-bit token ids, documents ended by a separator, kept as a table of
fixed-size blocks (file, block, tokens) that are cut without regard to documents. Each block is
searched on its own with a vectorised comparison; a prefix scan over the blocks' summaries (their
tokens, separators, and last separator) then says which document of the file a block's first piece
belongs to and where that document began, so pieces that cross blocks are stitched.

Defined results: null and empty texts have 0 tokens; separators inside a text are encoded as ordinary
text and end nothing; tokens after a file's last separator are a last document without one; repeated
rows count each by itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import cut, stored, text_batches

#: Tokens in a block, and the separator of the default vocabulary.
BLOCK, SEPARATOR = 1 << 16, 50256


def as_tokens(v: bpe.Vocabulary, ids: tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}H", *ids)


def token_files(docs: DataFrame, path: str | None = None, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """Encode all whole texts into token files, one for each partition, stored.

    Rows with tokens are blocks; rows with doc_ids are the manifest: the file's documents in order,
    from ordinal first_doc on, without their places."""
    text_batches(docs.sparkSession)
    vocabulary = bpe.shared_vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.encoder(vocabulary.value, as_tokens, special=False, cached=bpe.CACHED_WORDS // 2)
        file, number, ordinal, rest = TaskContext.get().partitionId(), 0, 0, b""
        end = np.array([separator], "<u2").tobytes()
        kinds = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
        gc.disable()  # nothing here is cyclic
        try:
            for b in cut(batches, bpe.ROWS):
                texts = b.column(1).to_pylist()
                known = e.batch(texts)
                split = [next(known) for _ in texts]
                rest += b"".join(b"".join([*map(e.of.__getitem__, s), end]) for s in split)
                next(known, None)
                whole = len(rest) // (2 * block)
                rows = [{"file": file, "block": number + i, "tokens": rest[2 * block * i : 2 * block * (i + 1)]} for i in range(whole)]
                rows.append({"file": file, "first_doc": ordinal, "doc_ids": b.column(0).to_pylist()})
                rest, number, ordinal = rest[2 * block * whole :], number + whole, ordinal + len(texts)
                yield pa.RecordBatch.from_pylist(rows, kinds)
            if rest:
                yield pa.RecordBatch.from_pylist([{"file": file, "block": number, "tokens": rest}], kinds)
        finally:
            gc.enable()

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file long, block long, tokens binary, first_doc long, doc_ids array<long>")
    return stored(out, "token-files")


def scan(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """file, ordinal, start, n_tokens: every document of the token files, by file and order in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 64):
            n, ends = [], []
            for tokens in b.column(2):
                ids = np.frombuffer(tokens.as_buffer(), "<u2")
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == separator))
            last = [int(x[-1]) if len(x) else None for x in ends]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([len(x) for x in ends], pa.int64()), pa.array(last, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "n", "seps", "last", "ends"])

    text_batches(blocks.sparkSession)
    found = blocks.select("file", "block", "tokens").mapInArrow(run, "file long, block long, n long, seps long, last long, ends array<long>")
    found = stored(found, "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    summary = found.select("file", "block", "n", "seps", "last").withColumn("start", F.coalesce(F.sum("n").over(before), zero))
    summary = summary.withColumn("first", F.coalesce(F.sum("seps").over(before), zero)).withColumn("open", F.coalesce(F.max(F.col("start") + F.col("last") + 1).over(before), zero))
    placed = found.select("file", "block", "ends").join(summary.select("file", "block", "start", "first", "open"), ["file", "block"])
    inner = placed.select("file", "first", "start", "open", "ends", F.posexplode("ends").alias("i", "at"))
    begin = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("start") + F.try_element_at("ends", F.col("i")) + 1)
    closed = inner.select("file", (F.col("first") + F.col("i")).alias("ordinal"), begin.alias("start"), (F.col("start") + F.col("at") - begin).alias("n_tokens"))
    tail = summary.groupBy("file").agg(F.sum("n").alias("total"), F.sum("seps").alias("ordinal"), F.max(F.col("start") + F.col("last") + 1).alias("begin"))
    tail = tail.select("file", "ordinal", F.coalesce("begin", zero).alias("start"), (F.col("total") - F.coalesce("begin", zero)).alias("n_tokens")).filter("n_tokens > 0")
    return closed.unionByName(tail)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, file, start: the token count of every document, as the separators say."""
    files = token_files(docs)
    counts = scan(files.filter("tokens IS NOT NULL"))
    manifest = files.filter("doc_ids IS NOT NULL").select("file", "first_doc", F.posexplode("doc_ids").alias("i", "doc_id"))
    manifest = manifest.select(F.col("file").alias("f"), (F.col("first_doc") + F.col("i")).alias("o"), "doc_id")
    return manifest.join(counts, (F.col("f") == F.col("file")) & (F.col("o") == F.col("ordinal"))).select("doc_id", "n_tokens", "file", "start")
