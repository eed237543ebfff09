"""Mixing sources to target weights, in fixed-length blocks of words.

The words of each source, one document after another, are packed into blocks of BLOCK words. Every
output shard draws how many of its slots each source fills (multinomial, seeded by the shard). The
k-th slot that a source fills takes block perm(k mod n) of its n blocks, perm being the source's
pseudorandom permutation; slots and blocks are then joined by source and block index. Draws beyond a
source's quota go to the sources that were drawn too rarely, so quotas are met exactly, and no quota
is above 3 times a source's blocks, so no block is taken more than 3 times. A quota is the least number
of slots that hold the words of the target; the source's last slot is cut to what is wanted of it, so
every source gives its target's words, rounded.

Defined results: null texts have size 0 and take nothing; null sources form one source, last in
order; repeated rows are taken each by itself; an empty table gives an empty result; extra columns, whatever
their names and types, are ignored by takes() and kept by mixed(). Reruns agree, whatever the partitions.
The sources (names and sizes, some hundred bytes for each) are held on the driver and joined as a table; rows of
text never are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, cut, running_sum, sized_broadcast, stored, text_batches, whole_row

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: No source, and no document, is taken more than so many times.
MOST = 3
#: Fills (of SHARD slots at most) that are written at once, and slots that a task fills.
FILLS, SLOTS_A_TASK = 64, 1 << 20
#: Words in a block, slots in an output shard, documents in a bucket of the running offsets, shards in one of theirs.
BLOCK, SHARD, BUCKET, RUN = 64, 4096, 512, 4096
SEED = 20


def targets(sizes: list[int], weights: list[int]) -> list[float]:
    """Shares of all sizes by weight; each stops at MOST times its size and the excess is shared again."""
    out, left, still = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while still:
        each = left / sum(weights[i] for i in still)
        over = [i for i in still if each * weights[i] > MOST * sizes[i]]
        for i in over or still:
            out[i] = float(MOST * sizes[i]) if over else each * weights[i]
        left -= sum(out[i] for i in over)
        still = [i for i in still if i not in over] if over else []
    return out


@dataclass
class Sources:
    """One entry per source, in code-point order with null last."""

    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    quotas: list[int]
    #: Words that a source's last slot takes of its block.
    keeps: list[int]

    @classmethod
    def of(cls, sized: DataFrame) -> Sources:
        rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
        rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        sizes = [int(r["n"] or 0) for r in rows]
        goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
        blocks = [-(-n // BLOCK) for n in sizes]
        out = cls([r["source"] for r in rows], sizes, goal, blocks, [], [])
        for i in range(len(rows)):
            quota, keep = out.slots_for(i, round(goal[i]))
            out.quotas.append(quota)
            out.keeps.append(keep)
        return out

    def slots_for(self, i: int, words: int) -> tuple[int, int]:
        """The least slots of source i that hold so many words, and what the last of them takes of its block."""
        n, b = self.sizes[i], self.blocks[i]
        if not words:
            return 0, BLOCK
        rounds, rest = divmod(words, n)
        if not rest:
            return rounds * b, BLOCK
        lack = b * BLOCK - n  # of the source's last block, which comes at this place:
        last = int(permute(np.array([b - 1]), b, self.key(i), back=True)[0])
        k = -(-rest // BLOCK)
        if k <= last:
            return rounds * b + k, rest - (k - 1) * BLOCK
        k = -(-(rest + lack) // BLOCK)
        return rounds * b + k, rest - (k - 1) * BLOCK + (lack if k - 1 > last else 0)

    def key(self, i: int) -> int:
        name = self.names[i]
        return int.from_bytes(hashlib.blake2b(b"\0" if name is None else b"\1" + name.encode(), digest_size=8, key=str(SEED).encode()).digest(), "little")

    def table(self, spark: SparkSession) -> DataFrame:
        """source, src, source_size, target: a row for each."""
        kind = "name string, src int, source_size long, target double"
        return stored(spark.createDataFrame([(n, i, s, float(t)) for i, (n, s, t) in enumerate(zip(self.names, self.sizes, self.targets))], kind), "mix-sources")


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 (four Feistel rounds, walking back into range), or its inverse."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        if back:
            left, right = right, left
        for r in (3, 2, 1, 0) if back else range(4):
            mixed = (right + np.uint64((key + r * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) & mask)
        if back:
            left, right = right, left
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= n
    return out.astype(np.int64)


def numbered(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """doc_id, source and ``keep`` with a row id, fixed by storing them, a size, and an order that doesn't hang on partitions."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return stored(docs.select(F.monotonically_increasing_id().alias("__row"), size.alias("size"), F.xxhash64("doc_id", "text").alias("__order"), "doc_id", F.col("source").cast("string").alias("source"), *keep), "mix-rows")


def pieces(rows: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """__row, doc_id, size, src, source_size, target, block, from, words, at: the part of each block that each document
    fills, and its place there; a row with no words has no block."""
    of = rows.select("__row", "doc_id", "source", "size", "__order").join(sized_broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")
    of, levels = bucketed(of, 1, n_rows, BUCKET)
    at = running_sum(of, ["src"], levels, ["__order", "__row"], "size", "start")
    blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")))
    known = ["__row", "doc_id", "size", "src", "source_size", "target"]
    parts = at.select(*known, "start", F.explode_outer(blocks).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * BLOCK)
    return parts.select(*known, "block", (first - F.col("start")).alias("from"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - first).alias("words"), (first - F.col("block") * BLOCK).alias("at"))


def slots(spark: SparkSession, sources: Sources) -> DataFrame:
    """shard, src, k, block, keep: every slot of the mix, and how many words of the block it takes at most."""
    quota, keeps = np.array(sources.quotas, np.int64), np.array(sources.keeps, np.int64)
    total = int(quota.sum())
    n_shards = -(-total // SHARD)

    def table(rows: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
        whole = np.concatenate(rows, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in whole], names)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                n = np.random.default_rng([SEED, shard]).multinomial(min(SHARD, total - shard * SHARD), quota / total)
                some = np.flatnonzero(n)
                yield table([np.stack([np.full(len(some), shard), some, n[some]])], ["shard", "src", "n"])

    drawn = stored(spark.range(n_shards).mapInArrow(draw, "shard long, src long, n long").withColumn("run", F.expr(f"shard div {RUN}")), "mix-draws")
    per_source = {r["src"]: r["n"] for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect()} if n_shards else {}
    got = np.array([per_source.get(i, 0) for i in range(len(quota))], np.int64)
    over, short = np.maximum(got - quota, 0), np.maximum(quota - got, 0)
    over_at, short_at = np.cumsum(over) - over, np.cumsum(short)
    n_blocks, keys = sources.blocks, [sources.key(i) for i in range(len(quota))]
    names = ["shard", "src", "k", "block", "keep"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for shard, src, start, n in zip(*(c.to_pylist() for c in b.columns)):
                k = np.arange(start, start + n)
                of = np.full(n, src)
                if k[-1] >= quota[src]:  # beyond the quota: the next place of a source that is short
                    late = k >= quota[src]
                    u = k[late] - quota[src] + over_at[src]
                    of[late] = np.searchsorted(short_at, u, side="right")
                    k[late] = got[of[late]] + u - (short_at - short)[of[late]]
                block = np.empty(n, np.int64)
                for s in np.unique(of):
                    block[of == s] = permute(k[of == s] % n_blocks[s], n_blocks[s], keys[s])
                held.append(np.stack([np.full(n, shard), of, k, block, np.where(k == quota[of] - 1, keeps[of], BLOCK)]))
                if len(held) == FILLS:
                    yield table(held, names)
                    held.clear()
        if held:
            yield table(held, names)

    started = running_sum(drawn, ["src"], [["run"]], ["shard"], "n", "start")
    # few rows make many slots, so the number of tasks follows the slots
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SLOTS_A_TASK)
    return started.select("shard", "src", "start", "n").repartition(tasks, "shard").mapInArrow(fill, "shard long, src long, k long, block long, keep long")


def _joined(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    sources = Sources.of(rows.select("source", "size"))
    parts = pieces(rows, sources.table(spark), rows.count())
    uses = slots(spark, sources).groupBy("src", "block").agg(F.count(F.lit(1)).alias("uses"), F.min("keep").alias("keep"))
    joined = parts.join(uses.hint("merge"), ["src", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    # where one of the uses is cut, what it takes and the rest are parts of their own
    kept = F.greatest(F.lit(0), F.least("words", F.col("keep") - F.col("at")))
    part = lambda begin, words, n: F.struct(begin.cast("long").alias("from"), words.cast("long").alias("words"), n.cast("long").alias("uses"))
    whole = part(F.col("from"), F.col("words"), F.col("uses"))
    split = F.array(part(F.col("from"), kept, F.col("uses")), part(F.col("from") + kept, F.col("words") - kept, F.col("uses") - 1))
    each = F.explode(F.when(F.col("keep") < BLOCK, split).otherwise(F.array(whole))).alias("part")
    known = ["__row", "doc_id", "size", "source_size", "target"]
    return joined.select(*known, each).select(*known, "part.*")


def takes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of each document that the mix takes, repeats counted."""
    text_batches(docs.sparkSession)
    known = ["doc_id", "size", "source_size", "target"]
    out = _joined(numbered(docs)).groupBy("__row", *known).agg(F.sum(F.coalesce("words", F.lit(0)) * F.col("uses")).cast("long").alias("taken"))
    return out.select(*known, "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: the e-th row of a document has its text in the blocks that are taken e times or more."""
    text_batches(docs.sparkSession)
    rows = numbered(docs, whole_row(docs, "__whole"))
    parts = _joined(rows).filter("uses > 0 AND words > 0").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("from", "words", "uses"))).alias("parts"))
    word, columns, text_at = re.compile(WORD), docs.columns, docs.columns.index("text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            own = b.column(0).flatten()  # all but the text stays as it came
            at, texts = [], []
            for i, (text, size, taken) in enumerate(zip(own[text_at].to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
                begins = None
                for e in range(1, MOST + 1):
                    wanted = [(p["from"], p["from"] + p["words"]) for p in taken if p["uses"] >= e]
                    if not wanted:
                        break
                    at.append(i)
                    if sum(y - x for x, y in wanted) == size:
                        texts.append(text)
                        continue
                    if begins is None:
                        begins = [0, *[m.start() for m in word.finditer(text)][1:], len(text)]
                    texts.append("".join(text[begins[x] : begins[y]] for x, y in wanted))
            out = [c.take(pa.array(at, pa.int64())) for c in own]
            out[text_at] = pa.array(texts, own[text_at].type)
            yield pa.RecordBatch.from_arrays(out, columns)

    found = rows.join(parts, "__row").select("__whole", "size", "parts").mapInArrow(write, docs.schema)
    if "n_chars" not in columns:
        return found
    return found.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])
