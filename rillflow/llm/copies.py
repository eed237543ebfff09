"""Near copies by SimHash: texts whose sets of word shingles have a Jaccard similarity of LEAST or more.

Op9's radius of 4 bits finds few of them: at a similarity of 0.8 two SimHash fingerprints of 64 bits differ in
about 10 bits, and no band of bits is surely shared. Here a fingerprint goes to the shards of what the sets
themselves are likely to share: BANDS shards, each named by PER_BAND minimum hashes of the set. In a shard the
fingerprints form a BK-tree that is searched within RADIUS bits, and what it finds counts if the exact
similarity of the two sets is LEAST or more. A shard's first fingerprint is searched for first, then those that
are not linked with the largest component so far. Two sets of similarity s meet in a shard with probability
1 - (1 - s^4)^25: all but 2 pairs in a million at 0.8, all but one in 10^9 at 0.85; of the pairs in
/root/testdata/check_s none was over 22 bits apart.

Shards of over TREE fingerprints (or TERMS shingles) are dealt out: each part is linked by itself and with the
shard's first and last set, and what the parts leave outside the largest component is then searched for in all parts.

Defined results: null and empty texts are copies of each other; texts shorter than a shingle are one shingle;
equal sets are copies; null doc_ids come last; an empty table gives an empty result; extra columns are kept.
Shingles are compared by 32-bit hashes, equal sets by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, sized_broadcast, stored, text_batches
from .simhash import SEED, Forest, fingerprint, joined_up, one_of_each, roots_of, shingle_hashes

#: Words in a shingle, and the least similarity as a fraction.
WORDS, LEAST = 5, (4, 5)
BANDS, PER_BAND, RADIUS = 25, 4, 26
#: Fingerprints and shingles in a part of a shard, and shingles that are compared at once.
TREE, TERMS, AT_ONCE = 2048, 1 << 21, 1 << 20
_draw = np.random.default_rng(SEED)
FACTORS, TERMS_ADDED = _draw.integers(0, 2**64, (2, BANDS * PER_BAND), np.uint64)
FACTORS |= np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS))


def shard_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of PER_BAND minimum hashes."""
    if not len(h):
        return np.empty(0, np.uint64)
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for i in range(0, len(h), 1024):
        np.minimum(least, (FACTORS[:, None] * h[i : i + 1024] + TERMS_ADDED[:, None]).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, PER_BAND))], np.uint64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, n, fp, keys: the sketch of each text; node is its set's hash, and keys are left empty where a task has given them before."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in cut(batches):
            found = [shingle_set(t) for t in b.column(2).to_pylist()]
            node = [xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found]
            first = [x not in seen and not seen.add(x) for x in node]
            keys = [shard_keys(h) if f else h[:0] for h, f in zip(found, first)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)))
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            columns = [b.column(0), b.column(1), long(node), pa.array([len(h) for h in found], pa.int32()), long([fingerprint(h) if f else 0 for h, f in zip(found, first)]), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "n", "fp", "keys"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, node long, n int, fp long, keys array<long>")


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, terms: the shingles of the nodes in ``wanted`` (node, text_hash), as sorted 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            found = [np.unique(shingle_set(t).astype(np.uint32)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() for h in found], pa.binary())], ["node", "terms"])

    name = free_name(docs, "hash")
    texts = docs.select(F.xxhash64("text").alias(name), "text")
    texts = texts.join(sized_broadcast(wanted.withColumnRenamed("text_hash", name)), name)
    return texts.select("node", "text").mapInArrow(run, "node long, terms binary").dropDuplicates(["node"])


class Shards:
    """Whole shards (or parts of them), one after another: ``unit`` is sorted, and a row's side is 1 if it is searched for only."""

    def __init__(self, unit: np.ndarray, side: np.ndarray, node: np.ndarray, fp: np.ndarray, terms: list[np.ndarray]) -> None:
        self.n, self.node, self.fp, self.side = len(unit), node, fp, side
        self.begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        self.unit = np.repeat(np.arange(len(self.begin)), np.diff(np.append(self.begin, self.n)))
        self.sizes = np.array([len(t) for t in terms], np.int64)
        owner = np.repeat(np.arange(self.n), self.sizes)
        both = self.unit[owner].astype(np.uint64) << np.uint64(32) | np.concatenate([np.empty(0, np.uint32), *terms]).astype(np.uint64)
        # who has each shingle of each shard, and which of these every row has
        order = np.argsort(both, kind="stable")
        fresh = np.concatenate([[True], both[order][1:] != both[order][:-1]])[: len(order)]
        self.holders, self.holders_at = owner[order], np.append(np.flatnonzero(fresh), len(order))
        self.term = np.empty(len(order), np.int64)
        self.term[order] = np.cumsum(fresh) - 1
        self.term_at = np.cumsum(self.sizes) - self.sizes
        self.tree = np.flatnonzero(side != 1)
        self.forest = Forest(self.unit[self.tree], fp[self.tree])
        self.root = np.arange(self.n)

    def similar(self, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of asks and rows of their shard that the trees give within RADIUS and whose sets are similar."""
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2]
        held = [np.arange(self.term_at[q], self.term_at[q] + self.sizes[q]) for q in asks]
        weight = [int((self.holders_at[self.term[t] + 1] - self.holders_at[self.term[t]]).sum()) for t in held]
        at = 0
        while at < len(asks):
            end, total = at + 1, weight[at]
            while end < len(asks) and (end - at + 1) * self.n <= AT_ONCE and total + weight[end] <= AT_ONCE:
                total, end = total + weight[end], end + 1
            some, width = asks[at:end], end - at
            found = np.zeros((width, self.n), bool)
            for q, t in self.forest.search(self.unit[some], self.fp[some], RADIUS):
                found[q, self.tree[t]] = True
            common = np.zeros((width, self.n), np.int64)
            for i, t in enumerate(held[at:end]):
                begin, n = self.holders_at[self.term[t]], self.holders_at[self.term[t] + 1] - self.holders_at[self.term[t]]
                rows = self.holders[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
                common[i] = np.bincount(rows, minlength=self.n)
            # i / (s - i) >= a / b for i of s shingles in common
            a, b = LEAST
            q, x = np.nonzero(found & ((a + b) * common >= a * (self.sizes[some][:, None] + self.sizes)))
            out.append((some[q], x))
            at = end
        return tuple(np.concatenate(x) for x in zip(*out))

    def outside(self) -> np.ndarray:
        """Whether a row is not in the largest component of its shard."""
        size = np.bincount(self.root, minlength=self.n)
        largest = np.zeros(len(self.begin), np.int64)
        order = np.argsort(size[self.root], kind="stable")
        largest[self.unit[order]] = self.root[order]
        return self.root != largest[self.unit]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A star for each component of each shard. Of two rows that are not searched for, both are in the largest component (or in the tree only)."""
        asked = self.side == 0
        asks = self.begin[self.side[self.begin] == 2]
        while True:
            if len(asks):
                a, b = self.similar(asks)
                asked[asks] = True
                self.root = roots_of(self.root[a], self.root[b], self.n)[self.root]
            left = np.flatnonzero(~asked & ((self.side == 1) | self.outside()))
            if not len(left):
                break
            # a few of each shard at once: what they link needs no search of its own
            turn = np.arange(len(left)) - np.searchsorted(self.unit[left], self.unit[left])
            asks = left[turn < 32]
        other = self.root != np.arange(self.n)
        a, b = self.node[other], self.node[self.root[other]]
        return a[a != b], b[a != b]


def _linked(units: DataFrame, given: DataFrame) -> DataFrame:
    """a, b: links between the nodes of each unit (unit, side, node, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        weight = 0

        def out(n: int) -> pa.RecordBatch:
            nonlocal held, weight
            long = lambda x, kind=np.int64: np.array(x[:n], np.int64).view(kind)
            s = Shards(long(held[0]), long(held[1]), long(held[2]), long(held[3], np.uint64), held[4][:n])
            held = [x[n:] for x in held]
            weight = sum(map(len, held[4]))
            a, b = s.links()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            for unit, side, node, fp, terms in zip(*[c.to_pylist() for c in b.columns]):
                if held[0] and unit != held[0][-1] and (weight > AT_ONCE // 2 or len(held[0]) > TREE):
                    yield out(len(held[0]))
                for h, x in zip(held, (unit, side, node, fp, np.frombuffer(terms, np.uint32))):
                    h.append(x)
                weight += len(held[4][-1])
        if held[0]:
            yield out(len(held[0]))

    rows = units.join(given, "node").select("unit", "side", "node", "fp", "terms")
    return rows.repartition("unit").sortWithinPartitions("unit", "side", "node").mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """a, b: links between nodes that give the components of all similar sets that meet."""
    nodes = found.filter("size(keys) > 0").groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("text_hash").alias("text_hash"))
    nodes = stored(nodes, "copies-nodes")
    keyed = nodes.select("node", "fp", "n", F.explode("keys").alias("key"))
    shards = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n").cast("long")).alias("w"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.min("node").alias("low"), F.max("node").alias("high")).filter("m > 1")
    # shards of the same nodes are one
    shards = shards.groupBy("m", "w", "who", "low", "high").agg(F.min("key").alias("key"))
    parts = F.greatest(F.ceil(F.col("m") / TREE), F.ceil(F.col("w") / TERMS)).cast("int")
    shards = stored(shards.select("key", "low", "high", parts.alias("parts")), "copies-shards")
    rows = stored(keyed.join(shards, "key").select("key", "node", "fp", "low", "high", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")), "copies-rows")
    given = stored(sets(docs, stored(rows.select("node").distinct().join(nodes.select("node", "text_hash"), "node"), "copies-wanted")), "copies-sets")
    # the ends of a shard stand in all of its parts
    of = F.when(F.col("node").isin(F.col("low"), F.col("high")), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    first = rows.select("key", "node", "fp", F.explode(of).alias("part")).select(F.xxhash64("key", "part").alias("unit"), F.lit(2).alias("side"), "node", "fp")
    near = stored(_linked(first, given), "copies-links")
    large = rows.filter("parts > 1")
    if large.first() is None:
        return near
    roots = joined_up(near).withColumnRenamed("fp", "node")
    placed = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    placed = stored(placed.join(main, "key").select("key", "node", "fp", "parts", "part", (F.col("root") != F.col("main")).alias("asks")), "copies-placed")
    n_asks = placed.filter("asks").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TREE).cast("int").alias("groups"))
    placed = placed.join(n_asks, "key").withColumn("group", F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int"))
    unit = lambda part, group: F.xxhash64("key", part, group, F.lit(2)).alias("unit")
    inside = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g")).select(unit("part", "g"), F.lit(0).alias("side"), "node", "fp")
    asking = placed.filter("asks").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")).select(unit("p", "group"), F.lit(1).alias("side"), "node", "fp")
    return near.unionAll(_linked(inside.unionAll(asking), given))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, root: the component of each text."""
    found = stored(sketches(docs), "copies-found")
    roots = joined_up(links(docs, found)).withColumnRenamed("fp", "node")
    return found.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies: the smallest doc_id (null last), of equal ones the smallest text hash."""
    return one_of_each(docs, components(docs))
