"""SimHash near-duplicates: BK-trees over fingerprints, in shards that share some bits.

Every document gets a 64-bit fingerprint of its word shingles. Two fingerprints that differ in at
most RADIUS bits agree on one of RADIUS + 1 bands of bits, so each distinct fingerprint goes to a
shard per band; shards of over REFINE are cut again by bands of their other bits. A shard's fingerprints
form a BK-tree whose children are keyed by their distance to the parent; a search follows only the edges
within the radius. A shard of more than TREE fingerprints is split into trees of at most TREE, and each
pair of its trees is a unit of work of its own: one tree is sent to the unit and searched with the other's
fingerprints. A unit reports its links as a star for
each group it finds (never all pairs), and the stars are joined into components.

Defined results: null and empty texts have no words and fingerprint 0, linked like any other; texts
shorter than a shingle are one shingle; equal texts share a fingerprint and so a component; null
doc_ids form no smallest id unless all of a component are null; repeated rows repeat; an empty table
gives an empty result; extra columns are ignored by components() and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, free_name, sized_broadcast, stored, text_batches

WORDS, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Fingerprints in one tree, and in the trees that are searched at once.
TREE, AT_ONCE = 2048, 65536
#: Fingerprints in a shard that is cut again, and how often shards are cut.
REFINE, LEVELS = 8 * TREE, 3
#: A-Z become a-z and white space becomes a space.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)


def shingle_hashes(text: str | None, size: int = WORDS) -> np.ndarray:
    words = (text or "").encode().translate(FOLD).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends[:-size].tolist()]
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(line[a:b], SEED) for a, b in zip(begins, (ends[size - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        ones += part.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp: the fingerprint of every whole text, as a signed long."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            fp = np.array([fingerprint(shingle_hashes(t)) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


class Forest:
    """BK-trees in arrays, one for each value of ``tree``: built and searched level by level."""

    def __init__(self, tree: np.ndarray, fp: np.ndarray) -> None:
        self.fp, n = fp, len(fp)
        self.trees, place = np.unique(tree, return_inverse=True)
        roots = len(self.trees)
        # a child's key: its parent (or, for roots, its tree) and its distance to it
        key_of, at = np.zeros(n, np.int64), np.arange(n)
        key = place.astype(np.int64) * (BITS + 1)
        base = roots * (BITS + 1)
        while len(at):
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            node = at[first]
            key_of[node] = key[first]
            parent = node[group]
            rest = parent != at
            at, parent = at[rest], parent[rest]
            key = base + parent * (BITS + 1) + np.bitwise_count(fp[parent] ^ fp[at]).astype(np.int64)
        self.order = np.argsort(key_of, kind="stable")
        self.keys = key_of[self.order]
        self.base = base

    def search(self, tree: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs within the radius; equal fingerprints differ by 0 and count."""
        slot = np.searchsorted(self.trees, tree)
        known = (slot < len(self.trees)) & (self.trees[np.minimum(slot, len(self.trees) - 1)] == tree)
        key = slot[known] * (BITS + 1)
        q = np.flatnonzero(known)
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        while len(q):
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, node = np.repeat(q, n), self.order[at]
            d = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            own = self.base + node * (BITS + 1)
            low = np.searchsorted(self.keys, own + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, own + np.minimum(d + radius, BITS), side="right")
            some = high > low
            q, low, high = q[some], low[some], high[some]


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (up := root[root]) is not root and (up != root).any():
            root = up
        if (root[a] == root[b]).all():
            return root


def _unit_links(unit: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links in each unit: side 0 is the tree, side 1 what it is searched with, side 2 is both."""
    inside, asks = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(inside) or not len(asks):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    forest = Forest(unit[inside], fp[inside])
    root = np.arange(len(fp))
    for i in range(0, len(asks), 4096):
        ask = asks[i : i + 4096]
        found = [(ask[q], inside[n]) for q, n in forest.search(unit[ask], fp[ask], radius)]
        q, n = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))
        apart = root[q] != root[n]
        if apart.any():
            a, b = root[q[apart]], root[n[apart]]
            root = roots_of(a, b, len(fp))[root]
    other = root != np.arange(len(fp))
    a, b = fp[other], fp[root[other]]
    return a[a != b], b[a != b]


def _banded(rows: DataFrame, radius: int) -> DataFrame:
    """fp, shard, rest, width: a row for each of radius + 1 bands of the ``width`` remaining bits ``rest``, with the bits left beside it."""
    cut = rows.select("fp", "shard", "rest", "width", F.explode(F.array(*[F.lit(i) for i in range(radius + 1)])).alias("band"))
    cut = cut.selectExpr("*", f"width * band div {radius + 1} AS lo", f"width * (band + 1) div {radius + 1} AS hi")
    cut = cut.selectExpr("*", "CAST(hi - lo AS INT) AS w", "shiftrightunsigned(rest, CAST(lo AS INT)) AS up")  # lo is under 64
    return cut.selectExpr(
        "fp",
        "xxhash64(shard, band, up & (shiftleft(1L, w) - 1)) AS shard",
        "(rest & (shiftleft(1L, CAST(lo AS INT)) - 1)) | shiftleft(shiftrightunsigned(up, w), CAST(lo AS INT)) AS rest",
        "CAST(width - w AS INT) AS width",
    )


def _units(nodes: DataFrame, radius: int) -> DataFrame:
    """fp, unit, side: the units of work. side 0 is a tree, side 1 what it is searched with, side 2 is both.

    A shard of over REFINE fingerprints is cut again by the bands of its other bits (which differ in RADIUS
    bits at most as well), LEVELS times; what is still over TREE then goes to pairs of trees."""
    rows = nodes.select("fp", F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest"), F.lit(BITS).alias("width"))
    units = []
    for level in range(LEVELS):
        rows = _banded(rows, radius)
        sizes = stored(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-shards")
        more = level + 1 < LEVELS and sizes.filter(F.col("n") > REFINE).first() is not None
        # parts: how many trees a shard has; a tree's members are picked by a hash, so none is much over TREE
        here = rows.join(sizes.filter(F.col("n") <= REFINE) if more else sizes, "shard").select("fp", "shard", F.ceil(F.col("n") / TREE).cast("int").alias("parts"))
        units.append(here.withColumn("part", F.pmod(F.xxhash64("fp", "shard"), F.col("parts")).cast("int")))
        if not more:
            break
        rows = stored(rows.join(sizes.filter(F.col("n") > REFINE), "shard", "left_semi"), "simhash-large")
    placed = reduce(DataFrame.unionByName, units)
    me = F.col("part")
    # unit (i, j), i <= j: tree i searched with the fingerprints of j; a fingerprint of part p is in every pair with p
    pairs = placed.select("fp", "shard", me.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return pairs.select("fp", F.xxhash64("shard", F.least(me, "other"), F.greatest(me, "other")).alias("unit"), F.when(me == F.col("other"), 2).when(me < F.col("other"), 0).otherwise(1).cast("int").alias("side"))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links between the distinct fingerprints (column fp) that give the components within the radius."""
    units = _units(nodes, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, b = _unit_links(rows[0], rows[1], rows[2].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        n = 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)]))
            n += batch.num_rows
            if n >= AT_ONCE:  # whole units; the last may go on in the next batch
                rows = np.concatenate(held, axis=1)
                whole = np.searchsorted(rows[0], rows[0][-1])
                if whole:
                    yield out(rows[:, :whole])
                held = [rows[:, whole:]]
                n = held[0].shape[1]
        if n:
            yield out(np.concatenate(held, axis=1))

    spread = units.repartition("unit").sortWithinPartitions("unit").select("unit", "side", "fp")
    return spread.mapInArrow(run, "a long, b long").distinct()


def joined_up(edges: DataFrame) -> DataFrame:
    """fp, root: the smallest fingerprint of the component of every fingerprint that has a link.

    Rounds of large and small stars until nothing changes; each round is a stored table, so nothing is kept on the driver."""
    state = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    edges = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v != u").distinct(), "simhash-edges")
    before = state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v != u").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v")
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(small.select("v", F.col("m").alias("u")))
        after = stored(small.filter("v != u").distinct(), "simhash-edges")
        now = state(after)
        dropped(edges)
        if now == before:
            return after.select(F.col("v").alias("fp"), F.col("u").alias("root"))
        edges, before = after, now


def components(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root, component_id: the component's smallest fingerprint and smallest doc_id."""
    prints = stored(fingerprints(docs), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = joined_up(links(nodes.select("fp")))
    member = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(member.select("fp", "root").join(least, "root"), "fp")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the smallest doc_id (null last), of equal ones the smallest text hash."""
    return one_of_each(docs, components(docs))


def one_of_each(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """The first document of each root in parts (doc_id, text_hash, root); of rows equal in doc_id and text, one.

    Rows are told apart by doc_id and 64 bits of their text. What goes is joined, not what stays: a broadcast
    if it is small, so that texts don't cross the network."""
    parts = stored(parts, "copies-parts")
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    first = parts.groupBy("root").agg(F.min(key).alias("k")).select("root", "k")
    counted = parts.groupBy("doc_id", "text_hash", "root").agg(F.count(F.lit(1)).alias("n")).select(key.alias("own"), "root", "n")
    judged = counted.join(first, "root").select(F.xxhash64("own.doc_id", "own.text_hash").alias("key"), F.col("own.text_hash").alias("text_hash"), (F.col("own") == F.col("k")).alias("stays"), "n")
    goes = stored(judged.filter("NOT stays OR n > 1").select("key", "text_hash", "stays"), "copies-go")
    dropped(parts)
    names = {c: free_name(docs, c) for c in ("key", "text_hash", "stays")}
    keyed = docs.select("*", F.xxhash64("text").alias(names["text_hash"])).withColumn(names["key"], F.xxhash64("doc_id", names["text_hash"]))
    joined = keyed.join(sized_broadcast(goes.withColumnsRenamed(names)), [names["key"], names["text_hash"]], "left")
    out = joined.filter(F.col(names["stays"]).isNull()).select(docs.columns)
    if goes.filter("stays").first() is None:
        return out
    again = joined.filter(names["stays"]).dropDuplicates([names["key"], names["text_hash"]])
    return out.unionAll(again.select(docs.columns))
