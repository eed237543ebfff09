"""Resharding by minimum-cost flow: shards of near-equal bytes that move the fewest bytes.

The flow network holds the old shards with their sizes, the new ones with their capacities, an arc
without cost from each old shard to the new one of the same number, and arcs of cost 1 a byte through
a hub to all others, so it grows with the number of shards, not its square. A shard's rows are laid
along a line, large ones first, and cut at the amounts of its transfers; what stays comes first, so
cuts fall among smaller rows. Shards that gain or lose rows are rewritten.

Defined results: a null text has no bytes and checksum 0; every row counts ROW bytes besides its text;
repeated rows are placed each by itself; null doc_ids are placed like others; an empty table gives an
empty result (and no file); extra columns, whatever their names, are ignored by placed() and kept by rewritten().
Only shard sizes and transfers reach the driver.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, free_name, running_sum, stored, whole_row

LAW, ROW = "bytes", 16
OLD_SHARDS, SHARDS = 32, 40
#: Rows in a bucket of the running sums; size classes in a doubling.
BUCKET, CLASSES = 4096, 4


class Flow:
    """Minimum-cost flow by successive shortest paths."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.arcs: list[list[int]] = []  # to, room, cost; arc i ^ 1 goes back

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.arcs))
            self.arcs.append([y, r, c])
        return len(self.arcs) - 2

    def push(self, source: int, sink: int) -> int:
        """Send all it can at least cost; the cost."""
        total = 0
        while True:
            far, by, queue, queued = {source: 0}, {}, deque([source]), {source}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for i in self.out[a]:
                    b, room, cost = self.arcs[i]
                    if room and far[a] + cost < far.get(b, float("inf")):
                        far[b], by[b] = far[a] + cost, i
                        if b not in queued:
                            queued.add(b)
                            queue.append(b)
            if sink not in far:
                return total
            path, at = [], sink
            while at != source:
                path.append(by[at])
                at = self.arcs[by[at] ^ 1][0]
            n = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= n
                self.arcs[i ^ 1][1] += n
            total += n * far[sink]


def transfers(old: list[int], new: list[int]) -> dict[int, list[tuple[int, int]]]:
    """For each old shard, (new shard, bytes) with what stays first; as few bytes as possible move."""
    n, m = len(old), len(new)
    f, source, hub, sink = Flow(n + m + 3), n + m, n + m + 1, n + m + 2
    for i, size in enumerate(old):
        f.arc(source, i, size, 0)
    stay = {i: f.arc(i, n + i, old[i], 0) for i in range(min(n, m))}
    leave = [f.arc(i, hub, old[i], 1) for i in range(n)]
    enter = [f.arc(hub, n + j, new[j], 0) for j in range(m)]
    for j, room in enumerate(new):
        f.arc(n + j, sink, room, 0)
    f.push(source, sink)
    sent = lambda arc: f.arcs[arc ^ 1][1]
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, arc in stay.items():
        out[i] += [(i, sent(arc))] * (sent(arc) > 0)
    room = deque([j, sent(enter[j])] for j in range(m) if sent(enter[j]))
    for i in range(n):
        left = sent(leave[i])
        while left:
            n_bytes = min(left, room[0][1])
            out[i].append((room[0][0], n_bytes))
            left -= n_bytes
            room[0][1] -= n_bytes
            if not room[0][1]:
                room.popleft()
    return dict(out)


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _target(moves: dict[int, list[tuple[int, int]]]) -> Column:
    """The new shard of the row whose middle is at ``mid`` of its old shard."""
    cuts = {}
    for i, parts in moves.items():
        at, ends = 0, []
        for j, n in parts:
            at += n
            ends.append((at, j))
        cuts[i] = ends
    most = max(map(len, cuts.values()), default=1)
    ends = F.array(*[F.array(*[F.lit(e) for e, _ in cuts.get(i, [])[:-1]]).cast("array<long>") for i in range(max(cuts, default=0) + 1)])
    goal = F.array(*[F.array(*[F.lit(j) for _, j in cuts.get(i, [(0, 0)])]).cast("array<int>") for i in range(max(cuts, default=0) + 1)])
    mine, to = F.element_at(ends, F.col("old_shard") + 1), F.element_at(goal, F.col("old_shard") + 1)
    return F.element_at(to, F.size(F.filter(mine, lambda e: e <= F.col("mid"))) + 1) if most > 1 else F.element_at(to, F.lit(1))


def sized(docs: DataFrame, old_shard: Column, *keep: str | Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("__row"),
            F.xxhash64("doc_id", "text").alias("__order"),
            (F.octet_length(text) + ROW).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            old_shard.cast("int").alias("old_shard"),
            *keep,
        ),
        "shard-rows",
    )


def _moved(rows: DataFrame, shards: int) -> tuple[DataFrame, dict[int, list[tuple[int, int]]]]:
    """rows with ``shard`` after the flow from ``old_shard``, and the flow."""
    sizes = {r["old_shard"]: (r["n"], r["rows"]) for r in rows.groupBy("old_shard").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}  # a row per shard
    old = [sizes.get(i, (0, 0))[0] for i in range(max(sizes, default=0) + 1)]
    moves = transfers(old, capacities(sum(old), shards))
    lined, levels = bucketed(rows.withColumn("__class", (-F.floor(F.log2("size") * CLASSES)).cast("int")), len(old), sum(r for _, r in sizes.values()), BUCKET)
    lined = running_sum(lined, ["old_shard"], [["__class"], *levels], ["__order", "__row"], "size", "__at")
    out = lined.withColumn("mid", F.col("__at") + F.expr("size div 2")).withColumn("shard", _target(moves).cast("int"))
    return stored(out.select(*rows.columns, "shard"), "shard-placed"), moves


def placed(docs: DataFrame, old_shard: Column | None = None, shards: int = SHARDS, *keep: str | Column) -> tuple[DataFrame, dict[int, list[tuple[int, int]]]]:
    """doc_id, size, text_crc32, old_shard, ``keep`` and ``shard``, and the transfers. old_shard: where each row is now, from 0; by default a hash of doc_id.

    Cuts fall between rows, so a second flow, from what the first one gives, evens out the rest with the smallest rows."""
    now = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(OLD_SHARDS)) if old_shard is None else old_shard
    first, moves = _moved(sized(docs, now, "doc_id", *keep), shards)
    second, _ = _moved(first.withColumnsRenamed({"old_shard": "__first", "shard": "old_shard"}), shards)
    return second.drop("old_shard").withColumnRenamed("__first", "old_shard"), moves


def slotted(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows with ``slot``: 0, 1, 2 ... within each shard."""
    counted, levels = bucketed(rows.withColumn("__one", F.lit(1).cast("long")), shards, rows.count(), BUCKET)
    return running_sum(counted, ["shard"], levels, ["__order", "__row"], "__one", "slot").select(*rows.columns, "slot")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows, _ = placed(docs)
    return slotted(rows).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def rewritten(docs: DataFrame, path: str, old_shard: Column | None = None, shards: int = SHARDS, file_rows: int = 1 << 20) -> list[int]:
    """Write the shards that gain or lose rows under path/shard=N, in files of about file_rows, with a column slot; their numbers.

    Where docs has a column of that name, the partition or the slot gets underscores behind it."""
    rows, _ = placed(docs, old_shard, shards, whole_row(docs, "__whole"))
    went = rows.filter("shard != old_shard").select("shard", "old_shard").distinct().collect()  # pairs of shards
    changed = sorted({r["shard"] for r in went} | {r["old_shard"] for r in went if r["old_shard"] < shards})
    out = slotted(rows, shards).filter(F.col("shard").isin(changed)).repartition("shard", F.expr(f"slot div {file_rows}"))
    by, slot = free_name(docs, "shard"), free_name(docs, "slot")
    out.select("__whole.*", F.col("shard").alias(by), F.col("slot").alias(slot)).write.partitionBy(by).parquet(path)
    return changed
