"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities, then files are rewritten.

Old shards are the files that rows lie in, or what a column says. The ``shards`` with the most bytes keep their place
as new shards, in order of name; all rows of the others must move. An old shard that stays is cut into ``bands`` by
size, of which no row is larger than any of the next one (sizes that are very common are spread over several). Row and
byte counts by band, ``(shards + 1) * bands`` at most, go to the driver, which solves a flow network ``source -> old
shard -> {its own new shard at no cost | band at its bytes a row -> other new shards} -> sink``. The flow cuts bands
into pieces, the smallest rows of a band move first, and a row finds its piece by its rank in the band; so what moves
is the least possible in bytes, to the row.

The law held is ``rows``: new shards differ by one row at most. Null texts count no bytes; repeated rows are rows of
their own; rows with equal id, length and checksum are interchangeable, so ties need no order; a text may have any
length; an empty table gives an empty result; extra input columns are ignored, whatever their names, unless carried.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_OVERHEAD = 16
#: Rows that a block is meant to have, bytes of a task that assigns rows, and blocks of what moves anyway.
BLOCK_ROWS, TASK_BYTES, LEAST_RETIRED, MOST_RETIRED = 1 << 20, 8 << 20, 256, 1 << 16


class FlowNetwork:
    """Successive shortest paths with bulk augmentation, for small graphs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, room: int, cost: float = 0.0) -> int:
        for frm, to, cap, price in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[frm].append(len(self.head))
            self.head.append(to)
            self.room.append(cap)
            self.cost.append(price)
        return len(self.head) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def solve(self, source: int, sink: int) -> tuple[int, float]:
        total, price = 0, 0.0
        while True:
            dist, via = [float("inf")] * len(self.out), [-1] * len(self.out)
            dist[source], queue, queued = 0.0, deque([source]), [False] * len(self.out)
            while queue:
                u = queue.popleft()
                queued[u] = False
                for e in self.out[u]:
                    v = self.head[e]
                    if self.room[e] > 0 and dist[u] + self.cost[e] < dist[v] - 1e-9:
                        dist[v], via[v] = dist[u] + self.cost[e], e
                        if not queued[v]:
                            queued[v] = True
                            queue.append(v)
            if via[sink] < 0:
                return total, price
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.head[via[v] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            total += push
            price += push * dist[sink]


@dataclass(frozen=True)
class Piece:
    """Rows ``first..last`` (ranks from 0) of a block and where they go; ``slot`` is that of the first."""

    old: int
    block: int
    first: int
    last: int
    shard: int
    slot: int


def plan_transfers(stats: list[tuple[int, int, int, int]], capacities: list[int]) -> list[Piece]:
    """Pieces that fill ``capacities`` (rows) from blocks ``(old, block, rows, bytes)``, moving the fewest bytes.

    Blocks of an old shard come in order of the sizes of their rows; an old shard without a new one of its number gives
    all it has.
    """
    new = len(capacities)
    blocks: dict[int, list[tuple[int, int, int]]] = {}
    for old, block, rows, size in sorted(stats):
        blocks.setdefault(old, []).append((block, rows, size))
    source, sink = 0, 1
    held = {o: 2 + k for k, o in enumerate(blocks)}
    moved = {o: 2 + len(held) + k for k, o in enumerate(blocks)}
    shard = [2 + 2 * len(held) + j for j in range(new)]
    net = FlowNetwork(2 + 2 * len(held) + new)
    for j, room in enumerate(capacities):
        net.arc(shard[j], sink, room)
    tiers, dealt = {}, {}
    for o, own in blocks.items():
        rows = sum(n for _, n, _ in own)
        net.arc(source, held[o], rows)
        if o < new:
            net.arc(held[o], shard[o], rows)
            for block, n, size in own:
                tiers[o, block] = net.arc(held[o], moved[o], n, size / n)
        else:  # nothing to choose
            net.arc(held[o], moved[o], rows, sum(size for _, _, size in own) / rows)
        for j in range(new):
            if j != o:
                dealt[o, j] = net.arc(moved[o], shard[j], rows)
    placed, _ = net.solve(source, sink)
    if placed != sum(n for own in blocks.values() for _, n, _ in own):
        raise ValueError("the new capacities don't hold all rows")
    slots, pieces = [0] * new, []

    def put(old: int, block: int, first: int, n: int, j: int) -> None:
        pieces.append(Piece(old, block, first, first + n - 1, j, slots[j]))
        slots[j] += n

    for o, own in blocks.items():
        wants = deque([j, net.flow(e)] for (p, j), e in dealt.items() if p == o and net.flow(e))
        for block, n, _ in own:
            out = net.flow(tiers[o, block]) if o < new else n
            if n > out:
                put(o, block, out, n - out, o)
            at = 0
            while at < out:
                j, want = wants[0]
                take = min(out - at, want)
                put(o, block, at, take, j)
                at, wants[0][1] = at + take, want - take
                if not wants[0][1]:
                    wants.popleft()
    return pieces


@dataclass(frozen=True)
class Plan:
    """Where rows lie and go: how a row finds its old shard and block, and the pieces."""

    shards: int
    homes: tuple  # names of the old shards that keep their place
    old: Column
    edges: tuple[int, ...]  # the greatest sizes of the bands but the last, as often as they are
    retired: int  # blocks of the old shards that go
    lanes: int  # tasks of an old shard that stays
    pieces: list[Piece] = field(repr=False)

    @property
    def touched(self) -> list[int]:
        """The new shards that lose or gain a row."""
        return sorted({j for p in self.pieces if p.old != p.shard for j in (p.old, p.shard) if j < self.shards})

    def blocks(self, docs: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
        """doc_id, size, text_crc32, old_shard, block and the carried columns."""
        body = F.coalesce(F.col("text"), F.lit(""))
        rows = docs.select(
            "doc_id", (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
            _number(self.old, self.homes).alias("old_shard"), *(F.col(f"`{c}`").alias(f"carried_{c}") for c in carry),
        )
        spread = F.xxhash64("text_crc32", "size", "doc_id")
        band = F.when(F.col("old_shard") < self.shards, _band(F.col("size"), spread, self.edges)).otherwise(F.pmod(spread, F.lit(self.retired)).cast("int"))
        return rows.withColumn("block", band)


def _number(old: Column, homes: tuple) -> Column:
    """The place of an old shard among those that stay, or how many stay."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, homes)), old), F.lit(0)).cast("int") - 1 if homes else F.lit(-1)


def _band(size: Column, spread: Column, edges: tuple[int, ...]) -> Column:
    """The band of a size: a binary search of the edges; a size that is several edges is dealt to all of their bands."""
    values = sorted(set(edges))
    below = [sum(e < v for e in edges) for v in values]

    def between(lo: int, hi: int) -> Column:  # values[lo - 1] < size <= values[hi], if there are such
        if lo == hi:
            if lo == len(values):
                return F.lit(len(edges))
            times = edges.count(values[lo])
            return F.lit(below[lo]) + (F.when(size == values[lo], F.pmod(spread, F.lit(times)).cast("int")).otherwise(0) if times > 1 else F.lit(0))
        mid = (lo + hi) // 2
        return F.when(size <= values[mid], between(lo, mid)).otherwise(between(mid + 1, hi))

    return between(0, len(values)).cast("int")


def plan(docs: DataFrame, shards: int = 40, old: Column | None = None, bands: int = 64) -> Plan:
    """The transfers that move the fewest bytes; ``old`` names a row's old shard, by default its file."""
    old = F.coalesce((F.input_file_name() if old is None else old).cast("string"), F.lit(""))
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + ROW_OVERHEAD
    rows = docs.select(old.alias("old"), size.cast("long").alias("size"))
    # as many rows as there are new shards at most
    kept = rows.groupBy("old").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy(F.desc("bytes"), "old").limit(shards).collect()
    homes = tuple(sorted(r["old"] for r in kept))
    held = max((r["n"] for r in kept), default=0)
    volume = sum(r["bytes"] for r in kept)
    bands = max(bands, min(1024, max(-(-held // BLOCK_ROWS), -(-volume // (max(1, len(kept)) * TASK_BYTES)))))
    total, cuts = rows.agg(F.count("*"), F.percentile_approx("size", [k / bands for k in range(1, bands)], 10_000)).first()
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    lanes = min(bands, max(-(-volume // (max(1, len(homes)) * TASK_BYTES)), -(-4 * parallel // max(1, len(homes)))))
    retired = min(MOST_RETIRED, max(LEAST_RETIRED, -(-(total - sum(r["n"] for r in kept)) // BLOCK_ROWS)))
    draft = Plan(shards, homes, old, tuple(cuts or ()), retired, lanes, [])
    # the old shards that go are one, with the number ``shards``
    counted = draft.blocks(docs).groupBy("old_shard", "block").agg(F.count("*"), F.sum("size"))
    stats = [(shards if r[0] < 0 else r[0], *r[1:]) for r in counted.collect()]
    capacities = [total // shards + (j < total % shards) for j in range(shards)]
    return Plan(shards, homes, old, draft.edges, retired, lanes, plan_transfers(stats, capacities))


def assign(docs: DataFrame, made: Plan, carry: Iterable[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, old_shard, shard, slot, grown_shard, moved for every row, and ``carried_*`` columns."""
    carry = list(carry)
    rows = made.blocks(docs, carry).withColumn("old_shard", F.when(F.col("old_shard") < 0, made.shards).otherwise(F.col("old_shard")))
    # a task has neighbouring bands of one old shard, which go to a few new ones
    lane = F.when(F.col("old_shard") < made.shards, F.floor(F.col("block") * made.lanes / F.lit(len(made.edges) + 1))).otherwise(F.col("block")).cast("int")
    rows = rows.withColumn("lane", lane).repartition("old_shard", "lane")
    rank = F.row_number().over(Window.partitionBy("old_shard", "lane", "block").orderBy("size", "doc_id", "text_crc32")) - 1
    pieces = [(p.old, p.block, p.first, p.last, p.shard, p.slot) for p in made.pieces]
    # at most a piece a block and two a shard and old shard, whatever the input
    where = F.broadcast(docs.sparkSession.createDataFrame(pieces, "old_shard int, block int, first long, last long, shard int, slot0 long"))
    return (
        rows.withColumn("rank", rank.cast("long"))
        .join(where, ["old_shard", "block"])
        .where("rank between first and last")
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "old_shard", "shard",
            (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), (F.col("shard") != F.col("old_shard")).alias("moved"), *(f"carried_{c}" for c in carry),
        )
    )


def reshard(docs: DataFrame, shards: int = 40, old: Column | None = None, bands: int = 64) -> DataFrame:
    """The assignment of every row, without writing anything."""
    return assign(docs, plan(docs, shards, old, bands))


def rewrite(docs: DataFrame, made: Plan, path: str, carry: Iterable[str] = ("text",)) -> list[int]:
    """Write the shards that lose or gain a row under ``path/shard=N``; the numbers of those written.

    A file holds neighbouring slots of a piece, in order, with doc_id, slot, old_shard and the carried columns. Shards that stay as they are aren't
    written.
    """
    carry = list(carry)
    out = assign(docs, made, carry).where(F.col("shard").isin(made.touched)) if len(made.touched) < made.shards else assign(docs, made, carry)
    out.select("doc_id", "slot", "old_shard", *(F.col(f"carried_{c}").alias(c) for c in carry), "shard").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return made.touched


def reshard_files(docs: DataFrame, path: str, shards: int = 40, old: Column | None = None) -> DataFrame:
    """Solve, rewrite under ``path``, and tell of every row what its shard's file now holds."""
    made = plan(docs, shards, old)
    touched = rewrite(docs, made, path)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    back = docs.sparkSession.read.schema(f"doc_id {fields['doc_id']}, slot long, old_shard int, text string, shard int").parquet(path)
    body = F.coalesce(F.col("text"), F.lit(""))
    told = back.select(
        "doc_id", (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"), "old_shard",
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), (F.col("shard") != F.col("old_shard")).alias("moved"),
    )
    if len(touched) == shards:
        return told
    return told.unionByName(assign(docs, made).where(~F.col("shard").isin(touched)))
