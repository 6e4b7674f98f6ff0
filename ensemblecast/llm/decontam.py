"""Benchmark decontamination by greedy string tiling.

Tokens are folded runs of letters and digits. Hashes of ``tile`` tokens that a document shares with a benchmark item
are seeds; the longest run of unmarked tokens that both have is sought with Karp-Rabin hashes, by bisection of its
length, and marked, again and again until none of ``tile`` tokens is left (ties: first in the document, then in the
item). The share of an item's tokens that are marked is its coverage, wherever its parts stand in the document, so
reordered passages count. A document is contaminated by the items whose coverage reaches ``threshold``. Seeds alone
bound coverage from above, so only documents that can reach the threshold are tiled, on the tokens that seeds cover.

A benchmark of ``broadcast_bytes`` or less, counted first, is broadcast, and one pass over the documents does it all.
A larger one is joined with the documents by shared seeds. Both give equal results.

Memory: seeds are never paired, so texts that repeat one token need no more than others; a text may have any length,
and one beyond a megabyte is worked on alone. Null texts have no tokens; items of fewer than ``tile`` tokens never
match; an empty benchmark or documents table contaminates nothing; equal rows get equal results; an item that stands
twice counts once by id; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensemblecast.llm import textkit as tk
from ensemblecast.session import cut, ship


_LAST = (1 << 63) - 1


class Items:
    """Token hashes of benchmark items and the postings of their grams."""

    #: Postings that are looked at together, but for those of one text.
    AT_ONCE = 1 << 21

    def __init__(self, rows: list[tuple], tile: int):
        self.ids = [r[0] for r in rows]
        column = pa.array([r[1] or "" for r in rows], pa.string())
        data, offs = tk.buffer(column)
        _, _, owner, hashes = tk.tokens(data, offs)
        self.first = np.searchsorted(owner, np.arange(len(rows) + 1))
        self.size = np.diff(self.first)
        at, grams = tk.grams(hashes, owner, tile)
        self.hashes = hashes
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.place = grams[order], owner[at][order], (at - self.first[owner[at]])[order]


def _whole(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of ``size`` free tokens."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[size:] == taken[: len(free) - size + 1]) if size <= len(free) else np.zeros(0, int)


class _Side:
    """Tokens of one text, those that may still be marked, and hashes of their runs."""

    def __init__(self, tokens: np.ndarray, free: np.ndarray):
        near = free.copy()
        near[1:] |= free[:-1]  # a token that can't be marked stays between runs
        self.at = np.flatnonzero(near)
        self.tokens = tokens[self.at]
        self.free, self.sums = free[self.at], tk.prefix(self.tokens)

    def grams(self, tile: int) -> np.ndarray:
        """The different grams of tokens that may be marked."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], self.free.astype(np.int8), [0]])))
        stretch = np.repeat(np.arange(len(edge) // 2), edge[1::2] - edge[::2])
        return np.unique(tk.grams(self.tokens[self.free], stretch, tile)[1])

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        starts = _whole(self.free, size)
        return starts, tk.range_hash(self.sums, starts, starts + size)


def _shared(tokens: np.ndarray, grams: np.ndarray, tile: int) -> np.ndarray:
    """Which tokens lie in a gram that is among ``grams`` (in ascending order)."""
    free = np.zeros(len(tokens), bool)
    if len(grams):
        for a, own in tk.gram_sections(tokens, tile):
            at = np.flatnonzero(grams[np.minimum(np.searchsorted(grams, own), len(grams) - 1)] == own) + a
            for k in range(tile):
                free[at + k] = True
    return free


def tiles(doc: np.ndarray, item: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """(document position, item position, tokens) of the tiles of two arrays of token hashes."""
    of_item = [g for _, g in tk.gram_sections(item, tile)]
    left = _Side(doc, _shared(doc, np.unique(np.concatenate(of_item)) if of_item else item[:0], tile))
    sides = [left, _Side(item, _shared(item, left.grams(tile), tile))]

    def longest_first(size: int) -> tuple[int, int] | None:
        (at_d, of_d), (at_i, of_i) = sides[0].runs(size), sides[1].runs(size)
        both = np.flatnonzero(np.isin(of_d, of_i))
        return (at_d[both[0]], at_i[np.flatnonzero(of_i == of_d[both[0]])[0]]) if len(both) else None

    out: list[tuple[int, int, int]] = []
    most = min(len(sides[0].free), len(sides[1].free))
    while found := longest_first(tile):
        size, low, high = tile, tile + 1, most  # free runs in common have shorter ones in common
        while low <= high:
            middle = (low + high) // 2
            if match := longest_first(middle):
                found, size, low = match, middle, middle + 1
            else:
                high = middle - 1
        while found:  # all of this length
            d, i = found
            out.append((int(sides[0].at[d]), int(sides[1].at[i]), size))
            sides[0].free[d : d + size] = sides[1].free[i : i + size] = False
            found = longest_first(size)
        most = size - 1
    return out


def _candidates(row: np.ndarray, grams: np.ndarray, items: Items, tile: int, threshold: float) -> Iterator[tuple[int, int]]:
    """(row, item) whose seeds cover enough of the item; a row's equal grams are looked up once."""
    lo = np.searchsorted(items.grams, grams)
    hit = np.flatnonzero((lo < len(items.grams)) & (items.grams[np.minimum(lo, len(items.grams) - 1)] == grams))
    if not len(hit):
        return
    kind = np.unique(row[hit] * len(items.grams) + lo[hit])
    row, lo = np.divmod(kind, len(items.grams))
    times = np.searchsorted(items.grams, items.grams[lo], side="right") - lo
    edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    weight = np.cumsum(np.add.reduceat(times, edge))
    edge = np.append(edge, len(row))
    a = 0
    while a < len(weight):
        z = max(a + 1, int(np.searchsorted(weight, (weight[a - 1] if a else 0) + items.AT_ONCE, side="right")))
        own = slice(edge[a], edge[z])
        n = times[own]
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[own], n)
        pair = np.repeat(row[own], n) * len(items.ids) + items.item[post]
        place = items.place[post]
        order = np.lexsort((place, pair))
        place, pair = place[order], pair[order]
        bounds = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        step = np.append(tile, np.minimum(tile, np.diff(place)))
        step[bounds] = tile
        r, i = np.divmod(pair[bounds], len(items.ids))
        enough = np.add.reduceat(step, bounds) >= threshold * items.size[i]
        yield from zip(r[enough].tolist(), i[enough].tolist())
        a = z


def coverage(doc: np.ndarray, item: np.ndarray, tile: int) -> float:
    return sum(t[2] for t in tiles(doc, item, tile)) / len(item)


def leaks(data: np.ndarray, offs: np.ndarray, items: Items, tile: int, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(row, item index, coverage) of the items that reach the threshold."""
    if not len(items.grams):
        return
    if tk.is_long(data, offs):
        hashes = tk.long_hashes(data, folded=True)
        known = [own[items.grams[np.minimum(np.searchsorted(items.grams, own), len(items.grams) - 1)] == own] for _, own in tk.gram_sections(hashes, tile)]
        grams = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        row, first = np.zeros(len(grams), int), np.array([0, len(hashes)])
    else:
        _, _, owner, hashes = tk.tokens(data, offs)
        at, grams = tk.grams(hashes, owner, tile)
        row, first = owner[at], np.searchsorted(owner, np.arange(len(offs)))
    for r, i in _candidates(row, grams, items, tile, threshold):
        found = coverage(hashes[first[r] : first[r + 1]], items.hashes[items.first[i] : items.first[i + 1]], tile)
        if found >= threshold:
            yield r, i, float(found)


def _broadcast(rows: DataFrame, items: DataFrame, tile: int, threshold: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in items.orderBy("item_id").collect()], tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(batch.column(2)):
                best, ids = np.zeros(hi - lo), [[] for _ in range(hi - lo)]
                for r, i, found in leaks(data, offs, shared.value, tile, threshold):
                    best[r] = max(best[r], found)
                    ids[r].append(shared.value.ids[i])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(best), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "rid", "coverage", "items"])

    return rows.select("doc_id", "rid", "text").mapInArrow(run, "doc_id long, rid long, coverage double, items array<long>")


def _seeds(tile: int, once: bool):
    """(key.., gram, place, size) of each gram of a text (its last column); with ``once`` of each different one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.num_columns - 1
            for lo, hi, data, offs in tk.chunks(batch.column(keys)):
                _, _, owner, hashes = tk.tokens(data, offs)
                first = np.searchsorted(owner, np.arange(hi - lo + 1))
                at, grams = tk.grams(hashes, owner, tile)
                row = owner[at]
                if once:
                    order = np.lexsort((grams, row))
                    order = order[np.append(True, (np.diff(row[order]) != 0) | (np.diff(grams[order]) != 0))] if len(order) else order
                    at, grams, row = at[order], grams[order], row[order]
                pick = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(pick) for k in range(keys)), pa.array(grams.view(np.int64)), pa.array(at - first[row]), pa.array(np.diff(first)[row])],
                    names=[*batch.schema.names[:keys], "gram", "place", "size"],
                )

    return run


def _joined(rows: DataFrame, items: DataFrame, tile: int, threshold: float) -> DataFrame:
    """The same for a benchmark of any size: shared seeds are a join, and pairs that they cover enough of are tiled."""
    items = cut(items.withColumn("item", F.xxhash64("item_id", "text")).dropDuplicates(["item"]))
    theirs = cut(items.select("item", "text").mapInArrow(_seeds(tile, False), "item long, gram long, place long, size long"))
    ours = rows.select("rid", "doc_id", "text").mapInArrow(_seeds(tile, True), "rid long, doc_id long, gram long, place long, size long").select("rid", "doc_id", "gram")
    shared = ours.join(theirs, "gram").groupBy("rid", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "item").agg(F.array_sort(F.collect_set("place")).alias("at"), F.max("size").alias("size"))
    step = F.aggregate(F.sequence(F.lit(1), F.size("at") - 1), F.lit(0).cast("long"), lambda s, k: s + F.least(F.lit(tile).cast("long"), F.col("at")[k] - F.col("at")[k - 1]))
    reach = F.lit(tile) + F.when(F.size("at") > 1, step).otherwise(F.lit(0).cast("long"))
    pairs = cut(shared.where(reach >= threshold * F.col("size")).select("rid", "doc", "item"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST)))
    texts = rows.select("rid", "doc", "text").dropDuplicates(["rid", "doc"]).join(pairs, ["rid", "doc"])
    both = texts.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").select("rid", "doc", "item_id", "text", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(batch.column(3)):
                sides = []
                for d, o in ((data, offs), tk.buffer(batch.column(4)[lo:hi])):
                    if tk.is_long(d, o):
                        hashes = tk.long_hashes(d, folded=True)
                        sides.append((hashes, np.array([0, len(hashes)])))
                        continue
                    _, _, owner, hashes = tk.tokens(d, o)
                    sides.append((hashes, np.searchsorted(owner, np.arange(hi - lo + 1))))
                (doc, a), (item, b) = sides
                found = [coverage(doc[a[k] : a[k + 1]], item[b[k] : b[k + 1]], tile) for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[lo:hi] for k in range(3)), pa.array(found, pa.float64())], names=["rid", "doc", "item_id", "coverage"])

    found = both.mapInArrow(run, "rid long, doc long, item_id long, coverage double").where(F.col("coverage") >= threshold)
    found = found.groupBy("rid", "doc").agg(F.max("coverage").alias("coverage"), F.collect_set("item_id").alias("items"))
    return rows.select("doc_id", "rid", "doc").join(found, ["rid", "doc"], "left").select(
        "doc_id", "rid", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("items", F.array().cast("array<long>")).alias("items")
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, tile: int = 5, threshold: float = 0.6, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, rid, contaminated, coverage (of the item covered most), items (sorted ids) for every row of ``docs``."""
    ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    out = (_broadcast if total <= broadcast_bytes else _joined)(rows, items, tile, threshold)
    return out.select("doc_id", "rid", (F.col("coverage") > 0).alias("contaminated"), "coverage", F.array_sort(F.array_distinct("items")).alias("items"))
