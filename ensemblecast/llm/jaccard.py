"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Every text becomes its set of 5-word shingles (fewer words: one shingle of them all). Texts with equal sets (by 128
bits) are one *class of copies* from the start. A set's signature is one string of ``MAX_DEPTH`` MinHash values for
each of ``trees`` trees; sorted, a tree's strings are a prefix trie, whose nodes are the prefixes that sets share.
Matching begins at the longest prefixes. The sets below a node are compared exactly, by counting common shingles, and
the similarities found tell, together with the known chance that a pair of some similarity shares a prefix, how many
links are still missed, as though one more pair had the threshold's own similarity. Prefixes are then shortened to the
greatest depth that is expected to reach ``recall``, and the new nodes are compared, until the target is met. At
the depth of ``floor_depth`` every pair at the threshold is found with that probability, whatever the data.

A pair counts at the first node that both sets are below; nodes with equal members are one. Nodes of over ``BLOCK``
sets are cut into blocks and compared block by block, so no task holds more than two blocks and nothing is dropped. A
kernel returns each set's number of linked documents and its local root, never pairs. Connected components of the
local roots are the groups.

A text without a word is a group of its own, as is a null text; a null doc_id counts as the largest; equal rows
are copies, and a tie for a group's least doc_id makes no difference; a text may have any length (its shingles are held
at once, one text at a time beyond a megabyte); an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensemblecast.llm import textkit as tk
from ensemblecast.llm.components import components
from ensemblecast.session import cut, ship

MAX_DEPTH = 6
#: Bytes of a MinHash value in a signature.
VALUE = 2
#: Sets that one side of a comparison holds at most (about, as blocks are dealt by hash).
BLOCK = 256
#: Bins of the similarities of links.
BINS = 1000
_rng = np.random.default_rng(77)
_SCALE = (_rng.integers(1, 1 << 31, (64, MAX_DEPTH)) * 2 + 1).astype(np.uint32)
_SHIFT = _rng.integers(0, 1 << 32, (64, MAX_DEPTH)).astype(np.uint32)
_LAST = (1 << 63) - 1


def missed(similarity, trees: int, depth: int):
    """The probability that a pair shares no prefix of ``depth`` in any tree."""
    return (1 - np.asarray(similarity, float) ** depth) ** trees


def floor_depth(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with probability ``recall``."""
    return max(d for d in range(1, MAX_DEPTH + 1) if d == 1 or missed(threshold, trees, d) <= 1 - recall)


def next_depth(found: dict[int, int], threshold: float, trees: int, recall: float, depth: int) -> int:
    """The greatest depth up to ``depth`` that is expected to reach ``recall``, from counts of links found by similarity bin."""
    similarity = np.array([threshold, *((max(threshold, (b + 0.5) / BINS)) for b in found)]).clip(max=1)
    links = np.array([1.0, *found.values()]) / (1 - missed(similarity, trees, depth))
    for d in range(depth, 1, -1):
        if (links * missed(similarity, trees, d)).sum() <= (1 - recall) * links.sum():
            return d
    return 1


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the different shingles of each text, in order."""
    if tk.is_long(data, offs):
        h = tk.long_hashes(data)
        value = np.concatenate([g for _, g in tk.gram_sections(h, k)]) if len(h) >= k else tk.range_hash(tk.prefix(h, 1), np.zeros(min(1, len(h)), int), np.full(min(1, len(h)), len(h)), 1)
        del h
        value.sort()
        value = value[np.append(True, value[1:] != value[:-1])] if len(value) else value
        return np.zeros(len(value), np.int8), value
    starts, ends, rows = tk.words(data, offs)
    h = tk.word_hashes(data, starts, ends)
    at, grams = tk.grams(h, rows, k)
    sizes = np.bincount(rows, minlength=len(offs) - 1)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    whole = tk.range_hash(tk.prefix(h, 1), begin[short], begin[short + 1], 1)
    row, value = np.concatenate([rows[at], short]), np.concatenate([grams, whole])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])) if len(row) else np.zeros(0, bool)
    return row[fresh], value[fresh]


#: Shingles that are hashed at once; runs of several texts have fewer.
BLOCKED = 1 << 20


def _signatures(k: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(batch.column(2)):
                row, value = shingles(data, offs, k)
                if not len(row):
                    continue
                own, at, size = np.unique(row, return_index=True, return_counts=True)
                sums, check, least = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64), np.full((len(own), trees, MAX_DEPTH), 0xFFFFFFFF, np.uint32)
                for a in range(0, len(value), BLOCKED):  # more than one for a long text only
                    part = value[a : a + BLOCKED]
                    near = at if len(part) == len(value) else at[:1]
                    sums += np.add.reduceat(tk.mix(part), near)
                    check += np.add.reduceat(tk.mix(part * tk.BASES[1] + tk.BASES[0]), near)
                    low = (part >> np.uint64(32)).astype(np.uint32)
                    for t in range(trees):
                        for d in range(MAX_DEPTH):
                            x = low * _SCALE[t, d] + _SHIFT[t, d]
                            x ^= x >> np.uint32(15)
                            x *= np.uint32(0x2C1B3C6D)
                            np.minimum(least[:, t, d], np.minimum.reduceat(x, near), out=least[:, t, d])
                sid, check = tk.mix(sums + size.astype(np.uint64)).view(np.int64), check.view(np.int64)
                # the high bits of a least value are near zero; mixed, the low ones serve
                signature = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")
                width = trees * MAX_DEPTH * VALUE
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(own), [None, pa.py_buffer(signature.tobytes())]).cast(pa.binary())
                pick = pa.array(lo + own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(sid), pa.array(check), packed], names=["rid", "doc", "sid", "check", "signature"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(batch.column(0)):
                row, value = shingles(data, offs, k)
                cut_at = np.searchsorted(row, np.arange(hi - lo + 1))
                sets = [value[a:b].tobytes() for a, b in zip(cut_at, cut_at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(1)[lo:hi], pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share: rare values by enumeration, the others by matrix products."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    if not len(owner):
        return out
    _, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(back, kind="stable")
    owner, begin = owner[order], np.cumsum(times) - times
    for d in range(2, min(8, n) + 1):
        at = begin[times == d]
        for i in range(d):
            for j in range(i + 1, d):
                out += np.bincount(owner[at + i] * n + owner[at + j], minlength=n * n).reshape(n, n) if len(at) else 0
    heavy = np.flatnonzero(times > 8)
    out += out.T
    for part in np.array_split(heavy, max(1, -(-len(heavy) // 4096))):
        if len(part):
            grid = np.zeros((n, len(part)), np.float32)
            size = times[part]
            rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[part], size)
            grid[owner[rows], np.repeat(np.arange(len(part)), size)] = 1
            out += grid @ grid.T
    np.fill_diagonal(out, 0)
    return out


def similarities(sets: list[np.ndarray], threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Which sets have a Jaccard similarity of the threshold or more, and all similarities."""
    size = np.array([len(s) for s in sets], np.float64)
    shared = common(sets).astype(np.float64)
    union = np.maximum(1, size[:, None] + size[None, :] - shared)
    return (threshold.denominator * shared >= threshold.numerator * union) & (shared > 0), shared / union


def _compare(threshold: Fraction):
    """(node, root, links) of the sets of a block pair that have links; with a null node, (similarity bin, links)."""

    def settle(bucket: int, cross: bool, rows: list[tuple]) -> Iterator[tuple]:
        nodes = np.array([r[0] for r in rows])
        weight = np.array([r[1] for r in rows], np.float64)
        side = np.array([r[5] for r in rows])
        linked, similarity = similarities([np.frombuffer(r[4], np.uint64) for r in rows], threshold)
        if cross:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return
        linked &= common([np.array([*r[3], *(b for b in r[2] if b < bucket)], np.int64) for r in rows]) == 0
        root = nodes.copy()
        while True:
            near = np.where(linked, root[None, :], _LAST).min(axis=1)
            lower = np.minimum(root, near)
            if (lower == root).all():
                break
            root = lower
        for k in np.flatnonzero(linked.any(axis=1)):
            yield int(nodes[k]), int(root[k]), int(linked[k] @ weight)
        bins, times = np.unique((similarity[np.triu(linked)] * BINS).astype(int), return_counts=True)
        yield from ((None, int(b), int(n)) for b, n in zip(bins, times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(out):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], names=["node", "root", "links"])

        current, rows, seen, out = None, [], set(), []
        for batch in batches:
            for node, weight, buckets, earlier, packed, bucket, first, second, side in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, first, second) != current:
                    if len(rows) > 1:
                        out.extend(settle(current[0], current[1] != current[2], rows))
                    current, rows, seen = (bucket, first, second), [], set()
                if node not in seen:
                    seen.add(node)
                    rows.append((node, weight, buckets, earlier, packed, side))
            if len(out) > 10_000:
                yield flush(out)
                out = []
        if len(rows) > 1:
            out.extend(settle(current[0], current[1] != current[2], rows))
        yield flush(out)

    return run


def _below(sets: DataFrame, trees: int, depth: int) -> DataFrame:
    """(node, bucket) for the trie nodes of one depth."""
    prefixes = [F.xxhash64(F.lit(t), F.substring("signature", 1 + VALUE * MAX_DEPTH * t, VALUE * depth)) for t in range(trees)]
    return sets.select("node", F.explode(F.array(*prefixes)).alias("bucket"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, trees: int = 20, recall: float = 0.9999) -> DataFrame:
    """doc_id, rid, group_id (of the group; null without a word), class_id (its least doc_id) and n_links (other documents at the threshold)."""
    ship(docs.sparkSession)
    least = floor_depth(threshold, trees, recall)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("rid"), doc)
    signed = cut(rows.select("rid", "doc", "text").mapInArrow(_signatures(words, trees), "rid long, doc long, sid long, check long, signature binary"))
    sets = signed.groupBy("sid", "check").agg(F.count("*").alias("weight"), F.min(F.struct("doc", "rid")).alias("rep"), F.min("signature").alias("signature"))
    sets = cut(sets.withColumn("node", F.monotonically_increasing_id()))
    # what shares no prefix of the least depth is never compared
    under = _below(sets, trees, least)
    shared = cut(under.groupBy("bucket").count().where("count > 1").select("bucket"))
    members = under.join(shared, "bucket").select("node").distinct()
    forest = cut(sets.join(members, "node").select("node", "weight", "signature", "rep"))
    named = forest.select("rep.rid", "rep.doc", "node")
    shingled = cut(rows.select("rid", "doc", "text").join(named, ["rid", "doc"]).select("text", "node").mapInArrow(_sets(words), "node long, shingles binary"))

    exact = Fraction(threshold).limit_denominator(1000)
    found: dict[int, int] = {}
    placed: list[DataFrame] = []
    compared: list[DataFrame] = []
    depth = MAX_DEPTH
    while True:
        placed.append(_new_nodes(_below(forest, trees, depth), placed))
        compared.append(_verify(forest, shingled, placed, exact))
        for r in compared[-1].where("node is null").groupBy("root").agg(F.sum("links").alias("n")).collect():  # BINS rows at most
            found[r["root"]] = found.get(r["root"], 0) + r["n"]
        shorter = max(least, next_depth(found, threshold, trees, recall, depth))
        if shorter >= depth:
            break
        depth = shorter

    together = compared[0]
    for more in compared[1:]:
        together = together.unionByName(more)
    together = together.where("node is not null")
    root = components(together.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "set")
    counted = together.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = (
        sets.select("node", "sid", "check", "weight", F.col("rep.doc").alias("least")).join(root, F.col("node") == F.col("set"), "left")
        .join(counted.withColumnRenamed("node", "s"), F.col("node") == F.col("s"), "left")
        .select("sid", "check", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    heads = grouped.groupBy("root").agg(F.min("least").alias("class_id"))
    by_set = grouped.join(heads, "root").select("sid", "check", "root", "class_id", "n_links")
    by_row = signed.select("rid", "doc", "sid", "check").distinct().join(by_set, ["sid", "check"]).select("rid", "doc", "root", "class_id", "n_links")
    joined = rows.select("doc_id", "rid", "doc").join(by_row, ["rid", "doc"], "left")
    return joined.select(
        "doc_id", "rid", F.col("root").alias("group_id"), F.when(F.col("class_id") == _LAST, F.lit(None)).otherwise(F.coalesce("class_id", "doc_id")).cast("long").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _new_nodes(under: DataFrame, placed: list[DataFrame]) -> DataFrame:
    """(node, bucket, n, members) of the trie nodes with two sets or more, but for those whose members an earlier node had."""
    nodes = under.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    nodes = nodes.groupBy("n", "members").agg(F.min("bucket").alias("bucket"))
    for earlier in placed:
        nodes = nodes.join(earlier.select("n", "members").distinct(), ["n", "members"], "left_anti")
    return cut(under.join(cut(nodes), "bucket").select("node", "bucket", "n", "members"))


def _verify(forest: DataFrame, shingled: DataFrame, placed: list[DataFrame], threshold: Fraction) -> DataFrame:
    """Links of the sets below the latest nodes, but for those of pairs that share an earlier one."""
    at = placed[-1].groupBy("node").agg(F.collect_list(F.struct("bucket", "n")).alias("at"))  # one a tree at most
    before = None
    for p in placed[:-1]:
        before = p.select("node", "bucket") if before is None else before.unionByName(p.select("node", "bucket"))
    if before is None:
        at = at.withColumn("earlier", F.array().cast("array<long>"))
    else:
        before = before.groupBy("node").agg(F.collect_list("bucket").alias("earlier"))
        at = at.join(before, "node", "left").withColumn("earlier", F.coalesce("earlier", F.array().cast("array<long>")))
    blocks = F.ceil(F.col("a.n") / BLOCK).cast("int")
    dealt = (
        shingled.join(at.join(forest.select("node", "weight"), "node"), "node")
        .select("node", "weight", F.col("at.bucket").alias("buckets"), "earlier", "shingles", F.explode("at").alias("a"))
        .withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("node", "weight", "buckets", "earlier", "shingles", F.col("a.bucket").alias("bucket"), F.least("side", "other").alias("first"), F.greatest("side", "other").alias("second"), "side")
    )
    dealt = dealt.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")
    return cut(dealt.mapInArrow(_compare(threshold), "node long, root long, links long"))
