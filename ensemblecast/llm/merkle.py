"""A Merkle manifest of a table: a leaf for each row, a tree for each group, a root over the groups, a proof for each row.

The hash of a node is the sha256, in hexadecimal text, of its children's. Rows of a group ascend by id; every ``ARITY`` consecutive
nodes (the last run may have fewer, even one) become their parent, until one is left, the group's subroot. Subroots, in the order
of their groups, give the root in the same way.

Leaves are ranked by a range shuffle of digests only, texts stay where they are. A tree is cut into aligned blocks of
``ARITY ** BLOCK`` nodes. Roots of blocks are the nodes of the next tier, cut into blocks themselves, until a tree is one block.
Proofs go down the other way: each block meets the proof of its root in one shuffle and emits the proofs of its leaves in turn by
fractal traversal. Its levels are a stack of subtrees of ``SUBTREE`` levels. Of each the block keeps the existing one, which holds the
siblings of the current leaf, and the desired one, which grows by one leaf a step and is whole when the traversal
gets there. A task so holds the leaves of one block, two subtrees a stack level and the proof above: bounded, however large a tree.

A null field is ``-`` in its leaf; a null id comes before all others, and a null group too. Equal ids of a group (ties, repeated rows)
are ordered by their leaves; an empty table gives an empty result; a text may have any length (it is hashed by Spark and
never leaves its row); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ensemblecast.session import cut, ship

ARITY = 8
#: Levels of a block, and of the subtrees that are stacked in it.
BLOCK, SUBTREE = 3, 1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*fields: Column) -> Column:
    """The leaf of a row: each field is its byte count, a colon and its value, or a dash."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _hash(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class Subtree:
    """Grows from the leaves below it, one at a time, and keeps its nodes of the levels [lo, hi)."""

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        self.kept: list[list[str]] = [[] for _ in range(lo, hi)]
        self.open: list[list[str]] = [[] for _ in range(hi)]  # a run of each level that isn't whole

    def push(self, node: str, level: int = 0) -> None:
        while True:
            if level >= self.lo:
                self.kept[level - self.lo].append(node)
            if level == self.hi - 1:
                return
            self.open[level].append(node)
            if len(self.open[level]) < ARITY:
                return
            node, self.open[level] = _hash(self.open[level]), []
            level += 1

    def finish(self) -> Subtree:
        """Closes the runs that are left when there are no more leaves."""
        for level in range(self.hi - 1):
            if self.open[level]:
                node, self.open[level] = _hash(self.open[level]), []
                self.push(node, level + 1)
        return self


def reduce(leaves: list[str], levels: int) -> str:
    """The node ``levels`` above a block's leaves."""
    for _ in range(levels):
        leaves = [_hash(leaves[k : k + ARITY]) for k in range(0, len(leaves), ARITY)]
    return leaves[0]


def traverse(leaves: list[str], levels: int, step: int = SUBTREE) -> Iterator[list[tuple[int, str]]]:
    """For each leaf in turn its place among the children of its parent and the other children's digests, level by level."""
    bounds = [(lo, min(lo + step, levels)) for lo in range(0, levels, step)]
    span = [ARITY**hi for _, hi in bounds]  # leaves below a subtree

    def grown(k: int, first: int) -> Subtree:
        out = Subtree(*bounds[k])
        for leaf in leaves[first : first + span[k]]:
            out.push(leaf)
        return out.finish()

    existing = [grown(k, 0) for k in range(len(bounds))]
    desired = [Subtree(*b) for b in bounds]
    path: list[tuple[int, str]] = [(0, "")] * levels
    for at in range(len(leaves)):
        for k, (lo, hi) in enumerate(bounds):
            if at and at % span[k] == 0:
                existing[k], desired[k] = desired[k].finish(), Subtree(lo, hi)
            for level in range(lo, hi):
                if at % ARITY**level:
                    break  # no node of this level or above has changed
                own = at % span[k] // ARITY**level
                run, slot = own - own % ARITY, own % ARITY
                nodes = existing[k].kept[level - lo][run : run + ARITY]
                path[level] = slot, "".join(nodes[:slot] + nodes[slot + 1 :])
            if at + span[k] < len(leaves):
                desired[k].push(leaves[at + span[k]])
        yield list(path)


def _levels(size: int, block: int) -> int:
    """Levels of a block in a tree of so many nodes, ``block`` at most."""
    levels = 0
    while levels < block and size > ARITY**levels:
        levels += 1
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows (tree, block, position, ...) of one block at a time, of batches sorted by these."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != current:
                if rows:
                    yield rows
                current, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_NODE = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("size", pa.int64())])


def _roots(block: int) -> Callable:
    """The root of each block (tree, block, position, digest, size of the tree) as a node of the next tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _blocks(batches):
            tree, at, _, _, size = rows[0]
            out.append((tree, at, reduce([r[3] for r in rows], _levels(size, block)), -(-size // ARITY**block)))
            if len(out) >= 10_000:
                yield _batch(out, _NODE)
                out = []
        yield _batch(out, _NODE)

    return run


_PROOF = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.string())]))
PROOF = "array<struct<slot: int, siblings: string>>"


def _proofs(block: int, step: int) -> Callable:
    """Each node (tree, block, position, digest, size, proof above, subroot, root, row) with its proof; a block's first row has what lies above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("proof", _PROOF), ("subroot", pa.string()), ("root", pa.string()), first.schema.field("row")])
        out: list[tuple] = []
        for (_, _, _, _, _, above, subroot, root, _), *nodes in _blocks(itertools.chain([first], batches)):
            for node, path in zip(nodes, traverse([r[3] for r in nodes], _levels(nodes[0][4], block), step)):
                out.append((node[0], node[2], node[3], [{"slot": s, "siblings": d} for s, d in path] + above, subroot, root, node[8]))
                if len(out) >= 2000:
                    yield _batch(out, schema)
                    out = []
        yield _batch(out, schema)

    return run


def ranked(rows: DataFrame) -> DataFrame:
    """tree, pos, digest, size, row of rows (tree, id, digest, row): places within a tree by id and digest, and the tree's size."""
    order = ["tree", "id", "digest"]
    at = F.monotonically_increasing_id()
    table = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "digest", "row", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    parts = table.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    whole = Window.partitionBy("tree")
    earlier = F.sum("n").over(whole.orderBy("part")) - F.col("n")
    # a row a tree and range of the shuffle
    parts = cut(parts.select("tree", "part", (earlier - F.col("least")).alias("shift"), F.sum("n").over(whole).alias("size")))
    return cut(table.join(parts, ["tree", "part"]).select("tree", (F.col("at") + F.col("shift")).alias("pos"), "digest", "size", "row"))


def _in_blocks(nodes: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(kernel, schema)


def _climb(nodes: DataFrame, block: int) -> list[DataFrame]:
    """The tiers of all trees; the last one has a node for each tree."""
    tiers = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 1
    while most > 1 or len(tiers) < 2:
        placed = tiers[-1].select("tree", F.expr(f"pos div {ARITY**block}").alias("block"), "pos", "digest", "size")
        tiers.append(cut(_in_blocks(placed, _roots(block), "tree string, pos long, digest string, size long")))
        most = -(-most // ARITY**block)
    return tiers


def _descend(tiers: list[DataFrame], above: DataFrame, block: int, step: int) -> DataFrame:
    """Proofs of the lowest tier's nodes; ``above`` has tree, proof, subroot, root of each tree's only node."""
    heads = above.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(tiers[:-1]):
        lowest = nodes is tiers[0]
        kind = nodes.schema["row"].dataType.simpleString() if lowest else "int"
        none = lambda **columns: [F.lit(None).cast(t).alias(c) for c, t in columns.items()]
        placed = nodes.select(
            "tree", F.expr(f"pos div {ARITY**block}").alias("block"), "pos", "digest", "size",
            *none(proof=PROOF, subroot="string", root="string"), *(["row"] if lowest else none(row="int")),
        )
        lead = heads.select("tree", "block", F.lit(-1).cast("long").alias("pos"), *none(digest="string", size="long"), "proof", "subroot", "root", *none(row=kind))
        found = _in_blocks(placed.unionByName(lead), _proofs(block, step), f"tree string, pos long, digest string, proof {PROOF}, subroot string, root string, row {kind}")
        heads = found if lowest else cut(found.select("tree", F.col("pos").alias("block"), "proof", "subroot", "root"))
    return heads


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", block: int = BLOCK, step: int = SUBTREE, **carried: Column) -> DataFrame:
    """doc_id, leaf, proof, subroot, root of every row, and small columns of docs to be carried along, named by keyword.

    A proof's entries go from the leaf up: the place among the parent's children, and the other children's digests in order.
    """
    ship(docs.sparkSession)
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # "-" sorts before "="
    doc_id = F.col("doc_id").cast("long")
    row = F.struct(doc_id.alias("doc_id"), *(c.alias(n) for n, c in carried.items()))
    tiers = _climb(ranked(docs.select(tree.alias("tree"), doc_id.alias("id"), leaf_hash(*(F.col(f) for f in fields)).alias("digest"), row.alias("row"))), block)
    groups = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest", F.struct("tree").alias("row"))
    upper = _climb(ranked(groups), block)
    top = upper[-1].select("tree", F.array().cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    heads = cut(_descend(upper, top, block, step).select("row.tree", "proof", F.col("digest").alias("subroot"), "root"))
    proven = _descend(tiers, heads, block, step)
    return proven.select("row.doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof", *(F.col("row").getField(n).alias(n) for n in carried))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda node, p: F.sha2(F.concat(F.substr(p["siblings"], F.lit(1), 64 * p["slot"]), node, F.substr(p["siblings"], 64 * p["slot"] + 1)), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf up, as one text."""
    return F.concat_ws("", F.transform(proof, lambda p: p["siblings"]))
