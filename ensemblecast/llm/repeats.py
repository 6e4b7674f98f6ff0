"""Finding every fixed-length string that repeats in a corpus, without comparing all with all.

The units of a text are its bytes or its words. A string of ``length`` units is found through its *anchor*: the
least k-gram hash among its first ``reach`` positions. Equal strings have the same anchor at the same place, and
the *core*, the ``length - reach + 1`` units from the anchor on, lies in all of them. So:

1. each anchor becomes a row (hash of the core, hash of the core with ``reach - 1`` more units on both sides);
2. rows whose core occurs once are dropped by a count that is pre-aggregated before the shuffle;
3. where all rows of a core agree in their surroundings too, the count alone decides;
4. otherwise one representative of each surrounding goes to a kernel, a core's group at a time, which decides
   window by window. Groups of over ``BLOCK`` representatives are salted into blocks; windows that a block
   can't decide are settled by hash across blocks, one row for each different window.

No step gathers a group of unknown size in one task, and none makes pairs. What is counted by a key is written
before it is joined by that key: both sides of each join are then plain shuffles of tables, which adaptive execution
splits where a core is very common.

A text may be of any length: positions are 43 bits wide, and a text of over a megabyte is hashed, searched, cut into segments and
finished a section at a time, so that memory doesn't grow with it beyond the text itself. A window lies in one section; an anchor whose
windows lie in two is two entries, which count as two surroundings of one core.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensemblecast.llm import textkit as tk
from ensemblecast.session import cut, ship

#: Representatives of one core that a kernel takes at once.
BLOCK = 256
#: Bits of a position in a section of windows, beside which the other bits of a word compare hashes.
SECTION_BITS = 28
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Spec:
    length: int
    reach: int
    gram: int
    unit: str  # "bytes" or "words"
    earlier_only: bool  # a later document's string counts, an earlier one's doesn't

    @property
    def core(self) -> int:
        return self.length - self.reach + 1


def units(data: np.ndarray, offs: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of the units, and the rows' offsets in units."""
    if unit == "bytes":
        return tk.BYTE_VALUES[0][data], offs
    starts, ends, rows = tk.words(data, offs)
    return tk.word_hashes(data, starts, ends), np.searchsorted(rows, np.arange(len(offs)))


def sliding_argmin(values: np.ndarray, reach: int) -> np.ndarray:
    """Position of the leftmost least value of each window of ``reach``."""
    n, section = len(values), (1 << SECTION_BITS) - reach
    if n > section + reach - 1:
        return np.concatenate([sliding_argmin(values[at : at + section + reach - 1], reach) + at for at in range(0, n - reach + 1, section)])
    low = np.uint64(SECTION_BITS)
    tagged = ((values >> low) << low) | np.arange(n, dtype=np.uint64)
    pad = np.full(-n % reach, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([tagged, pad]).reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - reach + 1], ahead[reach - 1 : n])
    return (least & np.uint64((1 << SECTION_BITS) - 1)).astype(np.int64)


def anchors(values: np.ndarray, offs: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """(core's hash, hash with surroundings, row, place, run) of all anchors.

    The surroundings are those of the windows that chose the anchor, as equal windows choose alike. A place packs
    the anchor's position in its row (in units), and the units to the left and to the right of its core. Periodic
    text has equal anchors at even steps; they are one entry, whose run packs the step and their number.
    """
    size = np.diff(offs)
    if not len(values) or size.max() < spec.length:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    sums = tk.prefix(values)
    at = np.arange(len(values) - spec.gram + 1)
    grams = np.full(len(values), np.iinfo(np.uint64).max, np.uint64)
    grams[: len(at)] = tk.range_hash(sums, at, at + spec.gram)
    best = sliding_argmin(grams, spec.reach)
    row = np.repeat(np.arange(len(size)), size)[: len(best)]
    start = np.flatnonzero(np.arange(len(best)) + spec.length <= offs[1:][row])
    a, row = best[start], row[start]
    fresh = np.append(True, (a[1:] != a[:-1]) | (row[1:] != row[:-1]))
    first, last = start[fresh], start[np.append(fresh[1:], True)]
    a, row = a[fresh], row[fresh]
    left, right = a - first, last + spec.length - a - spec.core
    key = tk.range_hash(sums, a, a + spec.core)
    around = tk.range_hash(tk.prefix(values, 1), first, last + spec.length, 1)
    around = tk.mix(around + left.astype(np.uint64))
    step = np.diff(a, prepend=a[:1])
    same = np.append(False, (key[1:] == key[:-1]) & (around[1:] == around[:-1]) & (row[1:] == row[:-1]))
    even = same & np.append(True, ~same[:-1] | (step[1:] == step[:-1]))
    head = np.flatnonzero(~even)
    times = np.diff(np.append(head, len(a)))
    stride = np.where(times > 1, step[np.minimum(head + 1, len(a) - 1)], 0)
    place = (a - offs[row]) << 20 | left << 10 | right
    return key[head], around[head], row[head], place[head], stride << 32 | times


def unpack(place):
    """Position, left and right of a place, as a column or a number."""
    if isinstance(place, int):
        return place >> 20, place >> 10 & 1023, place & 1023
    return F.shiftright(place, 20), F.shiftright(place, 10).bitwiseAND(F.lit(1023)), place.bitwiseAND(F.lit(1023))


def sections(data: np.ndarray, offs: np.ndarray, unit: str, overlap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first unit, values, offsets) of a run of texts at once, or of a long text alone in sections, each of which begins with
    the last ``overlap`` units of the one before."""
    if len(data) <= tk.CHUNK_BYTES or len(offs) > 2:
        yield 0, *units(data, offs, unit)
    elif unit == "bytes":
        for lo in range(0, max(1, len(data) - overlap), tk.CHUNK_BYTES):
            part = data[lo : lo + tk.CHUNK_BYTES + overlap]
            yield lo, tk.BYTE_VALUES[0][part], np.array([0, len(part)])
    else:
        held, first = np.zeros(0, np.uint64), 0
        for lo, hi in tk.word_sections(data, tk.CHUNK_BYTES):
            held = np.append(held, tk.section_hashes(data[lo:hi], tk.CHUNK_BYTES))
            # long words make few units, so sections are gathered until they have enough
            if hi < len(data) and len(held) < overlap + tk.CHUNK_BYTES // 16:
                continue
            yield first, held, np.array([0, len(held)])
            kept = min(overlap, len(held))
            first, held = first + len(held) - kept, held[len(held) - kept :]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(spec: Spec) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, doc = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, data, offs in tk.chunks(batch.column(2)):
                for first, values, at in sections(data, offs, spec.unit, spec.length - 1):
                    key, ctx, row, place, run_ = anchors(values, at, spec)
                    if len(key):
                        yield pa.RecordBatch.from_arrays([_signed(key), _signed(ctx), pa.array(rid[lo + row]), pa.array(doc[lo + row]), pa.array(place + (first << 20)), pa.array(run_)], names=["key", "ctx", "rid", "doc", "place", "run"])

    return run


_SEGMENT = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("blocks", pa.int32()), ("left", pa.int32()), ("seg", pa.binary())])


def _cut_out(data: np.ndarray, offs: np.ndarray, picked: list[list[dict]], spec: Spec) -> Iterator[tuple]:
    """(key, ctx, doc, blocks, left, segment) of each pick of a run of texts, or of one long text."""
    widest = spec.core + 2 * spec.reach
    wanted = []  # (text, first unit of the segment, its end, left, pick)
    for k, own in enumerate(picked):
        for p in own:
            pos, left, right = unpack(p["place"])
            wanted.append((k, pos - left, pos + spec.core + right, left, p))
    if spec.unit == "bytes":
        for k, a, b, left, p in wanted:
            yield p["key"], p["ctx"], p["doc"], p["blocks"], left, data[offs[k] + a : offs[k] + b].tobytes()
        return
    wanted.sort(key=lambda w: w[:3])
    for first, values, at in sections(data, offs, spec.unit, widest):
        rest = []
        for w in wanted:
            k, a, b, left, p = w
            if first <= a and b - first <= at[k + 1] - at[k]:
                yield p["key"], p["ctx"], p["doc"], p["blocks"], left, values[at[k] + a - first : at[k] + b - first].tobytes()
            else:
                rest.append(w)
        wanted = rest


def _segments(spec: Spec) -> Callable:
    """The units around each representative, as bytes (words: eight bytes each)."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SEGMENT)], schema=_SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = batch.column(1)
            for lo, hi, data, offs in tk.chunks(batch.column(0)):
                rows: list[tuple] = []
                for row in _cut_out(data, offs, picked[lo:hi].to_pylist(), spec):
                    rows.append(row)
                    if len(rows) >= 5000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return run


Group = list[tuple[int, int, int, bytes]]  # (context, document, left, segment)


def _kernel(spec: Spec, decide: Callable[[list[Group], Spec], list[list[tuple[np.ndarray, np.ndarray]]]]) -> Callable:
    """Runs ``decide`` on batches of whole groups (input sorted by key and salt)."""
    per = 1 if spec.unit == "bytes" else 8

    def settle(groups: list[tuple[int, bool, Group]]) -> pa.RecordBatch:
        out: list[tuple] = []
        for (key, hot, rows), found in zip(groups, decide([g[2] for g in groups], spec)):
            for (ctx, doc, left, seg), (covered, open_) in zip(rows, found):
                out.extend((key, ctx, a, b + spec.length, None, None, doc) for a, b in _stretches(covered))
                if hot and len(open_):
                    flat = np.frombuffer(seg, np.uint8 if per == 1 else np.uint64)
                    values = tk.BYTE_VALUES[0][flat] if per == 1 else flat
                    for which, name in ((0, "h1"), (1, "h2")):
                        h = tk.range_hash(tk.prefix(values, which), open_, open_ + spec.length, which).view(np.int64)
                        h1, h2 = (h, None) if name == "h1" else (h1, h)
                    out.extend((key, ctx, int(a), int(a) + spec.length, int(x), int(y), doc) for a, x, y in zip(open_, h1, h2))
        return _decided(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[int, bool, Group]] = []
        current, held = None, 0
        for batch in batches:
            for key, ctx, doc, blocks, left, seg, salt in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, salt) != current:
                    if held > 200_000 * per:
                        yield settle(groups)
                        groups, held = [], 0
                    current = key, salt
                    groups.append((key, blocks > 1, []))
                    seen: set[int] = set()
                if ctx not in seen:  # a repeated row has its representative twice
                    seen.add(ctx)
                    groups[-1][2].append((ctx, doc, left, seg))
                    held += len(seg)
        if groups:
            yield settle(groups)

    return run


@dataclass(frozen=True)
class Broadcast:
    """How reference shards of ``most_bytes`` segments in all, or less, are broadcast instead of shuffled.

    ``build`` makes a shard of a group; ``stream`` gives the window starts of one segment that repeat in it.
    """

    build: Callable[[Group, Spec], object]
    stream: Callable[[object, int, int, bytes, Spec], np.ndarray]
    most_bytes: int


_DECIDED = "key long, ctx long, a int, b int, h1 long, h2 long, doc long"


def _streamed(segments: DataFrame, spec: Spec, how: Broadcast) -> DataFrame:
    groups: dict[int, dict[int, tuple]] = {}
    for r in segments.orderBy("key", "doc", "ctx").collect():  # no more than how.most_bytes
        groups.setdefault(r["key"], {}).setdefault(r["ctx"], (r["ctx"], r["doc"], r["left"], bytes(r["seg"])))
    shared = segments.sparkSession.sparkContext.broadcast({key: how.build(list(g.values()), spec) for key, g in groups.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, ctx, doc, left, seg in zip(*(c.to_pylist() for c in batch.columns)):
                for a, b in _stretches(how.stream(shared.value[key], doc, left, seg, spec)):
                    out.append((key, ctx, a, b + spec.length, None, None, doc))
            yield _decided(out)

    return segments.select("key", "ctx", "doc", "left", "seg").mapInArrow(run, _DECIDED)


def _stretches(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each stretch of neighbouring window starts."""
    if len(starts):
        edge = np.flatnonzero(np.diff(starts) > 1)
        for a, b in zip(starts[np.append(0, edge + 1)], starts[np.append(edge, len(starts) - 1)]):
            yield int(a), int(b)


def _decided(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 7
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _DECIDED.split(", ")])


#: ``finish(texts, spans or None per text) -> columns`` computes an operator's result for a run of texts.
Finish = Callable[[pa.Array, list], list[pa.Array]]


def _finish(finish: Finish, names: list[str], touched: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if touched:  # doc_id, text, spans
                for lo, hi, _, _ in tk.chunks(batch.column(1)):
                    columns = finish(batch.column(1)[lo:hi], batch.column(2)[lo:hi].to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *columns], names=names)
                continue
            for lo, hi, _, _ in tk.chunks(batch.column(1)):  # doc_id, text, rid, picked
                ids, text, rid, picked = (batch.column(c)[lo:hi] for c in range(4))
                hit = picked.is_valid()
                rest, own = pa.array(np.flatnonzero(~hit.to_numpy(zero_copy_only=False))), pa.array(np.flatnonzero(hit.to_numpy(zero_copy_only=False)))
                if len(rest):
                    columns = finish(text.take(rest), [None] * len(rest))
                    yield pa.RecordBatch.from_arrays([ids.take(rest), *columns, pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), text.type), pa.nulls(len(rest), picked.type)], names=[*names, "rid", "text", "picked"])
                if len(own):
                    blank = [pa.nulls(len(own), c.type) for c in finish(text[:0], [])]
                    yield pa.RecordBatch.from_arrays([ids.take(own), *blank, rid.take(own), text.take(own), picked.take(own)], names=[*names, "rid", "text", "picked"])

    return run


def without_repeats(docs: DataFrame, spec: Spec, decide: Callable, finish: Finish, schema: str, broadcast: Broadcast | None = None) -> DataFrame:
    """``schema`` (doc_id first) for every row of ``docs``, the repeated units of each text given to ``finish``.

    Texts are shuffled once. Those without a repeated core are finished then and there; the others are kept in a
    table, for their segments and their results.
    """
    ship(docs.sparkSession)
    docs, own = with_rid(docs), ["rid", "doc"]
    rows = cut(docs.select("rid", "doc", "text").mapInArrow(_anchor_rows(spec), "key long, ctx long, rid long, doc long, place long, run long"))
    times, step = F.col("run").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("run", 32)
    keys = rows.groupBy("key").agg(F.sum(times).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"), (F.min("ctx") == F.max("ctx")).alias("alike"))
    keys = cut(keys.where("first < last" if spec.earlier_only else "n > 1").select("key", "first", "alike"))
    found = cut(rows.join(keys, "key"))
    mixed = found.where("not alike").select("key", "ctx", "rid", "doc", "place", "run")
    classes = cut(mixed.groupBy("key", "ctx").agg(F.sum(times).alias("n"), F.min("doc").alias("first"), F.min(F.struct("doc", "rid", "place")).alias("rep")))
    sizes = cut(classes.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    wanted = classes.join(sizes, "key").select(F.col("rep.rid").alias("rid"), F.col("rep.doc").alias("doc"), F.struct("key", "ctx", "rep.doc", "blocks", "rep.place").alias("p"))
    # every text with a repeated core has a list, if only an empty one
    touched = found.select(*own).distinct().select(*own, F.lit(None).cast(wanted.schema["p"].dataType).alias("p"))
    picked = wanted.unionByName(touched).groupBy(*own).agg(F.collect_list("p").alias("picked"))
    names = [c.split()[0] for c in schema.split(", ")]
    kept = cut(
        docs.join(picked, own, "left").select("doc_id", "text", "rid", "picked")
        .mapInArrow(_finish(finish, names, False), f"{schema}, rid long, text string, picked array<{wanted.schema['p'].dataType.simpleString()}>")
    )
    segments = kept.where("size(picked) > 0").select("text", "picked").mapInArrow(_segments(spec), "key long, ctx long, doc long, blocks int, left int, seg binary")
    widest = (spec.core + 2 * spec.reach) * (1 if spec.unit == "bytes" else 8)
    if broadcast and classes.count() * widest <= broadcast.most_bytes:
        decided = cut(_streamed(segments, spec, broadcast))
    else:
        decided = cut(
            segments.withColumn("salt", F.pmod("ctx", "blocks"))
            .repartition("key", "salt").sortWithinPartitions("key", "salt", "doc", "ctx")
            .mapInArrow(_kernel(spec, decide), _DECIDED)
        )
    across = decided.where("h1 is not null")
    settled = across.groupBy("key", "h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"))
    settled = cut(settled.where("least < most" if spec.earlier_only else "n > 1").select("key", "h1", "h2", "least"))
    hot = across.join(settled, ["key", "h1", "h2"]).where("doc > least" if spec.earlier_only else "true")
    windows = decided.where("h1 is null").select("key", "ctx", "a", "b").unionByName(hot.select("key", "ctx", "a", "b"))
    per_class = cut(windows.groupBy("key", "ctx").agg(F.collect_set(F.struct("a", "b")).alias("w")))
    verdicts = cut(classes.select("key", "ctx", "n", "first").join(per_class, ["key", "ctx"], "left"))

    pos, left, right = unpack(F.col("place"))
    # steps are shorter than what one anchor covers, so a run covers everything from its first to its last
    at, far = (pos - left).cast("int"), ((times - 1) * step).cast("int")
    whole = F.array(F.struct(at.alias("a"), (at + left.cast("int") + far + F.lit(spec.core) + right.cast("int")).alias("b")))
    plain = found.where("alike" + (" and doc > first" if spec.earlier_only else "")).select(*own, whole.alias("s"))
    by_kernel = F.transform("w", lambda w: F.struct((at + w["a"]).alias("a"), (at + far + w["b"]).alias("b")))
    known = mixed.join(verdicts, ["key", "ctx"])
    known = known.select(*own, F.when(F.expr("doc > first" if spec.earlier_only else "n > 1"), whole).otherwise(by_kernel).alias("s")).where("s is not null")
    spans = plain.unionByName(known).select(*own, F.explode("s").alias("s")).groupBy(*own).agg(F.collect_set("s").alias("spans"))
    rest = kept.where("picked is not null").select("doc_id", "text", "rid", F.coalesce("doc_id", F.lit(LAST)).alias("doc")).join(spans, own, "left")
    rest = rest.select("doc_id", "text", "spans").mapInArrow(_finish(finish, names, True), schema)
    return kept.where("picked is null").select(*names).unionByName(rest)


def with_rid(docs: DataFrame) -> DataFrame:
    """doc_id, text, rid (a hash of both: equal rows have equal results) and doc (a null id comes last)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("rid"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
    )
