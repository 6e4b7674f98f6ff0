"""Bounded-space online packing of token streams into fixed windows.

Each partition keeps ``open_windows`` windows. A document's ids plus the end id 0 are cut every ``window`` ids;
the remainder goes best-fit into the open window with the least room that holds it. When none holds it and all
windows are open, the fullest is emitted. Windows still open at a partition's end are merged best-fit with
those of ``merge_group`` neighbouring partitions, in descending order of fill.

Null texts are empty documents of one id; an empty table gives an empty result; repeated rows are packed as
often as they occur; of windows with equal room the one opened first is taken (a tie); a text may have any length: all
of it is encoded, alone, and cut; other columns are ignored, whatever their names. Pieces are written to the checkpoint folder before the
leftovers are merged, so a lost executor never sees two different packings.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensemblecast.session import cut, ship

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]

#: How a text is split before merging, and characters that the matcher takes at once.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRETCH = 100_000
_SPACED = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \n]")

_encoders: dict[str, object] = {}


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """A text in parts of about ``most`` characters that are split alike alone: each begins with white space after a character that isn't.

    Where no such place is near, as in a megabyte of blanks, a part is longer.
    """
    lo, n = 0, len(text)
    while n - lo > most:
        cut = _SPACED.search(text, lo + most)
        if cut is None:
            break
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:]


def encoder(path: str):
    """``text -> array of ids`` for a byte-level BPE file of the tokenizers library.

    The vocabulary's own ids are the merge ranks, so the ids equal those of the library; the tests compare them. The library's
    matcher of the split pattern recurses over a run of white space, so a long run is split by another matcher and merged piece by piece.
    """
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        coding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        pieces = regex.compile(PATTERN)
        apart = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")

        def short(text: str) -> list[int]:
            if any(s in text for s in special):
                return coding.encode(text, allowed_special="all")
            return coding.encode_ordinary(text)

        def encode(text: str) -> array:
            ids = array("I")
            for part in stretches(text):
                if len(part) <= 2 * STRETCH:
                    ids.extend(short(part))
                    continue
                for own in apart.split(part):
                    if own in special:
                        ids.append(special[own])
                        continue
                    for piece in pieces.finditer(own):
                        ids.extend(coding._encode_single_piece(piece.group()))
            return ids

        _encoders[path] = encode
    return _encoders[path]


class Packer:
    """The open windows of one partition."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.most, self.next = window, open_windows, first_id
        self.free: list[tuple[int, int]] = []  # (room, window id), ascending
        self.held: dict[int, list[tuple]] = {}

    def _id(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        """Pieces of windows that are complete."""
        n = len(ids)
        for start in range(0, n, self.window):
            part = ids[start : start + self.window]
            piece = (doc_id, start, len(part), zlib.crc32(part.tobytes()), n)
            if len(part) == self.window:
                yield (*piece, self._id(), 0, False)
                continue
            k = bisect.bisect_left(self.free, (len(part), -1))
            if k < len(self.free):
                room, name = self.free.pop(k)
            else:
                if len(self.free) >= self.most:
                    yield from self._emit(self.free.pop(0)[1])
                room, name = self.window, self._id()
                self.held[name] = []
            self.held[name].append((*piece, name, self.window - room))
            room -= len(part)
            if room:
                bisect.insort(self.free, (room, name))
            else:
                yield from self._emit(name)

    def _emit(self, name: int) -> Iterator[tuple]:
        for p in self.held.pop(name):
            yield (*p, False)

    def leftovers(self) -> Iterator[tuple]:
        for pieces in self.held.values():
            for p in pieces:
                yield (*p, True)


def merge(fills: list[tuple[int, int]], window: int) -> list[tuple[int, int, int]]:
    """(window id, sequence id, shift) after best-fit of ``(window id, fill)`` by descending fill."""
    free: list[tuple[int, int]] = []
    out = []
    for name, fill in sorted(fills, key=lambda x: (-x[1], x[0])):
        k = bisect.bisect_left(free, (fill, -1))
        room, target = free.pop(k) if k < len(free) else (window, name)
        out.append((name, target, window - room))
        if room > fill:
            bisect.insort(free, (room - fill, target))
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, open_windows: int = 128, merge_group: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(window, open_windows, TaskContext.get().partitionId() << 32)
        schema = pa.schema([(n, pa.bool_() if n == "open" else pa.int64()) for n in _NAMES])
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(0)
                ids = np.frombuffer(ids, np.uint32).astype("<u4", copy=False)
                rows.extend(packer.add(doc_id, ids))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows = []
        rows.extend(packer.leftovers())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def settle(key, pdf):
        import pandas as pd

        return pd.DataFrame(merge(list(zip(pdf["sequence_id"].tolist(), pdf["fill"].tolist())), window), columns=["name", "target", "shift"])

    pieces = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES))
    left = pieces.where("open").groupBy("sequence_id").agg(F.max(F.col("offset") + F.col("length")).alias("fill"))
    # a group holds merge_group * open_windows windows at most
    moves = (
        left.withColumn("g", F.shiftright("sequence_id", 32) / F.lit(merge_group))
        .withColumn("g", F.floor("g"))
        .groupBy("g")
        .applyInPandas(settle, "name long, target long, shift long")
    )
    names = [n for n in _NAMES if n != "open"]
    shifted = (
        pieces.where("open").join(moves, F.col("sequence_id") == F.col("name"))
        .withColumns({"sequence_id": F.col("target"), "offset": F.col("offset") + F.col("shift")})
    )
    return pieces.where("not open").select(*names).unionByName(shifted.select(*names))
