"""Exact substring removal by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or
another. Candidates come from :mod:`repeats`; a kernel then concatenates the surroundings of equal cores (a core
counts as one symbol), builds their Burrows-Wheeler transform and extends intervals backward, breadth first, so
that common prefixes are found by increasing value. It stops at the minimum length: what has no value by then
has a longer common prefix and repeats.

Null texts are empty; equal rows are rows of their own, so both go (no tie is broken); texts under ``length`` bytes
stay, and a text may have any length; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ensemblecast.llm import textkit as tk
from ensemblecast.llm.repeats import Group, Spec, without_repeats


def _heads(fresh: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, for a text whose last symbol is unlike all others.

    Only suffixes that still tie are sorted again, by one integer of both ranks.
    """
    n, bits = len(text), max(1, int(text.max()).bit_length())
    packed, step = text.astype(np.int64), 1
    while 2 * step * bits <= 62:  # several symbols make the first key
        shifted = np.zeros(n, np.int64)
        shifted[: n - step] = packed[step:]
        packed, step = packed << (bits * step) | shifted, 2 * step
    order = np.argsort(packed)
    key = packed[order]
    first = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = _heads(first)
    while True:
        slots = np.flatnonzero(~first | ~np.append(first[1:], True))
        if not len(slots):
            return order
        who = order[slots]
        key = rank[who] * (n + 2) + rank[np.minimum(who + step, n)] + 1
        sub = np.argsort(key)
        who, key = who[sub], key[sub]
        order[slots] = who
        fresh = np.append(True, key[1:] != key[:-1])
        first[slots] = fresh
        rank[who] = slots[_heads(fresh)]
        step *= 2


def long_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether each suffix shares ``least`` symbols or more with the one before it in ``order``.

    An interval holds the suffixes that begin with one string. Extended backward by a symbol, it ends where a
    common prefix of the string's length is found, unless a shorter one was found there before.
    """
    n = len(text)
    bwt = text[order - 1].astype(np.int64)
    step = np.empty(n, np.int64)  # where the suffix that is one symbol longer stands
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    step = place[order - 1]
    width = int(text.max()) + 1
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lo, size = np.array([0]), np.array([n])
    for _ in range(least):
        if not len(lo):
            break
        owner = np.repeat(np.arange(len(lo)), size)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        key = owner * width + bwt[rows]
        sub = np.argsort(key)
        key = key[sub]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        lo, size = np.minimum.reduceat(step[rows[sub]], at), np.diff(np.append(at, len(key)))
        fresh = ~known[lo + size]
        lo, size = lo[fresh], size[fresh]
        known[lo + size] = True
    return ~known[:n]


def decide(groups: list[Group], spec: Spec) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each segment the window starts that repeat, and those that other blocks must know of."""
    parts, marks, cores = [], [], {}
    n = sum(len(g) for g in groups)  # symbols: a separator a segment, then bytes, then cores
    for g in groups:
        for _, _, left, seg in g:
            raw = np.frombuffer(seg, np.uint8).astype(np.int64) + n
            core = cores.setdefault(seg[left : left + spec.core], len(cores))
            parts.append(np.concatenate([raw[:left], [n + 256 + core], raw[left + spec.core :], [len(parts)]]))
            marks.append(len(parts[-1]))
    if not parts:
        return []
    text = np.concatenate(parts)
    order = suffix_order(text)
    deep = long_prefixes(text, order, spec.reach)
    again = deep | np.append(deep[1:], False)
    repeated, first = np.zeros(len(text), bool), np.zeros(len(text), bool)
    repeated[order] = again
    first[order] = ~deep
    out, at = [], 0
    k = 0
    for g in groups:
        found = []
        for _ in g:
            m = marks[k] - 1
            starts = np.arange(max(0, m - spec.reach + 1))
            mine = at + starts
            found.append((starts[repeated[mine]], starts[first[mine]]))
            at, k = at + marks[k], k + 1
        out.append(found)
    return out


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every row."""
    reach = min(1 + length // 2, 500)
    spec = Spec(length, reach, gram=min(16, length - reach + 1), unit="bytes", earlier_only=False)

    def finish(texts: pa.Array, spans: list) -> list[pa.Array]:
        out: list[list] = [[], [], [], [], []]
        for lo, _, data, offs in tk.chunks(texts):
            for k in range(len(offs) - 1):
                own = memoryview(np.ascontiguousarray(data[offs[k] : offs[k + 1]]))
                starts, ends = tk.intervals(spans[lo + k])
                kept = [own[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(own)])]
                digest = hashlib.sha256()
                for part in kept:
                    digest.update(part)
                for c, v in zip(out, (len(own), int((ends - starts).sum()), len(starts), digest.hexdigest(), b"".join(kept) if with_text else None)):
                    c.append(v)
        return [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]

    return without_repeats(docs, spec, decide, finish, SCHEMA)
