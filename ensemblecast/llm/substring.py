"""Substring removal over words, by suffix automata of reference shards.

A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a smaller
id. Candidates come from :mod:`repeats`: a reference shard is the surroundings of one core (or one block of
them), in order of doc_id. Documents stream through the shard's suffix automaton, which gives the longest match
that ends at each word (matching statistics) and the first document that has it; matches of the window's length in an
earlier document mark their words.

All shards together grow with the corpus. Where their counted size is at most ``broadcast_bytes`` the automata are
broadcast and the documents' segments stream through them; beyond it a shard meets its documents by a shuffle on the
core's hash, and one shard is bounded. Results are equal.

Null texts have no words; a null doc_id counts as the largest; rows with the same doc_id (ties) never remove from each
other, and equal rows have equal results; a text may have any length; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ensemblecast.llm import textkit as tk
from ensemblecast.llm.repeats import Broadcast, Group, Spec, without_repeats

#: Bytes of reference segments whose automata may be broadcast, an eighth as many words.
BROADCAST_BYTES = 1 << 20


class SuffixAutomaton:
    """Of several sequences, each added in one go; a state knows the first of the sequences that have its strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.first: list[int] = [-1]

    def _clone(self, p: int, symbol: int, q: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def add(self, sequence: list[int], name: int = 0) -> None:
        """``name`` is no less than that of any sequence before."""
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, symbol, q)
                continue
            new, p = len(self.next), last
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            self.first.append(name)
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, symbol, q)
            last = new

    def match(self, sequence: list[int], most: int) -> tuple[list[int], list[int]]:
        """At each symbol the length of the longest match that ends there, up to ``most``, and the first sequence that has it."""
        state, size, sizes, names = 0, 0, [], []
        nxt, link, length, first = self.next, self.link, self.length, self.first
        for symbol in sequence:
            while state and symbol not in nxt[state]:
                state = link[state]
                size = length[state]
            if symbol in nxt[state]:
                state, size = nxt[state][symbol], size + 1
            if size >= most:
                size = most
                while length[link[state]] >= most:
                    state = link[state]
            sizes.append(size)
            names.append(first[state])
        return sizes, names


def _sequence(left: int, seg: bytes, spec: Spec) -> tuple[bytes, list[int]]:
    """The core, and the words around it with the core as one symbol."""
    words = np.frombuffer(seg, np.uint64).tolist()
    return seg[8 * left : 8 * (left + spec.core)], [*words[:left], -1, *words[left + spec.core :]]


def shard(group: Group, spec: Spec) -> dict[bytes, SuffixAutomaton]:
    """Automata of a group in order of document, one for each core (different cores may share a hash)."""
    out: dict[bytes, SuffixAutomaton] = {}
    for _, doc, left, seg in group:
        core, sequence = _sequence(left, seg, spec)
        out.setdefault(core, SuffixAutomaton()).add(sequence, doc)
    return out


def stream(automata: dict[bytes, SuffixAutomaton], doc: int, left: int, seg: bytes, spec: Spec) -> np.ndarray:
    """The window starts of a segment that an earlier document has."""
    core, sequence = _sequence(left, seg, spec)
    sizes, names = (np.array(x)[spec.reach - 1 :] for x in automata[core].match(sequence, spec.reach))
    return np.flatnonzero((sizes >= spec.reach) & (names < doc))


def decide(groups: list[Group], spec: Spec) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each segment the window starts that an earlier document has, and the others."""
    out = []
    for g in groups:
        automata = shard(g, spec)
        found = []
        for _, doc, left, seg in g:
            hit = stream(automata, doc, left, seg, spec)
            starts = np.arange(max(0, len(seg) // 8 - spec.length + 1))
            found.append((hit, np.setdiff1d(starts, hit)))
        out.append(found)
    return out


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, window: int = 50, with_text: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words of every row."""
    reach = min(1 + 3 * window // 4, 500)
    spec = Spec(window, reach, gram=min(3, window - reach + 1), unit="words", earlier_only=True)

    def finish(texts: pa.Array, spans: list) -> list[pa.Array]:
        out: list[list] = [[], [], [], []]
        for lo, _, data, offs in tk.chunks(texts):
            for k in range(len(offs) - 1):
                n, removed, body = 0, 0, []
                digest, gap = hashlib.sha256(), b""
                starts, ends = tk.intervals(spans[lo + k])
                own = data[offs[k] : offs[k + 1]]
                for a, b in tk.word_sections(own):
                    kept = own[a:b].tobytes().split()  # at the separators of tk.SPACE
                    n += (count := len(kept))
                    near = slice(*np.searchsorted(ends, (n - count, n), side="right") + (0, 1))
                    if len(starts[near]):
                        gone = np.zeros(count, bool)
                        for x, y in zip(starts[near], ends[near]):
                            gone[max(0, x - n + count) : max(0, y - n + count)] = True
                        removed += int(gone.sum())
                        kept = list(compress(kept, ~gone))
                    if kept:
                        piece = gap + b" ".join(kept)
                        digest.update(piece)
                        gap = b" "
                        if with_text:
                            body.append(piece)
                for c, v in zip(out, (n, removed, digest.hexdigest(), b"".join(body).decode() if with_text else None)):
                    c.append(v)
        return [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))]

    return without_repeats(docs, spec, decide, finish, SCHEMA, Broadcast(shard, stream, broadcast_bytes))
