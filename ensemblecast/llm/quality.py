"""Quality rules as a short-circuit cascade.

Each rule reads lazily computed text measures. A sample of about ``sample_rows`` rows, chosen by hash from the whole
table, gives every rule's rejections, and its cost beside the measures that are returned anyway; rules then run in
order of rejections per second (ties: as they are given), each on the rows that the earlier ones left. The order never
changes a verdict, only the work; but as costs are measured, ``rejected_by``, the first rule that rejects a text, may differ
between two runs where several would.

Null texts have no words; a text may have any length: all of it is read, one of over a megabyte a section at a time; an
empty table gives an empty result; repeated rows are judged alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensemblecast.llm import textkit as tk
from ensemblecast.session import ship

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True


class Measures:
    """Measures of a run of texts, each computed when first asked for."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1

    def __getattr__(self, name: str):
        value = getattr(self, f"_{name}")()
        setattr(self, name, value)
        return value

    def _sum(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def _word_runs(self):
        return tk.words(self.data, self.offs)

    def _hashes(self):
        return tk.word_hashes(self.data, *self.word_runs[:2])

    def _n_words(self):
        return tk.counts(self.word_runs[2], self.n)

    def _word_chars(self):
        return self._sum(tk.in_words(self.data))

    def _n_symbols(self):
        return self._sum(SYMBOLS[self.data])

    def _lines(self):
        """Rows and hashes of the lines that hold a word."""
        starts, ends, rows = tk.runs(self.data != 10, self.offs)
        if not len(starts):
            return rows, np.zeros(0, np.uint64)
        full = np.concatenate([[0], np.cumsum(~tk.SPACE[self.data])])
        keep = full[ends] > full[starts]
        starts, ends, rows = starts[keep], ends[keep], rows[keep]
        return rows, tk.word_hashes(self.data, starts, ends)

    def _n_lines(self):
        return tk.counts(self.lines[0], self.n)

    def _n_dup_lines(self):
        rows, hashes = self.lines
        order = np.lexsort((hashes, rows))
        r, h = rows[order], hashes[order]
        same = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
        return tk.counts(r[1:][same], self.n)

    def _n_repeat_words(self):
        rows = self.word_runs[2]
        at, hashes = tk.grams(self.hashes, rows, 5)
        keyed = hashes ^ tk.mix(rows[at] + 1)
        _, back, times = np.unique(keyed, return_inverse=True, return_counts=True)
        covered = tk.spread(at[times[back] > 1], 5, len(rows))
        return tk.counts(rows[covered], self.n)

    def _upper_share(self):
        return self._sum(UPPER[self.data]) / np.maximum(1, self._sum(LETTER[self.data]))


class LongMeasures(Measures):
    """Of one long text, a section at a time; what is held of it whole is a hash for each word, twice at most, and for each line."""

    def _hashes(self):
        return tk.long_hashes(self.data)

    def _n_words(self):
        return np.array([len(self.hashes)])

    def _parts(self) -> Iterator[np.ndarray]:
        for a in range(0, len(self.data), tk.CHUNK_BYTES):
            yield self.data[a : a + tk.CHUNK_BYTES]

    def _word_chars(self):
        return np.array([sum(int(tk.in_words(p).sum()) for p in self._parts())])

    def _sum(self, mask: np.ndarray) -> np.ndarray:
        raise NotImplementedError("masks of a long text aren't made")

    def _n_symbols(self):
        return np.array([sum(int(SYMBOLS[p].sum()) for p in self._parts())])

    def _upper_share(self):
        upper, letters = (sum(int(kind[p].sum()) for p in self._parts()) for kind in (UPPER, LETTER))
        return np.array([upper / max(1, letters)])

    def _lines(self):
        """A line that goes on in the next section is held as its sum so far, its length, and whether it has a word."""
        made: list[np.ndarray] = []
        total, length, worded, base = 0, 0, False, int(tk.BASES[0])

        def close() -> None:
            nonlocal total, length, worded
            if worded:
                made.append(tk.mix(np.array([(total + length) % (1 << 64)], np.uint64)))
            total, length, worded = 0, 0, False

        for part in self._parts():
            starts, ends, _ = tk.runs(part != 10, np.array([0, len(part)]))
            if len(part) and part[0] == 10:
                close()
            if not len(starts):
                continue
            sums, inverse = tk.prefix(tk.BYTE_VALUES[0][part]), tk.powers(len(part) + 1, inverse=True)
            own = (sums[ends] - sums[starts]) * inverse[starts]
            full = np.append(0, np.cumsum(~tk.SPACE[part]))
            has = full[ends] > full[starts]
            first = int(starts[0] == 0)
            if first:
                total += int(own[0]) * pow(base, length, 1 << 64)
                length, worded = length + int(ends[0]), worded or bool(has[0])
                if ends[0] < len(part):
                    close()
            last = len(starts) - int(ends[-1] == len(part) and len(starts) > first)
            whole = slice(first, last)
            made.append(tk.mix(own[whole] + (ends - starts)[whole].astype(np.uint64))[has[whole]])
            if last < len(starts):
                total, length, worded = int(own[last]), int(ends[last] - starts[last]), bool(has[last])
        close()
        hashes = np.concatenate(made) if made else np.zeros(0, np.uint64)
        return np.zeros(len(hashes), np.int64), hashes

    def _n_dup_lines(self):
        hashes = np.sort(self.lines[1])
        return np.array([int((hashes[1:] == hashes[:-1]).sum())])

    def _n_repeat_words(self):
        every = np.concatenate([g for _, g in tk.gram_sections(self.hashes, 5)]) if len(self.hashes) > 4 else np.zeros(0, np.uint64)
        every.sort()
        again = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        covered = np.zeros(len(self.hashes), bool)
        for a, g in tk.gram_sections(self.hashes, 5):
            near = np.minimum(np.searchsorted(again, g), len(again) - 1) if len(again) else None
            if near is not None:
                hit = np.flatnonzero(again[near] == g) + a
                for k in range(5):
                    covered[hit + k] = True
        return np.array([int(covered.sum())])


def measures_of(data: np.ndarray, offs: np.ndarray) -> Measures:
    return (LongMeasures if tk.is_long(data, offs) else Measures)(data, offs)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], np.ndarray]


#: Words too few, windows too repetitive: the base. Then symbols, repeated lines, capitals, odd word lengths.
BASE = (
    Rule("few_words", lambda m: m.n_words < 10),
    Rule("repetition", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
)
RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols > 2 * m.n_words),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > m.n_lines),
    Rule("capitals", lambda m: m.upper_share > 0.5),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words)),
)


def _take(data: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [data[offs[i] : offs[i + 1]] for i in keep]
    return (np.concatenate(parts) if parts else data[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def cascade(data: np.ndarray, offs: np.ndarray, rules: tuple[Rule, ...], measures: Measures | None = None) -> np.ndarray:
    """Index of the first rule that rejects each text, or -1; later rules see only what is left.

    ``measures`` may bring in measures that are known already; texts are copied only once half have gone.
    """
    verdict, left = np.full(len(offs) - 1, -1), np.arange(len(offs) - 1)
    m = measures or measures_of(data, offs)
    view = left
    for k, rule in enumerate(rules):
        if not len(left):
            break
        if 2 * len(left) < len(view):
            m, view = Measures(*_take(data, offs, left)), left
        hit = np.isin(view, left) & rule.rejects(m)
        verdict[view[hit]] = k
        left = view[np.isin(view, left) & ~hit]
    return verdict


#: Measures that the result has, so that no rule pays for them.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _returned(m: Measures) -> dict[str, np.ndarray]:
    for name in RETURNED:
        getattr(m, name)
    return dict(vars(m))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> tuple[Rule, ...]:
    """``rules`` by rejections per second on a sample of about ``sample_rows`` whole texts, best first."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = np.full(len(rules), 1e-9), np.zeros(len(rules), int)
        for batch in batches:
            for _, _, data, offs in tk.chunks(batch.column(0)):
                known = _returned(measures_of(data, offs))
                for k, rule in enumerate(rules):
                    m = measures_of(data, offs)
                    vars(m).update(known)
                    began = time.perf_counter()
                    rejected[k] += int(rule.rejects(m).sum())
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules))), pa.array(rejected), pa.array(spent)], names=["k", "rejected", "spent"])

    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)).select("text")
    costs = sample.mapInArrow(run, "k long, rejected long, spent double").groupBy("k").agg(F.sum("rejected").alias("rejected"), F.sum("spent").alias("spent"))
    best = costs.orderBy(F.desc((F.col("rejected") + 0.5) / F.col("spent")), "k").collect()
    return tuple(rules[r[0]] for r in best) or rules


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The measures of every text, whether the base fails, and the cascade's verdict."""
    ship(docs.sparkSession)
    ordered = order_rules(docs, rules, sample_rows)
    names = ["base", *(r.name for r in ordered)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(batch.column(1)):
                m = measures_of(data, offs)
                failed = np.logical_or.reduce([r.rejects(m) for r in BASE])
                verdict = np.where(failed, 0, -1)
                left = np.flatnonzero(~failed)
                whole = 2 * len(left) >= len(failed)
                found = cascade(data, offs, ordered, m)[left] if whole else cascade(*_take(data, offs, left), ordered)
                verdict[left] = np.where(found >= 0, found + 1, -1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], *(pa.array(getattr(m, c).astype(np.int64)) for c in RETURNED), pa.array(failed), pa.array(verdict < 0), pa.array([names[v] if v >= 0 else None for v in verdict], pa.string())],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
