"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Training, on a sample of at most about ``sample_rows`` labelled rows: words and word stems that stand in toxic
texts beyond chance make the lexicon, where equal surroundings count once, so copies of a text don't vote twice.
Scoring: a text's words are matched to the lexicon exactly, by stem, or misspelled, by running the word's
Levenshtein automaton along the lexicon's trie. A window around each hit tells quotation (quote marks on both
sides) from abuse. A ridge logistic regression turns the counts into a score.

Null and empty texts, and all texts when nothing could be learned, score as a text without hits. Labels that are
null are ignored; repeated labels count once, and where they differ (a tie) the toxic one does. A word within an edit
of several terms counts once. A text may have any length: all of it is read, and it is held alone beyond a megabyte.
Equal rows get equal results; an empty table of documents or labels gives an empty result or a model without terms;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ensemblecast.llm import textkit as tk
from ensemblecast.session import ship

WORD = re.compile(r"\w+")
QUOTES = re.compile("[\"«»„“”‟‹›]")
STEMS = (4, 5, 6)
#: Least length of a term that misspellings are sought for, and characters of context on both sides.
FUZZY_LENGTH, CONTEXT = 5, 40
#: Words whose verdicts a worker remembers.
REMEMBERED = 300_000


class Trie:
    """Lexicon terms, with the words within ``distance`` edits found by walking a Levenshtein automaton along it."""

    def __init__(self, terms: list[str], distance: int = 1):
        self.distance, self.root = distance, {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
            half = len(t) // 2
            self.heads.add(t[:half])
            self.tails.add(t[half:])
        self.spans = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})

    def near(self, word: str) -> str | None:
        """A term within the distance, or None. With one edit, one half of the term is intact."""
        if self.distance == 1 and not (any(word[:k] in self.heads for k in self.spans[0]) or any(word[-k:] in self.tails for k in self.spans[1])):
            return None
        # a state is the automaton's set of (position in the word, edits so far)
        stack = [(self.root, frozenset(self._free({(0, 0)}, len(word))))]
        while stack:
            node, state = stack.pop()
            if "" in node and any(p == len(word) for p, _ in state):
                return node[""]
            for c, child in node.items():
                if c:
                    moved = set()
                    for p, e in state:
                        if p < len(word) and word[p] == c:
                            moved.add((p + 1, e))
                        elif e < self.distance:
                            moved.add((p, e + 1))
                            if p < len(word):
                                moved.add((p + 1, e + 1))
                    if moved:
                        stack.append((child, frozenset(self._free(moved, len(word)))))
        return None

    def _free(self, state: set, size: int) -> set:
        """With the word's characters that the term lacks."""
        for p, e in list(state):
            while p < size and e < self.distance:
                p, e = p + 1, e + 1
                state.add((p, e))
        return state


@dataclass(frozen=True)
class Model:
    words: frozenset[str]
    stems: frozenset[str]
    weights: np.ndarray
    known: frozenset[str] = frozenset()  # words near a term that clean texts use

    @property
    def trie(self) -> Trie:
        """Of the words that stand alone; those of a family have near neighbours that mean something else."""
        return Trie([w for w in sorted(self.words) if len(w) >= FUZZY_LENGTH and not any(w[:k] in self.stems for k in STEMS)])


class Scanner:
    """Features of texts: words of the lexicon, stems, misspellings (all outside quotation), quoted hits."""

    def __init__(self, model: Model):
        self.model, self.trie = model, model.trie
        self.cold: set[str] = set()
        self.hot: dict[str, int] = {}

    def _verdict(self, word: str) -> int:
        if word in self.model.words:
            return 0
        if any(word[:k] in self.model.stems for k in STEMS if len(word) > k):
            return 1
        return 2 if len(word) >= FUZZY_LENGTH - 1 and word not in self.model.known and self.trie.near(word) else -1

    def features(self, text: str) -> np.ndarray | None:
        """Counts by kind, or None without hits."""
        low = text.lower()
        fresh = set(WORD.findall(low)) - self.cold
        if not fresh:
            return None
        hits = False
        for w in fresh:
            if w not in self.hot:
                kind = self._verdict(w)
                if kind < 0:
                    self.cold.add(w)
                    continue
                self.hot[w] = kind
            hits = True
        if len(self.cold) > REMEMBERED:
            self.cold = set()
        if not hits:
            return None
        out = np.zeros(4)
        for m in WORD.finditer(low):
            kind = self.hot.get(m[0])
            if kind is not None:
                a, b = m.span()
                quoted = QUOTES.search(low, max(0, a - CONTEXT), a) and QUOTES.search(low, b, b + CONTEXT)
                out[3 if quoted else kind] += 1
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows = np.zeros((len(texts), 4))
        for k, t in enumerate(texts):
            if t:
                found = self.features(t)
                if found is not None:
                    rows[k] = found
        return rows


def design(counts: np.ndarray) -> np.ndarray:
    """Columns of the regression: a one, whether there are hits of each kind, and their logarithms."""
    return np.hstack([np.ones((len(counts), 1)), counts > 0, np.log1p(counts)])


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant isn't penalised."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _terms(word: str) -> Iterator[str]:
    yield "w" + word
    for k in STEMS:
        if len(word) > k:
            yield "s" + word[:k]


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, surroundings, 0) from toxic texts and (term, null, occurrences) from the others."""
    around: set[tuple[str, int]] = set()
    clean: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1)):
            words = WORD.findall((text.as_py() or "").lower())
            if toxic.as_py():
                for a, w, b in zip(["", *words], words, [*words[1:], ""]):
                    if len(w) > 2:
                        ctx = zlib.crc32(f"{a} {b}".encode())
                        around.update((t, ctx) for t in _terms(w))
            else:
                clean.update(t for w in words if len(w) > 2 for t in _terms(w))
    terms = [t for t, _ in around] + list(clean)
    yield pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), pa.array([c for _, c in around] + [None] * len(clean), pa.int64()), pa.array([0] * len(around) + list(clean.values()), pa.int64())],
        names=["term", "ctx", "clean"],
    )


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; both may hold only what may be learned from.

    The lexicon has every term that passes, however many: only the sample of labelled rows is bounded.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = min(1.0, sample_rows / max(1, total))
    # about sample_rows rows, whatever the input
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    n, bad = sample.agg(F.count("*"), F.sum("toxic")).first()
    base = (bad or 0) / max(1, n)
    empty = Model(frozenset(), frozenset(), np.array([np.log((base * n + 0.5) / ((1 - base) * n + 1.5))] + [0.0] * 8))
    if not n or not 0 < base < 1:
        return empty
    evidence = sample.mapInArrow(_evidence, "term string, ctx long, clean long").groupBy("term", "ctx").agg(F.sum("clean").alias("clean"))
    terms = evidence.groupBy("term").agg(F.count("ctx").alias("bad"), F.sum("clean").alias("clean")).where("bad > 2 and bad > 2 * clean")
    # with k toxic surroundings by chance at base**k, over all candidates
    p = F.col("bad") / (F.col("bad") + F.col("clean"))
    gain = F.col("bad") * F.log(p / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - p) / (1 - base))).otherwise(0.0)
    kept = terms.withColumn("gain", gain).where(F.col("gain") > float(np.log(20.0 * max(n, 100)))).collect()  # of a bounded sample
    support = {r["term"]: r["bad"] for r in kept}
    words = frozenset(t[1:] for t in support if t[0] == "w")
    # a stem stands for a family of words, not for one word
    single = {w[:k] for w in words for k in STEMS if 2 * support["w" + w] > support.get("s" + w[:k], 0)}
    stems = frozenset(t[1:] for t in support if t[0] == "s" and t[1:] not in single)
    if not words and not stems:
        return empty
    draft = Model(words, stems, empty.weights)
    shared = spark.sparkContext.broadcast(draft)

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                scanner.features(text or "")
        yield pa.RecordBatch.from_arrays([pa.array([w for w, kind in scanner.hot.items() if kind == 2], pa.string())], names=["word"])

    # one half of the sample tells which near misses are ordinary words, the other half sets the weights
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    near = sample.where((half == 0) & (F.col("toxic") == 0)).select("text").mapInArrow(ordinary, "word string").distinct()
    known = frozenset(r[0] for r in near.collect())  # of a bounded sample
    final = spark.sparkContext.broadcast(Model(words, stems, empty.weights, known))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(final.value)
        for batch in batches:
            found = scanner.score(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k]) for k in range(4)), batch.column(1)], names=["a", "b", "c", "d", "toxic"])

    # equal counts are equal rows of the regression
    other = sample.where(half == 1).select("text", "toxic").mapInArrow(count, "a double, b double, c double, d double, toxic int")
    table = other.groupBy("a", "b", "c", "d", "toxic").count().toPandas()
    rows = table.loc[table.index.repeat(table["count"])]
    x, y = design(rows[["a", "b", "c", "d"]].to_numpy(float)), rows["toxic"].to_numpy(float)
    # a misspelt term counts as abuse until the sample says otherwise
    prior = np.zeros((4, 4))
    prior[:, 2] = 1
    x, y = np.vstack([x, design(prior)]), np.append(y, np.ones(4))
    weights, active = np.zeros(x.shape[1]), np.ones(x.shape[1], bool)
    while True:  # hits never speak against toxicity
        weights[:] = 0
        weights[active] = regress(x[:, active], y)
        wrong = active & (weights < 0)
        wrong[0] = False
        if not wrong.any():
            break
        active &= ~wrong
    return Model(words, stems, weights, known)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score, predicted and hits of every row; reads nothing but ``text``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    out = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            for lo, hi, _, _ in tk.chunks(batch.column(len(keep))):
                counts = scanner.score(batch.column(len(keep))[lo:hi].to_pylist())
                p = 1 / (1 + np.exp(-design(counts) @ shared.value.weights))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k)[lo:hi] for k in range(len(keep))), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(counts.sum(axis=1).astype(np.int64))],
                    names=[*keep, "score", "predicted", "hits"],
                )

    return out.mapInArrow(run, T.StructType([*out.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("hits", T.LongType())]))
