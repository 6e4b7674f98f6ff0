"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of 1- to 3-grams of letters (everything else is one blank) are hashed to ``buckets`` columns; the model
is a log-probability matrix of ``buckets`` x languages, fitted on a bounded sample of labelled texts, chosen by hash, and
broadcast (its size is bounded). A batch is scored as a sparse matrix product: gather the rows of its n-grams, add them up
by text.

The posterior says which learned language is nearest, not whether the text is in any of them. ``typicality`` does: how
far the text's mean log-probability per n-gram lies from that of the sample's texts of the language, in standard
deviations, of which a short text has larger ones. What is far below is of no learned language, or none at all.

A text of over a quarter of a million characters is hashed in stretches, and n-grams are weighed a block of them times languages at a
time, so memory grows neither with a text beyond the text itself nor with n-grams times languages.

A null text, or one without a letter, is ``und`` with score 0 and no typicality, as is everything when nothing was
learned (from an empty table, say). Of languages with equal odds the first by name is taken. A text may have any length: all of
it is read. Other columns are ignored, whatever their names; repeated rows get equal results; an empty table gives an
empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ensemblecast.llm import textkit as tk
from ensemblecast.session import ship

ORDERS = (1, 2, 3)
_SALT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


#: Characters that are hashed at once, and numbers that are gathered at once.
STRETCH, CELLS = 1 << 18, 1 << 20


def _portions(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(text, code points in lower case) of all texts, long ones in stretches that end with a blank where there is one."""
    for k, text in enumerate(texts):
        text = text or ""
        lo = 0
        while len(text) - lo > STRETCH:
            at = text.rfind(" ", lo, lo + STRETCH) + 1 or lo + STRETCH
            yield k, np.frombuffer(text[lo:at].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            lo = at
        yield k, np.frombuffer(text[lo:].lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _lanes(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, text of each; -1 where no n-gram starts) in lanes of about STRETCH code points.

    A text ends with two blanks at which n-grams start, and two at which none does. The last two code points of a
    stretch that goes on are taken again before the next one, and n-grams start at them only there.
    """
    ends, parts, owners, size = np.full(4, 32, np.uint32), [], [], 0
    carry, of = np.zeros(0, np.uint32), -1

    def close() -> None:
        if of >= 0:
            parts.append(np.append(carry, ends))
            owners.append(np.append(np.full(len(carry) + 2, of), [-1, -1]))

    for k, points in _portions(texts):
        if k != of:
            close()
            carry, of = np.zeros(0, np.uint32), k
        points = np.append(carry, points)
        carry = points[max(0, len(points) - 2) :]
        parts.append(points)
        owners.append(np.append(np.full(max(0, len(points) - 2), k), np.full(min(2, len(points)), -1)))
        size += len(points)
        if size >= STRETCH:
            yield np.concatenate(parts), np.concatenate(owners)
            parts, owners, size = [], [], 0
    close()
    if parts:
        yield np.concatenate(parts), np.concatenate(owners)


def features(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, text of each, the texts seen to have a letter), an order and a lane at a time; two blanks end a text."""
    for code, owner in _lanes(texts):
        alpha = letters()[code]
        has = np.unique(owner[alpha & (owner >= 0)])
        code = np.where(alpha, code, np.uint32(32))
        code, starts = np.append(code, np.full(3, 32, np.uint32)), np.flatnonzero(owner >= 0)
        n, of = len(owner), owner[starts]
        for order in ORDERS:
            h = code[:n] * _SALT[0]
            for k in range(1, order):
                h = (h ^ (h >> np.uint32(15))) * _SALT[k] + code[k : n + k] * _SALT[0]
            h = (h ^ (h >> np.uint32(13))) * _SALT[2] + np.uint32(order)
            yield (h >> np.uint32(32 - bits)).astype(np.int32)[starts], of, has


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages
    bits: int
    #: By language: mean log-probability per n-gram, its variance between texts, and that within a text.
    usual: np.ndarray

    def weigh(self, texts: list[str | None], squared: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log-probabilities of texts x languages, n-grams, has a letter, if asked for sums of squares for the nearest language)."""
        total, has, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool), np.zeros(len(texts))
        step = max(1, CELLS // max(1, len(self.languages)))
        for bucket, of, lettered in features(texts, self.bits):
            has[lettered] = True
            size += np.bincount(of, minlength=len(texts))
            for lo in range(0, len(bucket), step):
                own = of[lo : lo + step]
                at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                total[own[at]] += np.add.reduceat(self.log_prob[bucket[lo : lo + step]], at, axis=0, dtype=np.float64)
        squares = np.zeros(len(texts))
        if squared:
            best = (total + self.log_prior).argmax(axis=1)
            for bucket, of, _ in features(texts, self.bits):
                squares += np.bincount(of, self.log_prob[bucket, best[of]].astype(np.float64) ** 2, len(texts))
        return total, size, has, squares

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, posteriors and typicalities (not a number where there is none)."""
        if not texts:
            return [], np.zeros(0), np.zeros(0)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
        total, size, has, _ = self.weigh(texts)
        total += self.log_prior
        best = total.argmax(axis=1)
        mean, between, within = self.usual[best].T
        own = (total - self.log_prior)[np.arange(len(texts)), best] / size
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        score = np.where(has, 1 / odds.sum(axis=1), 0.0)
        typicality = np.where(has, (own - mean) / np.sqrt(between + within / size), np.nan)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, has)], score, typicality


def _batched(column: pa.Array, languages: int = 1) -> Iterator[tuple[int, int, list[str | None]]]:
    """Runs of about a megabyte, and of so many texts that a number a text and language is no more than a few megabytes."""
    most = max(1, CELLS // max(1, languages))
    for first, last, _, _ in tk.chunks(column):
        for lo in range(first, last, most):
            hi = min(last, lo + most)
            yield lo, hi, column[lo:hi].to_pylist()


#: Numbers of a model at most: with more languages there are fewer buckets.
MODEL = 1 << 24


def fit(labelled: DataFrame, per_language: int = 4000, bits: int = 15, alpha: float = 0.5, sample_rows: int = 400_000) -> Model:
    """Fit on about ``sample_rows`` rows (text, lang) chosen by hash, of which a language with more than ``per_language`` is thinned again.

    Every language of the sample is learned, however rare. The matrix has MODEL numbers at most, so with over 512 languages
    (a column with dirty values, say) n-grams share buckets sooner.
    """
    ship(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null").select("text", "lang")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    rate = min(1.0, sample_rows / max(1, labelled.count()))
    drawn = labelled.where(place < rate * (1 << 20))
    sizes = {r["lang"]: r["n"] for r in drawn.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # about sample_rows at most
    while bits > 1 and len(sizes) << bits > MODEL:
        bits -= 1
    share = labelled.sparkSession.createDataFrame([(x, rate * min(1.0, per_language / n)) for x, n in sizes.items()], "lang string, share double")
    sample = drawn.join(F.broadcast(share), "lang").where(place < F.col("share") * (1 << 20)).select("text", "lang")
    index = {lang: k for k, lang in enumerate(sorted(sizes))}
    table = labelled.sparkSession.sparkContext.broadcast(index)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n-grams of a language in a bucket, both in one number."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = np.array([table.value[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi, texts in _batched(batch.column(0)):
                for bucket, of, _ in features(texts, bits):
                    seen, times = np.unique(langs[lo:hi][of] << bits | bucket, return_counts=True)
                    for lang in np.unique(seen >> bits):
                        own = slice(*np.searchsorted(seen, (lang << bits, (lang + 1) << bits)))
                        sums.setdefault(int(lang), np.zeros(1 << bits, np.int64))[seen[own] & ((1 << bits) - 1)] += times[own]
                if len(sums) << bits > MODEL // 4:
                    yield from given(sums)
                    sums = {}
        yield from given(sums)

    def given(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, v in sums.items():
            hot = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hot), lang)), pa.array(hot), pa.array(v[hot])], names=["lang", "bucket", "n"])

    tallied = sample.mapInArrow(tally, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = tallied.toArrow()  # MODEL rows at most
    languages = tuple(index)
    matrix = np.full((1 << bits, len(languages)), alpha, np.float32 if len(languages) > 64 else np.float64)
    matrix[found["bucket"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
    log_prob = np.log(matrix / matrix.sum(axis=0, dtype=np.float64)).astype(np.float32)
    weight = np.array([sizes[x] for x in languages], float)
    draft = Model(languages, np.log(weight / weight.sum()) if len(weight) else weight, log_prob, bits, np.tile([0.0, 1.0, 1.0], (len(languages), 1)))
    if not languages:
        return draft
    shared = labelled.sparkSession.sparkContext.broadcast(draft)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By language: texts, and sums over them of the mean, its square, and the variance within and its share of the mean's."""
        sums = np.zeros((len(languages), 5))
        for batch in batches:
            langs = np.array([index[x] for x in batch.column(1).to_pylist()], int)
            for lo, hi, texts in _batched(batch.column(0), len(languages)):
                total, size, has, squares = shared.value.weigh(texts, True)
                own = langs[lo:hi]
                mine = has & (own == (total + draft.log_prior).argmax(axis=1))
                mean = total[np.arange(len(own)), own] / size
                within = np.maximum(0, squares / size - mean**2)
                for k, x in enumerate((np.ones(len(own)), mean, mean**2, within, within / size)):
                    np.add.at(sums[:, k], own[mine], x[mine])
        yield pa.RecordBatch.from_arrays([pa.array(languages), *(pa.array(sums[:, k]) for k in range(5))], names=["lang", "n", "mean", "square", "within", "noise"])

    found = sample.mapInArrow(spread, "lang string, n double, mean double, square double, within double, noise double")
    found = {r["lang"]: r for r in found.groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("n", "mean", "square", "within", "noise"))).collect()}
    for lang, k in index.items():
        r = found.get(lang)
        if r and r["n"]:
            mean, within = r["mean"] / r["n"], r["within"] / r["n"]
            draft.usual[k] = mean, max(1e-4, r["square"] / r["n"] - mean**2 - r["noise"] / r["n"]), max(1e-4, within)
    return draft


def classify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score and typicality of every row; reads nothing but ``text``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    out = docs.select(*keep, *(["text"] if "text" not in keep else []))
    at = out.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            for lo, hi, texts in _batched(column, len(model.languages)):
                langs, score, typicality = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k)[lo:hi] for k in range(len(keep))), pa.array(langs, pa.string()), pa.array(score), pa.array(typicality, from_pandas=True)],
                    names=[*keep, "lang_pred", "score", "typicality"],
                )

    return out.mapInArrow(run, T.StructType([*out.schema.fields[: len(keep)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("typicality", T.DoubleType())]))
