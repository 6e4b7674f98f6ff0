"""Repeat removal against brute force."""

import hashlib
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from ensemblecast.llm import repeats, substring, suffix_dedup

DOCS = "doc_id long, text string, lang string, spans string"


def corpus(seed: int, unit: str, block: int) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(block), text(block)
    out = [text(rnd.randint(0, 3 * block)) for _ in range(25)]
    out += [text(rnd.randint(3, 40)) + " " + passage + "\n" + text(rnd.randint(3, 40)) for _ in range(20)]
    out += [text(9) + " " + passage[: len(passage) // 2] + " " + other + " " + text(5) + "\t" + other for _ in range(3)]
    out += [out[3], out[30], out[30], "", "   ", None, None, "aa " * 90, "aa " * 70, "ab" * 300]
    out += [o and o.replace("a", "b", 1) for o in out[26:40]]
    ids = list(range(len(out)))
    rnd.shuffle(ids)
    rows = [(i, t, "xx", "s") for i, t in zip(ids, out)]
    return rows + [rows[4], (None, out[28], None, None), (None, out[28], None, None)]


def brute_bytes(rows, length):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, raw):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_words(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    order = [repeats.LAST if r[0] is None else r[0] for r in rows]
    first = {}
    for o, w in zip(order, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, o), o)
    out = []
    for r, o, w in zip(rows, order, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < o:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((r[0], len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block", [256, 3])
def test_bytes(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    rows = corpus(1, "bytes", 30)
    df = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3), 40).drop("kept")
    assert Counter(tuple(r) for r in df.collect()) == brute_bytes(rows, 40)


@pytest.mark.parametrize("block, broadcast", [(256, 0), (3, 0), (3, 1 << 30)])
def test_words(spark, monkeypatch, block, broadcast):
    """By a shuffle, in blocks, and by broadcast automata."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    rows = corpus(2, "words", 24)
    df = substring.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3), 10, broadcast_bytes=broadcast).drop("kept")
    assert Counter(tuple(r) for r in df.collect()) == brute_words(rows, 10)


def test_sections(monkeypatch):
    """Texts over a section's length get the same anchors."""
    values = np.random.default_rng(3).integers(0, 1 << 62, 1000).astype(np.uint64) << np.uint64(2)
    values[300:420] = values[300]
    want = [min(range(a, a + 21), key=lambda k: (int(values[k]) >> 7, k)) for a in range(980)]
    monkeypatch.setattr(repeats, "SECTION_BITS", 7)
    assert repeats.sliding_argmin(values, 21).tolist() == want


def test_long_texts(spark):
    """A text of a few megabytes, and one word a hundred thousand times."""
    rnd = random.Random(8)
    long = " ".join(f"{rnd.randrange(1 << 40):x}" for _ in range(300_000))
    rows = [(1, long), (2, "x " * 100_000), (3, "before " + long[1_000_000:1_002_000] + " after"), (4, "y x " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert {k: r["n_removed"] for k, r in got.items()} == {1: 2000, 2: 200_000, 3: 2000, 4: 0}
    words = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs).collect()}
    assert words[1] == words[2] == words[4] == 0 and words[3] in (len(long[1_000_000:1_002_000].split()) - k for k in range(3))


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert substring.remove_repeats(none).count() == 0


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_sections_of_a_long_text(monkeypatch, unit):
    """A text in sections has the windows of the whole text, each once, and the same segments around them."""
    rnd = random.Random(4)
    text = " ".join("".join(rnd.choice("ab") for _ in range(rnd.choice([1, 2, 3, 700]))) for _ in range(900)).encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    spec = repeats.Spec(20, 12, 3, unit, False)
    values, _ = repeats.units(data, offs, unit)
    monkeypatch.setattr(repeats.tk, "CHUNK_BYTES", 512)
    seen = np.zeros(len(values), int)
    for first, own, at in repeats.sections(data, offs, unit, spec.length - 1):
        np.testing.assert_array_equal(own, values[first : first + len(own)])
        seen[first : first + max(0, len(own) - spec.length + 1)] += 1
        key, ctx, row, place, run = repeats.anchors(own, at, spec)
        picks = [[{"key": 0, "ctx": 0, "doc": 0, "blocks": 1, "place": int(p + (first << 20))} for p in place]]
        found = Counter(s[-1] for s in repeats._cut_out(data, offs, picks, spec))
        flat = data if unit == "bytes" else values
        want = Counter()
        for p in place:
            pos, left, right = (int(x) for x in (p >> 20, p >> 10 & 1023, p & 1023))
            want[flat[first + pos - left : first + pos + spec.core + right].tobytes()] += 1
        assert found == want
    assert (seen[: len(values) - spec.length + 1] == 1).all() and not seen[len(values) - spec.length + 1 :].any()


def test_intervals():
    rnd = random.Random(1)
    for _ in range(200):
        spans = [{"a": (a := rnd.randrange(40)), "b": a + rnd.randrange(1, 9)} for _ in range(rnd.randrange(6))]
        mask = [any(s["a"] <= k < s["b"] for s in spans) for k in range(60)]
        starts = [k for k in range(60) if mask[k] and not (k and mask[k - 1])]
        ends = [k for k in range(1, 60) if mask[k - 1] and not mask[k]]
        assert [x.tolist() for x in repeats.tk.intervals(spans)] == [starts, ends]


@pytest.mark.parametrize("chunk", [64, 300])
def test_small_sections(spark, monkeypatch, chunk):
    """Texts that are finished in sections, in one process: the kernels of both operators over brute force."""
    monkeypatch.setattr(repeats.tk, "CHUNK_BYTES", chunk)
    rows = [r for r in corpus(3, "words", 24) if r[0] is not None]
    for r in rows:
        text = (r[1] or "").encode()
        data = np.frombuffer(text, np.uint8)
        whole = text.split()
        got, hashes = [], []
        for a, b in repeats.tk.word_sections(data, chunk):
            got += data[a:b].tobytes().split()
            hashes.append(repeats.tk.section_hashes(data[a:b], chunk))
        assert got == whole
        want, _ = repeats.units(data, np.array([0, len(data)]), "words")
        np.testing.assert_array_equal(np.concatenate([np.zeros(0, np.uint64), *hashes]), want)


MEMORY = """
import hashlib, resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, {root!r})
from ensemblecast.llm import repeats, substring, suffix_dedup
rng = np.random.default_rng(1)
text = np.where(rng.random({size}) < 0.17, 32, rng.integers(97, 123, {size})).astype(np.uint8)
if {one!r}:
    text[:] = 97
column = pa.array([text.tobytes().decode()])
spans = [[{{"a": 1000 * k, "b": 1000 * k + 700}} for k in range(50)]]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
taken = {{}}
captured = lambda docs, spec, decide, finish, schema, *rest: taken.update(spec=spec, finish=finish)
for module in (repeats, substring, suffix_dedup):
    module.without_repeats = captured
{module}.remove_repeats(None, with_text=False)
spec = taken["spec"]
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), column], names=["rid", "doc", "text"])
n = sum(b.num_rows for b in repeats._anchor_rows(spec)(iter([batch])))
taken["finish"](column, spans)
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


@pytest.mark.parametrize("module", ["suffix_dedup", "substring"])
@pytest.mark.parametrize("one", [False, True])
def test_memory_of_a_long_text(module, one):
    """64 MB of words, or of one letter, take under 500 MB beside the text."""
    code = MEMORY.format(root=str(Path(__file__).parents[2]), module=module, size=64 << 20, one=one)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[1]) < 500, done.stdout


def test_planted_passages(spark):
    """Passages of 51 to 120 words, each in two documents of a whole table: all rows equal brute force; by the contract's
    400 bytes the longer ones lose their bytes in both documents, the shorter ones alone are no reason to."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is not null").orderBy("doc_id").collect()]
    rnd = random.Random(51)
    before = {r[0]: r for r in brute_bytes([(d, t, None, None) for d, t in docs], 400)}
    fresh = [d for d, _ in docs if not before[d][2]]  # documents that lose nothing by themselves
    rnd.shuffle(fresh)
    texts_, planted = dict(docs), []
    for one, two in zip(fresh[0::2], fresh[1::2]):
        passage = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.choice([51, 52, 55, 60, 90, 120])))
        for d in (one, two):
            own = texts_[d].split(" ")
            at = rnd.randrange(len(own) + 1)
            texts_[d] = " ".join([*own[:at], passage, *own[at:]])
        planted.append((one, two, len(passage.encode())))
    rows = [(d, t, "xx", "s") for d, t in texts_.items()]
    got = {r["doc_id"]: tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(4)).drop("kept").collect()}
    assert Counter(got.values()) == brute_bytes(rows, 400)
    longer, shorter = [p for p in planted if p[2] >= 400], [p for p in planted if p[2] < 397]
    assert len(longer) > 30 and shorter
    assert all(got[d][2] >= p[2] for p in longer for d in p[:2])
    assert all(got[d][2] == 0 for p in shorter for d in p[:2])
