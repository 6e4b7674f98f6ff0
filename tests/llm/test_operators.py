import itertools
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ensemblecast.llm import decontam, jaccard, langid, packing, quality, queries, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """With columns whose names clash with those of the operators."""
    full = [(*r, "a", 7, 1.5) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, shard string, size int, score double").repartition(3)


def texts(n=120, seed=0):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé#|") for _ in range(rnd.randint(1, 5)))
    out = ["\n".join(" ".join(word() for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 8))) for _ in range(n)]
    out += ["x y z w v " * 9, "same\nsame\nsame\n" * 5, "", "  \t", None, "é" * 50, "long " + "ab " * 30_000, out[3], out[3]]
    return out


def rows_of(out):
    rows = list(enumerate(out))
    return rows + [rows[5], (None, "no id here"), (None, None)]


# sharding


def least_bytes(by_old: dict[int, list[int]], capacities: list[int]) -> int:
    """Brute force: each old shard gives its smallest rows beyond its capacity, one without a new shard gives all."""
    return sum(sum(sorted(sizes)[: max(0, len(sizes) - (capacities[o] if o < len(capacities) else 0))]) for o, sizes in by_old.items())


def test_flow_moves_fewest_bytes():
    rnd = random.Random(1)
    for trial in range(20):
        by_old = {o: sorted(rnd.randint(1, 9) for _ in range(rnd.randint(1, 12))) for o in range(3 + trial % 3)}
        stats = [(o, b, len(own), sum(own)) for o, sizes in by_old.items() for b in range(3) if (own := [x for x in sizes if (x - 1) // 3 == b])]
        total = sum(s[2] for s in stats)
        capacities = [total // 4 + (j < total % 4) for j in range(4)]
        pieces = sharding.plan_transfers(stats, capacities)
        filled = Counter()
        for p in pieces:
            filled[p.shard] += p.last - p.first + 1
        assert [filled[j] for j in range(4)] == capacities
        rows = {(o, b): [x for x in sizes if (x - 1) // 3 == b] for o, sizes in by_old.items() for b in range(3)}
        assert sum(sum(rows[p.old, p.block][p.first : p.last + 1]) for p in pieces if p.old != p.shard) == least_bytes(by_old, capacities)


def test_reshard(spark, tmp_path):
    rows = rows_of(texts())
    docs = documents(spark, rows)
    old = F.pmod(F.xxhash64("doc_id"), F.lit(9)).cast("int")
    got = sharding.reshard(docs, 7, old, 4).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 7 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    made = sharding.plan(docs, 7, old)
    touched = sharding.rewrite(docs, made, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter(r[0] for r in back.select("shard").collect()) == Counter({k: len(v) for k, v in by.items() if k in touched})
    assert sharding.reshard(documents(spark, []), 7, old, 4).count() == 0


def test_shards_that_stay_are_not_rewritten(spark, tmp_path):
    rows = [(k, "x" * (k % 7)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("old", F.floor(F.col("doc_id") / F.when(F.col("doc_id") < 30, 10).otherwise(5)).cast("string"))
    rows = sharding.reshard_files(docs, str(tmp_path / "s"), 4, F.col("old")).collect()
    kept = {r["shard"] for r in rows if not r["moved"]} - {int(p.name.split("=")[1]) for p in (tmp_path / "s").glob("shard=*")}
    assert len(rows) == 40 and len(kept) == 3 and sum(r["moved"] for r in rows) == 5
    assert Counter(r["shard"] for r in rows) == Counter({k: 10 for k in range(4)})


def test_reshard_is_least_to_the_row(spark):
    """On whole documents: the bytes moved equal the bound of the rows themselves, with many equal sizes too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("one text for all")))
    old = F.pmod(F.xxhash64("doc_id"), F.lit(11)).cast("int")
    rows = sharding.reshard(docs, 20, old).collect()
    by_old = defaultdict(list)
    for r in rows:
        by_old[r["old_shard"]].append(r["size"])
    capacities = [len(rows) // 20 + (j < len(rows) % 20) for j in range(20)]
    assert sum(r["size"] for r in rows if r["moved"]) == least_bytes(by_old, capacities)


# packing


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(queries.tokenizer_path()), packing.encoder(queries.tokenizer_path())
    rnd = random.Random(3)
    samples = ["", " ", "Hello  world's\n\n end", "ünïcödé ÄÖ ß 漢字 😀 \x00\x07", "a<|endoftext|>b <|endoftext|>", "x" * 3000, "1234 5,6%%% $$$\r\n\t  tab", "    "]
    samples += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 1000), rnd.randint(0x4E00, 0x4F00), 10, 32, 32])) for _ in range(rnd.randint(1, 200))) for _ in range(200)]
    for t in samples:
        assert list(ours(t)) == library.encode(t, add_special_tokens=False).ids, t


def runs(size):
    return [" " * size, "\n" * size, "\t" * size, "a" * size, "7" * size, "%" * size]


def test_encoder_of_long_texts(monkeypatch):
    """Runs of one character, and texts that are encoded in stretches, equal the tokenizers library."""
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(queries.tokenizer_path()), packing.encoder(queries.tokenizer_path())
    rnd = random.Random(6)
    for run in runs(1_000_000):
        for t in (f"a b{run}c d", run):
            assert list(ours(t)) == library.encode(t, add_special_tokens=False).ids
    for run in runs(10_000_000):
        assert len(ours(f"x{run}y")) > 2_000_000
    monkeypatch.setattr(packing, "STRETCH", 20)
    monkeypatch.setattr(packing.stretches, "__defaults__", (20,))
    for _ in range(300):
        t = "".join(rnd.choice(["a", "bc", "É", "1", " ", "  ", "\n", "\t", "\x1c", "\x85", "'s", "%", "<|endoftext|>", "日本", " " * 60, "\n" * 70]) for _ in range(rnd.randint(1, 120)))
        assert list(ours(t)) == library.encode(t, add_special_tokens=False).ids, t


def test_pack_long_runs(spark):
    rows = [(1, "a" + " " * 1_000_000 + "b"), (2, "c\n" + "\n" * 1_000_000), (3, "short")]
    got = packing.pack(documents(spark, rows), queries.tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert all(r["n"] == r["of"] for r in got) and {r["doc_id"]: r["n"] for r in got}[1] == 1_000_002


def test_pack(spark):
    rows = rows_of(texts())
    got = packing.pack(documents(spark, rows), queries.tokenizer_path(), 256, 4, 2).collect()
    encode = packing.encoder(queries.tokenizer_path())
    want = Counter()
    for d, t in rows:
        want[d, len(encode(t or "")) + 1] += 1
    pieces = defaultdict(list)
    by_window = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_window.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 256
    total = sum(r["length"] for r in got)
    assert total == sum(n * c for (_, n), c in want.items()) and total / (256 * len(by_window)) > 0.85
    for d, t in rows:
        if d is not None and sum(x[0] == d for x in rows) == 1:
            ids = np.array([*encode(t or ""), 0], "<u4")
            own = sorted(pieces[d], key=lambda r: r["start"])
            assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own[:-1]]))
            assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in own)
    assert packing.pack(documents(spark, []), queries.tokenizer_path()).count() == 0


def brute_pack(lengths, window, most):
    """A second packer: every open window is looked at, for each piece."""
    open_, done = [], []
    for d, n in enumerate(lengths):
        for start in range(0, n, window):
            size = min(window, n - start)
            if size == window:
                done.append([(d, start, size)])
                continue
            fitting = [w for w in open_ if window - sum(p[2] for p in w) >= size]
            if fitting:
                w = min(fitting, key=lambda w: window - sum(p[2] for p in w))
            else:
                if len(open_) >= most:
                    fullest = max(open_, key=lambda w: sum(p[2] for p in w))
                    open_.remove(fullest)
                    done.append(fullest)
                w = []
                open_.append(w)
            w.append((d, start, size))
            if sum(p[2] for p in w) == window:
                open_ = [x for x in open_ if x is not w]
                done.append(w)
    merged = []
    for w in sorted(open_, key=lambda w: -sum(p[2] for p in w)):
        size = sum(p[2] for p in w)
        fitting = [x for x in merged if window - sum(p[2] for p in x) >= size]
        if fitting:
            min(fitting, key=lambda x: window - sum(p[2] for p in x)).extend(w)
        else:
            merged.append(list(w))
    return sorted(map(tuple, done + merged))


def test_pack_equals_a_second_packer():
    """Piece by piece, with lengths that are all different sums, so that no tie is left open."""
    rnd = random.Random(4)
    lengths = [rnd.randint(1, 260) * 2 + 1 for _ in range(150)]
    packer = packing.Packer(400, 5, 0)
    closed = [p for d, n in enumerate(lengths) for p in packer.add(d, np.arange(n, dtype="<u4"))]
    left = list(packer.leftovers())
    fills = Counter()
    for p in left:
        fills[p[5]] += p[2]
    shift = {name: (target, by) for name, target, by in packing.merge(list(fills.items()), 400)}
    got = defaultdict(list)
    for p in closed:
        got[p[5]].append((p[6], p[:3]))
    for p in left:
        target, by = shift[p[5]]
        got[target].append((p[6] + by, p[:3]))
    fill = lambda windows: sorted(sum(x[2] for x in w) for w in windows)
    ours, theirs = [tuple(x[1] for x in sorted(w)) for w in got.values()], brute_pack(lengths, 400, 5)
    assert fill(ours) == fill(theirs) and sorted(ours) == theirs


# quality


def measures(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    letters = [c for c in t if c.isascii() and c.isalpha()]
    symbols = sum(c in "#*$%&|<>" for c in t)
    dup, chars = len(lines) - len(set(lines)), sum(map(len, words))
    bad = 10 * symbols > 2 * n or 2 * dup > len(lines) or sum(c.isupper() for c in letters) > 0.5 * max(1, len(letters)) or chars < 2 * n or chars > 15 * n
    return n, chars, symbols, dup, len(covered), failed, not failed and not bad


def test_quality(spark):
    rows = rows_of(texts() + ["LOUD WORDS " + " ".join("ABCDEFGHIJ"[k] * 3 + str(k) for k in range(10)), " ".join(f"plain{k} word" for k in range(30))])
    got = quality.judge(documents(spark, rows)).drop("rejected_by").collect()
    assert Counter(tuple(r) for r in got) == Counter((d, *measures(t)) for d, t in rows)
    orders = [quality.judge(documents(spark, rows), tuple(r)).select("doc_id", "kept") for r in itertools.islice(itertools.permutations(quality.RULES), 0, 24, 11)]
    assert all(Counter(map(tuple, o.collect())) == Counter((d, measures(t)[-1]) for d, t in rows) for o in orders)
    assert quality.judge(documents(spark, [])).count() == 0


def test_order_of_rules(spark):
    """Cheap rules that reject much come first; what the result has anyway costs nothing."""
    import time

    def slow(m):
        time.sleep(0.05)
        return m.n_words > 0

    rules = (quality.Rule("slow", slow), quality.Rule("never", lambda m: m.n_words < 0), quality.Rule("quick", lambda m: m.n_words > 0))
    docs = spark.createDataFrame([(k, f"{k} " * 20) for k in range(400)], "doc_id long, text string")
    assert [r.name for r in quality.order_rules(docs, rules)][0] == "quick"
    spy = (quality.Rule("all", lambda m: np.ones(m.n, bool)),)
    assert quality.order_rules(docs, spy, 40) == spy and quality.order_rules(docs.where("false"), rules) == rules


@pytest.mark.parametrize("chunk", [16, 40, 1000])
def test_measures_in_sections(monkeypatch, chunk):
    """A long text's measures, section by section, are those of the whole text."""
    rnd = random.Random(11)
    monkeypatch.setattr(quality.tk, "CHUNK_BYTES", chunk)
    for k in range(40):
        t = "".join(rnd.choice(["ab ", "c ", "Éx", "\n", "\n\n", "#", "same line\n", " ", "\t", "Q", "x" * 30]) for _ in range(rnd.choice([3, 60, 300])))
        data = np.frombuffer(t.encode(), np.uint8)
        offs = np.array([0, len(data)])
        whole, parts = quality.Measures(data, offs), quality.LongMeasures(data, offs)
        for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "upper_share"):
            assert getattr(whole, name).tolist() == getattr(parts, name).tolist(), (name, t)


@pytest.mark.parametrize("chunk", [40, 200])
def test_hashes_in_sections(monkeypatch, chunk):
    """Words, tokens, shingles, signatures and leaks of a long text, section by section, are those of the whole text."""
    rnd = random.Random(12)
    items = decontam.Items([(k, " ".join(rnd.choice("ab cd É ef gh".split()) for _ in range(30))) for k in range(6)], 5)
    names = ["rid", "doc", "text"]
    for k in range(25):
        t = " ".join(rnd.choice(["ab", "cd", "É", "ÀÉ" * 30, "ef gh", "x" * 90, "ab,cd", "\n"]) for _ in range(rnd.choice([0, 3, 40, 200])))
        data, offs = np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])
        rows = lambda: next(iter(jaccard._signatures(5, 3)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([t])], names=names)]))), None)
        results = []
        for size, block in ((1 << 20, 1 << 20), (chunk, 7)):
            monkeypatch.setattr(jaccard.tk, "CHUNK_BYTES", size)
            monkeypatch.setattr(jaccard, "BLOCKED", block)
            got = rows()
            results.append((tk_words(data), jaccard.shingles(data, offs, 5)[1].tolist(), got and got.to_pylist(), sorted(decontam.leaks(data, offs, items, 5, 0.3))))
        assert results[0] == results[1]
        assert jaccard.tk.long_hashes(data, folded=True).tolist() == jaccard.tk.tokens(data, offs)[3].tolist()


def tk_words(data):
    return jaccard.tk.long_hashes(data).tolist()


OTHERS = """
import sys, tracemalloc
import numpy as np, pyarrow as pa
sys.path.insert(0, {root!r})
from ensemblecast.llm import decontam, jaccard, toxicity
rng = np.random.default_rng(1)
size = 64 << 20
text = np.where(rng.random(size) < 0.17, 32, rng.integers(97, 123, size)).astype(np.uint8)
own = text[5000:6000].tobytes().decode()
items = decontam.Items([(1, own), (2, "not in there at all, not one word")], 5)
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text.tobytes().decode()])], names=["rid", "doc", "text"])
text = rng = None
tracemalloc.start()
if {which!r} == "leaks":
    data, offs = decontam.tk.buffer(batch.column(2))
    assert [x[1] for x in decontam.leaks(data, offs, items, 5, 0.6)] == [0]
else:
    assert next(iter(jaccard._signatures(5, 20)(iter([batch])))).num_rows == 1
print(tracemalloc.get_traced_memory()[1] >> 20)
"""


@pytest.mark.parametrize("which", ["leaks", "signatures"])
def test_others_of_a_long_text_in_little_memory(which):
    """64 MB of words: what is held beside the text stays under 500 MB."""
    done = subprocess.run([sys.executable, "-c", OTHERS.format(root=str(Path(__file__).parents[2]), which=which)], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.splitlines()[-1]) < 500


LONG = """
import sys, tracemalloc
import numpy as np
sys.path.insert(0, {root!r})
from ensemblecast.llm import quality
rng = np.random.default_rng(1)
size = 64 << 20
text = np.where(rng.random(size) < 0.17, np.where(rng.random(size) < 0.1, 10, 32), rng.integers(97, 123, size)).astype(np.uint8)
"""


def test_measures_of_a_long_text_in_little_memory():
    """64 MB of words: what is held beside the text stays under 500 MB."""
    code = LONG.format(root=str(Path(__file__).parents[2])) + """
tracemalloc.start()
m = quality.measures_of(text, np.array([0, size]))
quality._returned(m)
for r in quality.RULES:
    r.rejects(m)
print(tracemalloc.get_traced_memory()[1] >> 20)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.splitlines()[-1]) < 500


# language


def brute_language(rows, learn):
    """Naive Bayes over n-grams themselves, without hashing."""
    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower()) + "  "
        padded = t + "   "
        return [padded[k : k + n] for n in (1, 2, 3) for k in range(len(t))]

    counts, texts = defaultdict(Counter), Counter()
    for _, t, lang in filter(learn, rows):
        if t is not None and lang is not None:
            counts[lang].update(grams(t))
            texts[lang] += 1
    total = {x: sum(c.values()) + 0.5 * (1 << 15) for x, c in counts.items()}
    out = {}
    for d, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            out[d] = "und"
            continue
        own = Counter(grams(t))
        out[d] = max(sorted(counts), key=lambda x: np.log(texts[x]) + sum(n * np.log((counts[x][g] + 0.5) / total[x]) for g, n in own.items()))
    return out


def test_language_equals_brute_force(spark):
    """The hashed model against one without hashes, on a whole table; and held-out accuracy."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    want = brute_language(rows, lambda r: not held[r[0]])
    got = {r["doc_id"]: r["lang_pred"] for r in queries.op5_language(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys()
    assert sum(got[d] == x for d, x in want.items()) >= len(want) - 1  # a collision may turn a very short text
    assert np.mean([got[d] == lang for d, _, lang in rows if held[d]]) >= 0.97


def test_typicality(spark):
    """Texts in no learned language are nearest to one, with a high posterior; how far they lie tells."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rnd = random.Random(1)
    odd = [
        "Nie wszystko złoto co się świeci, a każdy kij ma dwa końce i nikt nie wie dlaczego tak jest.",
        "Не всё то золото, что блестит, и не каждый день праздник.", "不是所有闪光的都是金子，也不是每一天都是节日",
        "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(300)),
    ]
    langs, score, far = model.predict(odd)
    assert (score > 0.5).all() and (far < -12).all()
    own = langid.classify(docs, model).select("typicality").toPandas()["typicality"]
    assert own.min() > -12 and abs(own.median()) < 1
    dirty = langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.col("lang"))))
    assert {"de", "en", "es", "fr"} < set(dirty.languages) and len(dirty.languages) == 4 + docs.where("doc_id % 50 = 0").count()
    sampled = langid.fit(docs, sample_rows=300)
    assert sampled.languages == ("de", "en", "es", "fr") and (np.array(sampled.predict(odd[:1])[2]) < -6).all()


def test_stretches_of_long_texts(monkeypatch):
    """n-grams of texts in stretches and lanes are those of the whole texts."""
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["ab", "É ", "İ", " ", "x", "日", "7", "\n"]) for _ in range(rnd.choice([0, 1, 2, 5, 400]))) for _ in range(60)] + [None, "", "no"]

    def seen():
        found, lettered = Counter(), set()
        for bucket, of, has in langid.features(texts, 15):
            found.update(zip(bucket.tolist(), of.tolist()))
            lettered.update(has.tolist())
        return found, lettered

    whole = seen()
    alone = Counter()
    for k, t in enumerate(texts):
        for bucket, of, _ in langid.features([t], 15):
            alone.update((b, k) for b in bucket.tolist())
    assert alone == whole[0] and whole[1] == {k for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    for stretch in (16, 100):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        assert seen() == whole


MEMORY = """
import resource, sys
import numpy as np
sys.path.insert(0, {root!r})
from ensemblecast.llm import langid
rng = np.random.default_rng(1)
langs = tuple(f"l{{k:03}}" for k in range(256))
model = langid.Model(langs, np.full(256, -5.5), rng.normal(-9, 1, (1 << 15, 256)).astype(np.float32), 15, np.tile([0.0, 1.0, 1.0], (256, 1)))
text = np.where(rng.random(16 << 20) < 0.17, 32, rng.integers(97, 123, 16 << 20)).astype(np.uint8).tobytes().decode()
model.predict(["warm up " * 1000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
model.predict([text])
model.predict(["a few words"] * 20_000)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


def test_memory_of_many_languages():
    """256 languages and a text of 16 MB take under 500 MB."""
    done = subprocess.run([sys.executable, "-c", MEMORY.format(root=str(Path(__file__).parents[2]))], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 500


def test_language(spark):
    rnd = random.Random(2)
    stems = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["sch", "ung", "ßt", "ich"], "cc": ["ció", "ñas", "que", "los"]}
    make = lambda lang: " ".join("".join(rnd.choice(stems[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(40))
    rows = [(k, make(lang), lang) for k, lang in enumerate(rnd.choices(list(stems), k=300))]
    odd = [(900, None, "aa"), (901, "12 %% 3", "bb"), (902, "", "aa"), (903, "ñasque " * 20_000, None), (None, make("bb"), None)]
    df = spark.createDataFrame(rows + odd + [rows[0]], "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df.where("doc_id % 4 != 2"))
    got = {r["doc_id"]: r for r in langid.classify(df, model).collect()}
    assert all(got[d]["lang_pred"] == lang and 0.5 < got[d]["score"] <= 1 for d, _, lang in rows)
    assert [got[k]["lang_pred"] for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "cc", "bb"]
    again = {r["doc_id"]: r for r in langid.classify(df.repartition(7).drop("lang"), langid.fit(df.where("doc_id % 4 != 2").repartition(5))).collect()}
    assert {k: (v["lang_pred"], round(v["score"], 9)) for k, v in again.items()} == {k: (v["lang_pred"], round(v["score"], 9)) for k, v in got.items()}
    nothing = langid.fit(df.where("false"))
    assert {r["lang_pred"] for r in langid.classify(df, nothing).collect()} == {"und"}
    assert langid.classify(df.where("false"), model).count() == 0


# decontamination


def brute_tiles(doc, item, least):
    """Greedy string tiling as first described: again and again the longest match of unmarked tokens."""
    d_used, i_used, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                k = 0
                while d + k < len(doc) and i + k < len(item) and doc[d + k] == item[i + k] and not d_used[d + k] and not i_used[i + k]:
                    k += 1
                if k > best[0]:
                    best = (k, d, i)
        if best[0] < least:
            return covered
        k, d, i = best
        d_used[d : d + k] = i_used[i : i + k] = [True] * k
        covered += k


def test_leaks(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 5)))
    text = lambda n: [word() for _ in range(n)]
    items = [text(rnd.randint(12, 30)) for _ in range(12)] + [text(3)]
    docs = [text(60) for _ in range(20)]
    for k, item in enumerate(items):
        half = len(item) // 2
        docs.append(text(10) + item + text(10))
        docs.append(text(10) + item[half:] + text(5) + [w.upper() + "," for w in item[:half]])
        docs.append(text(10) + item[: len(item) // 3] + text(10))
        docs.append(item[:6] * 30 + item)
    rows = [(k, " ".join(d)) for k, d in enumerate(docs)] + [(900, None), (901, ""), (None, " ".join(items[0]))]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(77, None), (78, "")], "item_id long, text string")
    fold = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = {}
    for d, t in rows:
        shares = {k: brute_tiles(fold(t), i, 5) / len(i) for k, i in enumerate(items)}
        hit = sorted(k for k, s in shares.items() if s >= 0.6)
        want[d] = (bool(hit), round(max([shares[k] for k in hit], default=0), 9), hit)
    df = documents(spark, rows)
    for most in (8 << 20, 0):  # broadcast, and joined by seeds
        got = decontam.find_leaks(df, bench, broadcast_bytes=most).collect()
        assert {r["doc_id"]: (r["contaminated"], round(r["coverage"], 9), r["items"]) for r in got} == want and len(got) == len(rows)
    assert sum(w[0] for w in want.values()) > 30
    assert not any(r["contaminated"] for r in decontam.find_leaks(df, bench.where("false")).collect())
    assert decontam.find_leaks(df.where("false"), bench).count() == 0


def test_tiles():
    """Against the first description, with repetitive texts."""
    rnd = random.Random(2)
    for _ in range(300):
        doc, item = (np.array([rnd.randrange(rnd.choice([1, 2, 6])) for _ in range(rnd.randint(0, n))], np.uint64) for n in (40, 25))
        found = decontam.tiles(doc, item, 3)
        assert sum(t[2] for t in found) == brute_tiles(doc.tolist(), item.tolist(), 3)
        assert all((doc[d : d + k] == item[i : i + k]).all() for d, i, k in found)


def test_one_word_texts():
    """Memory grows with the text, not with the pairs of its seeds: a megabyte of one word against 500 words."""
    import tracemalloc

    items = decontam.Items([(1, "spam " * 500), (2, "spam eggs " * 40)], 5)
    column = np.frombuffer(b"spam " * 200_000, np.uint8)
    tracemalloc.start()
    found = list(decontam.leaks(column, np.array([0, len(column)]), items, 5, 0.6))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 0, 1.0)] and peak < 200 << 20


# toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton():
    rnd = random.Random(8)
    terms = ["".join(rnd.choice("abc") for _ in range(rnd.randint(5, 7))) for _ in range(12)]
    for distance in (1, 2):
        trie = toxicity.Trie(terms, distance)
        for _ in range(400):
            w = "".join(rnd.choice("abc") for _ in range(rnd.randint(3, 9)))
            found = trie.near(w)
            assert (found is not None) == any(edits(w, t) <= distance for t in terms)
            assert found is None or edits(w, found) <= distance


def test_toxicity(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "tu", "re", "so"]) for _ in range(rnd.randint(1, 4)))
    bad = ["grimble", "sprocket", "wozzle"]
    rows, labels = [], []
    for k in range(600):
        w = [word() for _ in range(rnd.randint(15, 60))]
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    extra = [(900, None), (901, ""), (902, "kalo grimbel wozzzle sprockt mitu"), (903, 'he said "grimble" and "wozzle" loudly'), (904, "tu re " * 30_000), (None, "grimble wozzle sprocket")]
    df = documents(spark, rows + extra + [rows[0]])
    known = spark.createDataFrame(labels + [(5, None), (None, 1), labels[7]], "doc_id long, toxic int")
    model = toxicity.fit(df.where("doc_id % 5 != 0"), known.where("doc_id % 5 != 0"))
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert set(bad) <= model.words
    assert np.mean([got[k]["predicted"] == y for k, y in labels]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[902]["predicted"] == 1 and got[None]["predicted"] == 1
    assert got[903]["score"] < 0.5 and got[900]["predicted"] == got[901]["predicted"] == got[904]["predicted"] == 0
    none = toxicity.fit(df.where("false"), known)
    assert {r["predicted"] for r in toxicity.score(df, none).collect()} == {0}
    assert toxicity.score(df.where("false"), model).count() == 0


def test_features_equal_brute_force():
    """Counts of lexicon words, stems, misspellings and quoted hits against edit distances to every term."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 8))) for _ in range(30)]
    model = toxicity.Model(frozenset(words[:12]), frozenset({"abca", "ddcba"}), np.zeros(9), frozenset(words[12:15]))
    terms = [w for w in model.words if len(w) >= toxicity.FUZZY_LENGTH and not any(w[:k] in model.stems for k in toxicity.STEMS)]
    scanner = toxicity.Scanner(model)
    for _ in range(200):
        parts = [rnd.choice(words + ["".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 9))) for _ in range(20)]) for _ in range(rnd.randint(0, 25))]
        text = " ".join(f'"{p}"' if rnd.random() < 0.1 else p for p in parts)
        want = np.zeros(4)
        for m in re.finditer(r"\w+", text):
            w = m[0]
            if w in model.words:
                kind = 0
            elif any(len(w) > k and w[:k] in model.stems for k in toxicity.STEMS):
                kind = 1
            elif len(w) >= toxicity.FUZZY_LENGTH - 1 and w not in model.known and any(edits(w, t) <= 1 for t in terms):
                kind = 2
            else:
                continue
            quoted = '"' in text[max(0, m.start() - toxicity.CONTEXT) : m.start()] and '"' in text[m.end() : m.end() + toxicity.CONTEXT]
            want[3 if quoted else kind] += 1
        got = scanner.features(text)
        assert (np.zeros(4) if got is None else got).tolist() == want.tolist()


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
