"""The pipeline against a brute-force version of each stage."""

import math
import random
import re
import zlib

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from ensemblecast.llm import langid, packing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_language(rows, model):
    langs, odds, far = model.predict([r[1] for r in rows])
    own = sorted(t for r, lang, t in zip(rows, langs, far) if lang == r[2] and zlib.crc32(str(r[0]).encode()) % 4 == 2)
    a, b = (own[max(0, math.ceil(share * len(own)) - 1)] for share in pipeline.TAIL)
    least = a + (b - a) * math.log(pipeline.FALSE_ALARMS / pipeline.TAIL[0]) / math.log(pipeline.TAIL[1] / pipeline.TAIL[0])
    claimed = lambda r, lang, p, t: r[2] in model.languages and r[2] != lang and p >= pipeline.CONTRADICTED and t >= b
    return [r for r, lang, p, t in zip(rows, langs, odds, far) if lang != "und" and t >= least and not claimed(r, lang, p, t)]


def brute_lines(rows, run=3):
    first, out = {}, []
    full = [[k for k, x in enumerate(r[1].split("\n")) if WORD.search(x)] for r in rows]
    for r, own in zip(rows, full):
        lines = r[1].split("\n")
        for p in range(len(own) - run + 1):
            key = tuple(lines[k] for k in own[p : p + run])
            first[key] = min(first.get(key, (r[0], p)), (r[0], p))
    for r, own in zip(rows, full):
        lines, gone = r[1].split("\n"), set()
        for p in range(len(own) - run + 1):
            if first[tuple(lines[k] for k in own[p : p + run])] < (r[0], p):
                gone.update(own[p : p + run])
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if set(own) - gone:
            out.append((r[0], text, *r[2:4], len(text) if gone else r[4]))
    return out


def brute_near(rows):
    def shingles(t):
        w = WORD.findall(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        least[g] = min(least.get(g, r), r)
    return list(least.values())


def brute_leaks(rows, items, k=5, threshold=0.6):
    fold = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = []
    for r in rows:
        w = fold(r[1])
        hit = False
        for item in map(fold, items):
            grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
            covered = {i + j for i in range(len(item) - k + 1) if tuple(item[i : i + k]) in grams for j in range(k)}
            hit |= len(covered) >= threshold * len(item)  # no item here has a seed that tiling would leave out
        if not hit:
            out.append(r)
    return out


def test_stages(spark, tmp_path):
    rnd = random.Random(12)
    stems = {"aa": ["ba", "lo", "mi", "tu", "ri", "so"], "bb": ["sch", "ung", "ter", "ich", "ver", "kei"]}

    def prose(lang, lines):
        return "\n".join(" ".join("".join(rnd.choice(stems[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(4, 14))) for _ in range(lines))

    items = [prose("aa", 2) for _ in range(4)]
    rows = []
    for k in range(140):
        lang = rnd.choice(["aa", "bb"])
        t = prose(lang, rnd.randint(1, 12))
        if k % 7 == 3:
            t = rows[rnd.randrange(len(rows))][1]
        elif k % 7 == 5:
            w = rows[rnd.randrange(len(rows))][1].split(" ")
            w[rnd.randrange(len(w))] = "mitu"
            t = " ".join(w)
        elif k % 20 == 9:
            t = f"{prose(lang, 2)}\n{rnd.choice(items)}\n{prose(lang, 2)}"
        elif k % 30 == 11:
            t = "12 34 %%"
        elif k % 30 == 12:
            t, lang = " ".join(rnd.choice(["quxz", "zwyk", "pfnq"]) for _ in range(40)), None
        rows.append((k, t, lang, "src", len(t)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + [(990, None, None, None, None), (991, "", "aa", "s", 0)], schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clash = ["row", "rid", "body", "score", "lang_pred", "class_id", "emptied", "kept_text", "contaminated", "a b.c"]
    wide = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(clash)))
    model = langid.fit(docs.where(queries.id_hash(4) != 2))
    steps = [lambda r: brute_language(r, model), brute_lines, brute_near, lambda r: brute_leaks(r, items)]
    want = rows
    for (name, stage), brute in zip(pipeline.STAGES, steps):
        docs, before, want = pipeline.cut(stage(spark, docs, str(tmp_path))), len(want), brute(want)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert sorted(map(tuple, docs.collect())) == sorted(want), name
        assert len(want) < before
        if name == "language":
            assert not any("quxz" in w[1] or "12 34" in w[1] for w in want)
        wide = pipeline.cut(stage(spark, wide, str(tmp_path)))
        assert wide.columns == [*docs.columns, *clash]
        assert sorted(map(tuple, wide.collect())) == sorted((*w, *range(len(clash))) for w in want), name
    got = pipeline.run(spark, str(tmp_path)).collect()
    encode = packing.encoder(queries.tokenizer_path())
    sizes = {}
    for r in got:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
        if r["length"] == r["doc_tokens"]:
            ids = [*encode(next(w[1] for w in want if w[0] == r["doc_id"])), 0]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert sizes == {w[0]: len(encode(w[1])) + 1 for w in want}


def test_foreign_texts_go(spark):
    """Unlearned languages, junk and false claims, planted in a whole table, go; the table's own texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rnd = random.Random(7)
    odd = [
        "Nie wszystko złoto co się świeci, a każdy kij ma dwa końce i nikt nie wie dlaczego tak jest.",
        "Не всё то золото, что блестит, и не каждый день праздник на нашей улице.",
        *("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(300)) for _ in range(5)), "1234 %% 5678", "",
    ]
    planted = spark.createDataFrame([(10**6 + k, t, "en", "planted", len(t)) for k, t in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long")
    claims = docs.where("lang = 'en' and length(text) > 400").orderBy("doc_id").limit(20).select((F.col("doc_id") + 10**7).alias("doc_id"), "text", F.lit("fr").alias("lang"), F.lit("claim").alias("source"), "n_chars")
    mixed = docs.where("lang = 'en' and length(text) > 400").orderBy(F.desc("doc_id")).limit(10).select((F.col("doc_id") + 10**8).alias("doc_id"), "text").crossJoin(docs.where("lang = 'fr' and length(text) > 400").orderBy("doc_id").limit(1).select(F.substring("text", 1, 400).alias("other")))
    mixed = mixed.select("doc_id", F.concat(F.substring("text", 1, 400), F.lit(" "), "other").alias("text"), F.lit("en").alias("lang"), F.lit("mixed").alias("source"), F.lit(801).alias("n_chars"))
    whole = docs.unionByName(planted.unionByName(claims).unionByName(mixed).select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])).cache()
    kept = pipeline.language(spark, whole, "").cache()
    assert kept.columns == docs.columns and kept.where("source = 'planted'").count() == 0 and kept.where("source like 'src%'").count() >= 0.995 * docs.count()
    assert kept.where("source = 'claim'").count() <= 5 and kept.where("source = 'mixed'").count() >= 9
    reasons = {r[0]: r[1] for r in pipeline.language_verdicts(whole).groupBy("reason").count().collect()}
    assert reasons["no_letter"] == 2 and reasons["contradicted"] >= 15 and reasons["foreign"] >= 7


def test_repeated_ids_and_rows(spark, tmp_path):
    """Texts that share a doc_id are rows of their own in every stage."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(5, text("a")), (5, text("b")), (5, text("c") + "\n" + text("a")), (6, text("d")), (6, text("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # an id is one place in the order of documents, so only what stands further down in it goes
    assert sorted(map(tuple, pipeline.lines(spark, docs, "").collect())) == sorted([*rows[:2], (5, text("c")), *rows[3:]])
    assert sorted(map(tuple, pipeline.near_copies(spark, docs, "").collect())) == sorted(rows[:4])
    spark.createDataFrame([(1, text("b"))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(map(tuple, pipeline.benchmark_leaks(spark, docs, str(tmp_path)).collect())) == sorted([rows[0], *rows[2:]])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_short_passages_go(spark):
    """The lines stage takes out 50 words that stand earlier, on one line or two."""
    long = " ".join(f"w{k}" for k in range(60))
    halves = "\n".join(" ".join(f"{c}{k}" for k in range(30)) for c in "xy")
    rows = [(1, f"{long}\nfirst"), (2, f"second\n{long}"), (3, f"{halves}\nthird"), (4, f"fourth\n\n{halves}"), (5, long), (6, "x0 x1\nfirst")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.lines(spark, docs, "").collect()}
    want = {1: rows[0][1], 2: "second", 3: rows[2][1], 4: "fourth\n", 6: rows[5][1]}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_groups_without_ids(spark):
    """Different texts with one doc_id both stay; near copies without ids are one group."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " x"), (None, text("c")), (None, text("c") + " y"), (None, text("d")), (3, text("d") + " z"), (4, "..."), (5, None)]
    got = {tuple(r) for r in pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert {rows[0], rows[1], rows[6], rows[7]} <= got and not {rows[2], rows[5]} & got
    assert len({rows[3], rows[4]} & got) == 1
