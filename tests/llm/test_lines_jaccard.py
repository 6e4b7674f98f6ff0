import random
import re

import duckdb
import pandas as pd

from ensemblecast.llm import jaccard, line_dedup


def texts(seed):
    rnd = random.Random(seed)
    lines = ["".join(rnd.choice("abc ") for _ in range(6)) for _ in range(30)] + ["", " ", "x"]
    out = []
    for _ in range(60):
        out.append("\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 12))))
        if len(out) > 3 and rnd.random() < 0.5:
            a = rnd.choice(out).split("\n")
            out.append("\n".join([rnd.choice(lines), *a[rnd.randint(0, 3) :], rnd.choice(lines)]))
    return out + [out[5], out[6], "", None, "\n\n"]


def test_lines_match_sql(spark):
    rows = list(enumerate(texts(4)))
    random.Random(1).shuffle(rows)
    rows += [rows[3], (None, rows[7][1]), (None, "q\nw\ne"), (None, "q\nw\ne\nr")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, lines string, pos int").repartition(3)
    got = sorted(map(tuple, line_dedup.remove_repeats(df).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()), key=str)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert got == sorted(con.sql(line_dedup.SQL).fetchall(), key=str)
    assert sum(r[2] for r in got) > 50


def test_short_passages_match_sql(spark):
    """Passages with enough words go though they stand on one or two lines; the old rule saw runs of three only."""
    rnd = random.Random(9)
    words = lambda n: " ".join(rnd.choice("abcdef") * rnd.randint(1, 5) for _ in range(n))
    pool = [words(rnd.randint(1, 9)) for _ in range(25)] + ["", " \t", "x"]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 6)))) for k in range(80)]
    one, two = words(60), words(30) + "\n\n" + words(30)
    rows += [(200, f"a\n{one}\nb"), (201, f"c\n{one}"), (202, f"d\n{two}"), (203, f"{two}\ne"), (204, one), (None, one), (205, f"f\n{one}\n{one}"), (206, None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    for least in (50, 8):
        made = line_dedup.remove_repeats(df, words=least)
        got = sorted(map(tuple, made.select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()), key=str)
        assert got == sorted(con.sql(line_dedup.passage_sql(least)).fetchall(), key=str)
        if least == 50:
            kept = {r["doc_id"]: (r["kept_text"], r["emptied"]) for r in made.collect() if r["doc_id"] is None or r["doc_id"] >= 200}
    assert kept[200][0] == f"a\n{one}\nb" and kept[201][0] == "c" and kept[202][0] == f"d\n{two}"
    assert kept[203][0] == "\ne" and kept[205][0] == "f" and kept[204][1] and kept[None][1]


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n = len(rows)
    near = [[i != j and bool(a) and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    group = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([group[i]] + [group[j] for j in range(n) if near[i][j]])
            if low != group[i]:
                group[i], changed = low, True
    least = {}
    for i, (d, _) in enumerate(rows):
        least[group[i]] = min(least.get(group[i], jaccard._LAST), jaccard._LAST if d is None else d)
    return sorted(((d, None if least[group[i]] == jaccard._LAST else least[group[i]], sum(near[i])) for i, (d, _) in enumerate(rows)), key=str)


def test_jaccard(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    out = [" ".join(word() for _ in range(rnd.randint(0, 120))) for _ in range(25)] + ["one two", "one  two", "", None, " "]
    for _ in range(70):
        w = rnd.choice(out[2:8]).split()
        for _ in range(rnd.randint(0, 3)):
            if w:
                w[rnd.randrange(len(w))] = word()
        out.append("  ".join(w))
    rows = list(zip(rnd.sample(range(500), len(out)), out))
    rows += [rows[2], (None, rows[4][1]), (None, "lonely words are here now")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, links int").repartition(3)
    for block in (512, 7):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = jaccard.near_duplicates(df).select("doc_id", "class_id", "n_links").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_depths():
    """Prefixes are shortened only as far as the links found demand, and never have to go below the bound for all pairs."""
    assert jaccard.floor_depth(0.8, 20, 0.9999) == 4
    assert jaccard.missed(0.8, 20, 4) < 1e-4 < jaccard.missed(0.8, 20, 5)
    assert jaccard.next_depth({}, 0.8, 20, 0.9999, 6) == 4  # nothing is known, so a pair at the threshold counts
    assert jaccard.next_depth({990: 100_000}, 0.8, 20, 0.9999, 6) == 6  # copies meet at any depth
    assert jaccard.next_depth({805: 5000, 990: 5000}, 0.8, 20, 0.9999, 6) == 4
    assert jaccard.next_depth({815: 50_000, 990: 50_000}, 0.8, 20, 0.9999, 6) == 5


def test_recall(spark):
    """Pairs of graded similarity, thousands of them: links found against brute force, at the depth that was chosen."""
    rnd = random.Random(3)
    rows = []
    for k in range(500):
        w = [f"w{rnd.randrange(10**9)}" for _ in range(120)]
        rows.append((2 * k, " ".join(w)))
        for at in rnd.sample(range(120), rnd.randint(1, 5)):
            w[at] = "other"
        rows.append((2 * k + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.near_duplicates(df).collect()}
    shingled = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = [5 * len(a & b) >= 4 * len(a | b) for a, b in zip(shingled[::2], shingled[1::2])]
    assert 100 < sum(want) < 450
    assert [got[2 * k] for k in range(500)] == want and [got[2 * k + 1] for k in range(500)] == want


def test_long_texts(spark):
    """Texts of megabytes: one of many lines, one of one line, and copies of both with a word changed."""
    rnd = random.Random(4)
    lines = [" ".join(f"{rnd.randrange(10**6)}" for _ in range(12)) for _ in range(30_000)]
    flat = " ".join(f"{rnd.randrange(10**6)}" for _ in range(300_000))
    rows = [(1, "\n".join(lines)), (2, "\n".join(["odd", *lines[1:]])), (3, flat), (4, flat + " more"), (5, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 0)}
    left = {r["doc_id"]: (r["n_removed"], r["kept_text"][:20]) for r in line_dedup.remove_repeats(df, words=50).collect()}
    assert left[1][0] == left[3][0] == left[4][0] == left[5][0] == 0 and left[2] == (29_999, "odd")


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(none).count() == 0
    assert line_dedup.remove_repeats(none).count() == 0
