"""Fill-in-the-middle, licence scan and Merkle manifest against brute force."""

import hashlib
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblecast.llm import fim, licences, merkle, queries

CLASHES = "doc_id long, text string, lang string, source string, n_chars long, form string, notices int, tree string, root string"


def documents(spark, rows, langs=("en", "de", None, "日")):
    full = [(d, t, langs[k % len(langs)] if k % 3 else langs[0], None if k % 7 == 0 else f"s{k % 4}", None if k % 5 == 0 else k, "x", 3, "y", "z") for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, CLASHES).repartition(5)


def texts(n=150, seed=2):
    rnd = random.Random(seed)
    pieces = ["a", "Bé", " ", "\n", "<P>", "<S", "M>", "日本", "😀", "\t", "mit license", "GNU General  Public\nLicense", "<", "SPDX-License-Identifier: MIT OR Apache-2.0\n", "cc by", "cc-by-sa"]
    out = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14))) for _ in range(n)]
    return [*out, "", None, "x", "<P>", "long " + "wört " * 30_000, out[3], out[3]]


def rows_of(out):
    rows = [(k * 7 - 20, t) for k, t in enumerate(out)]
    return [*rows, rows[5], rows[5], (rows[6][0], "another text"), (None, "no id"), (None, None), (None, "no id")]


# fill in the middle


def split_units(text: str, unit: str) -> list[str]:
    if unit == "char":
        return list(text)
    starts = [0] + [k for k in range(1, len(text)) if (text[k - 1] == "\n" if unit == "line" else text[k - 1] in " \t\n\v\f\r" and text[k] not in " \t\n\v\f\r")]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])] if text else []


def brute_middle(doc_id, text, unit="char", seed=1, plain_share=10, spm_share=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = split_units(text, unit)
    n = len(units)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_share:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_share:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("section", [3, 64, fim.SECTION])
def test_middle_equals_brute_force(spark, monkeypatch, unit, section):
    rows = rows_of(texts())
    if section == fim.SECTION:
        got = fim.transform(documents(spark, rows), unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form")))
        want = Counter((d, *brute_middle(d, t, unit), t or "") for d, t in rows)
        assert Counter((r["doc_id"], r["n"], r["form"], r[f"prefix_{unit}s"], r[f"middle_{unit}s"], r["output"], r["back"]) for r in got.collect()) == want
        assert {"plain", "psm", "spm"} == {k[2] for k in want}
        return
    monkeypatch.setattr(fim, "SECTION", section)
    raw = [(t or "").encode() for _, t in rows if len(t or "") < 1000]
    offs = np.append(0, np.cumsum([len(t) for t in raw]))
    draws = np.array([[int(hashlib.sha256(f"1:{k}".encode()).hexdigest()[8 * j : 8 * j + 8], 16) for j in range(4)] for k in range(len(raw))])
    n, form, prefix, middle, body, ends = fim.arrange(np.frombuffer(b"".join(raw), np.uint8), offs, draws, 10, 20, unit)
    for k, t in enumerate(raw):
        want = brute_middle(k, t.decode(), unit)
        got = n[k], str(fim.FORMS[form[k]]), *((prefix[k], middle[k]) if form[k] else (None, None)), body[ends[k] : ends[k + 1]].decode()
        assert got == want


def test_middle_of_nothing(spark):
    assert fim.transform(documents(spark, [])).count() == 0


# licences


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_places(words, phrase):
    own = phrase.split()
    return [k for k in range(len(words) - len(own) + 1) if words[k : k + len(own)] == own]


class Descent:
    """A second parser: recursive descent over the same grammar."""

    def __init__(self, tokens):
        self.tokens, self.at = tokens, 0

    def next(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def binary(self, level):
        if level == 3:
            return self.atom()
        labels, burden = self.binary(level + 1)
        word = ("or", "and", "with")[level]
        while self.next() == word:
            self.at += 1
            more, b = self.binary(level + 1)
            if word == "with":
                burden *= licences.EXCEPTION
            else:
                labels, burden = labels | more, (min if word == "or" else max)(burden, b)
        return labels, burden

    def atom(self):
        t = self.next()
        self.at += 1
        if t == "(":
            out = self.binary(0)
            if self.next() != ")":
                raise ValueError
            self.at += 1
            return out
        if t is None or t in ("or", "and", "with", ")"):
            raise ValueError
        return {licences.family(t)}, licences.BURDEN.get(licences.family(t), licences.UNKNOWN)


def test_expressions():
    rnd = random.Random(5)
    names = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0+", "BSD-3-Clause", "CC-BY-SA-4.0", "LicenseRef-own", "0BSD", "LGPL-2.1-or-later"]

    def made(depth):
        if depth == 0 or rnd.random() < 0.3:
            return [rnd.choice(names)]
        inner = [*made(depth - 1), rnd.choice(["AND", "OR", "WITH", "and", "or"]), *made(depth - 1)]
        return ["(", *inner, ")"] if rnd.random() < 0.5 else inner

    for _ in range(400):
        tokens = licences.expression_tokens(" ".join(made(4)))
        parser = Descent(tokens)
        assert (v := licences.evaluate(tokens)).whole and (set(v.labels), v.burden) == parser.binary(0) and parser.at == len(tokens)
    broken = 0
    for _ in range(400):
        tokens = [rnd.choice(["(", ")", "and", "or", "with", "mit", "isc"]) for _ in range(rnd.randint(1, 7))]
        parser = Descent(tokens)
        try:
            parser.binary(0)
            whole = parser.at == len(tokens)
        except ValueError:
            whole = False
        broken += not whole
        assert licences.evaluate(tokens).whole == whole
    assert 100 < broken < 400


@pytest.mark.parametrize("line,tokens,labels,burden", [
    ("MIT", ["mit"], {"mit"}, 0.2),
    ("(MIT OR GPL-3.0-only) */", ["(", "mit", "or", "gpl-3.0-only", ")"], {"mit", "gpl"}, 0.2),
    ("MIT AND GPL-2.0-only WITH Classpath-exception-2.0", None, {"mit", "gpl"}, 0.8 * 0.75),
    ("MIT OR Apache-2.0 AND AGPL-3.0", None, {"mit", "apache", "agpl"}, 0.2),
    ("MIT AND", ["mit", "and"], {"mit"}, 0.2),
    ("MIT license for all", ["mit"], {"mit"}, 0.2),
    ("CC-BY-NC-4.0", None, {"cc-by-nc"}, 1.0),
    (")", [], None, None),
])
def test_expression_lines(line, tokens, labels, burden):
    found = licences.expression_tokens(line)
    assert tokens is None or found == tokens
    if labels:
        v = licences.evaluate(found)
        assert v.labels == labels and v.burden == pytest.approx(burden)


@pytest.mark.parametrize("section", [7, 200, licences.SECTION])
def test_scan_equals_brute_force(spark, monkeypatch, section):
    rows = rows_of(texts())
    rows += [(900, "the mit license, the MIT  License; mit license mit-license cc by nc sa"), (901, "mit"), (902, "license"), (903, "all rights reserved" + "x" * 900 + " mit license")]
    rows += [(904, "# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note\n"), (905, "no spdx license identifier here"), (906, "SPDX-License-Identifier: MIT AND\nApache license")]
    want = Counter()
    for d, t in rows:
        words = brute_words(t)
        base = sorted((k, label) for phrase, label in licences.BASE.items() for k in brute_places(words, phrase))
        more = {label for phrase, label in licences.NOTICES.items() if brute_places(words, phrase)}
        score = max([licences.BURDEN[x] for x in {label for _, label in base} | more], default=0.0)
        for m in re.finditer(r"(?<![0-9A-Za-z\x80-\U0010ffff])(?i:spdx-license-identifier)\s*:(.*)", t or ""):
            v = Descent(tokens := licences.expression_tokens(m[1]))
            try:
                labels, burden = v.binary(0)
            except ValueError:
                labels = {licences.family(x) for x in tokens if x not in ("and", "or", "with")}
                burden = max(licences.BURDEN[x] for x in labels)
            more |= labels
            score = max(score, burden)
        own = {label for _, label in base}
        want[d, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | more)), score] += 1
    if section == licences.SECTION:
        got = licences.digest(licences.scan(documents(spark, rows)))
        assert Counter(tuple(r) for r in got.collect()) == want
        return
    monkeypatch.setattr(licences, "SECTION", section)
    raw = [(t or "").encode() for _, t in rows if len(t or "") < 2000]
    offs = np.append(0, np.cumsum([len(t) for t in raw]))
    n_words, found = licences.places(np.frombuffer(b"".join(raw), np.uint8), offs)
    first = np.append(0, np.cumsum(n_words))
    for k, t in enumerate(raw):
        words = brute_words(t.decode())
        assert n_words[k] == len(words)
        got = sorted((phrase, w - first[k]) for phrase, w, _ in found if first[k] <= w < first[k + 1])
        assert got == sorted((p, w) for p in (*licences.BASE, *licences.NOTICES, *licences.TAGS) for w in brute_places(words, p))


def test_scan_of_nothing(spark):
    assert licences.scan(documents(spark, [])).count() == 0


# Merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, lower=False):
    out = []
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[c]
        if v is not None:
            v = str(v)
            if c == "text" and lower:
                v = re.sub("[A-Z]", lambda m: m[0].lower(), v)
        out.append("-" if v is None else f"{len(v.encode())}:{v}")
    return H(*out)


def brute_tree(nodes):
    """(root, path of each node): the path's entries are (children before, children after)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            p = where[k]
            run = p // 8 * 8
            paths[k].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 8])))
            where[k] = p // 8
        nodes = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return (nodes or [None])[0], paths


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((brute_leaf(r), r))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        by[lang].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
        trees[lang] = brute_tree([leaf for leaf, _ in by[lang]])
    root, upper = brute_tree([trees[x][0] for x in order])
    out = Counter()
    for lang, above in zip(order, upper):
        subroot, paths = trees[lang]
        for (leaf, r), path in zip(by[lang], paths):
            digits = "" if r["doc_id"] is None else str(r["doc_id"])
            node = brute_leaf(r, True) if zlib.crc32(digits.encode()) % 3 == 0 else leaf
            for before, after in path + above:
                node = H(before, node, after)
            out[r["doc_id"], leaf, subroot, root, H(*(b + a for b, a in path + above)), node, node == root] += 1
    return out


@pytest.mark.parametrize("block,step", [(1, 1), (2, 1), (3, 2)])
def test_manifest_equals_brute_force(spark, tmp_path, block, step):
    docs = documents(spark, rows_of(texts()))
    want = brute_manifest([r.asDict() for r in docs.collect()])
    got = merkle.manifest(docs, block=block, step=step).collect()
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], H(*(p["siblings"] for p in r["proof"]))) for r in got) == Counter(k[:5] for k in want.elements())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert Counter(tuple(r) for r in queries.op13_merkle(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("rows,langs", [([], ("en",)), ([(5, "A")], (None,)), ([(5, "A"), (5, "A"), (4, None)], ("en", None)), ([(k, str(k)) for k in range(9)], ("en",)), ([(k, "T") for k in range(30)], tuple(f"l{k}" for k in range(20)))])
def test_small_manifests(spark, tmp_path, rows, langs):
    docs = documents(spark, rows, langs)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_merkle(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == brute_manifest([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 300, 512])
@pytest.mark.parametrize("step", [1, 2, 3])
def test_traversal(n, step):
    leaves = [H(str(k)) for k in range(n)]
    root, paths = brute_tree(leaves)
    levels = merkle._levels(n, 3)
    got = list(merkle.traverse(leaves, levels, step))
    assert merkle.reduce(leaves, levels) == root
    assert [[(len(b) // 64, b + a) for b, a in p] for p in paths] == got


# memory of long texts

SCRIPT = """
import resource, sys, numpy as np
sys.path.insert(0, {root!r})
from ensemblecast.llm import fim, licences
text = (b"some w\\xc3\\xb6rds of the mit license, " * 2_100_000)[: 64 << 20]
data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{call}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


@pytest.mark.parametrize("call", ["fim.arrange(data, offs, np.array([[10**9, 3 * 10**9, 1, 50]]), 10, 20, 'char')", "n, found = licences.places(data, offs)"])
def test_memory_of_a_long_text(call):
    """64 MB of text take under 500 MB."""
    root = str(__import__("pathlib").Path(__file__).parents[2])
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, call=call)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 500
