"""Licence scan: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased. One automaton of all phrases and
tags runs over the words, a blank between each two, and reports every place where the words of one stand consecutively,
places inside others included. Phrases give a label each. A tag is followed, up to the end of its line, by an expression such as
``(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0``, whose identifiers give labels by their family.

Each label has a burden, from 0 (no conditions) to 1 (share alike with all that is built on it). A tag's expression is
evaluated: ``OR`` lets the user choose, so the least burden counts; ``AND`` binds to both, so the greatest does; ``WITH``
an exception takes a quarter off. ``WITH`` binds before ``AND``, ``AND`` before ``OR``; a further ``+`` is part of the identifier.
An expression that breaks off or doesn't parse asks for all of its identifiers. A document's ``score`` is the greatest burden
of its notices and tags, 0 where there are none. A phrase inside a longer one (``cc by`` in ``cc by nc``) keeps
its label, and the longer one adds its own.

A null text is empty: no words, no labels (empty text), score 0. Equal rows have equal results; an empty table gives an empty
result; a text may have any length and is scanned a section at a time; other columns are ignored, whatever their names; of
equal labels (ties) one stands in the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensemblecast.llm import textkit as tk
from ensemblecast.session import ship

# The notice phrases every scan looks for, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: More notices.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
}
#: Words after which an expression follows.
TAGS = ("spdx license identifier", "license expression")
#: Burdens; what isn't listed has UNKNOWN.
BURDEN = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "0bsd": 0.0,
    "mit": 0.2, "bsd": 0.2, "isc": 0.2, "bsl": 0.2, "zlib": 0.2, "apache": 0.25, "cc-by": 0.3,
    "mpl": 0.5, "epl": 0.5, "cddl": 0.5, "lgpl": 0.6,
    "cc-by-sa": 0.8, "gpl": 0.8, "agpl": 1.0, "cc-by-nd": 1.0, "cc-by-nc": 1.0, "cc-by-nc-sa": 1.0, "cc-by-nc-nd": 1.0, "proprietary": 1.0,
}
UNKNOWN, EXCEPTION = 0.5, 0.75
#: Characters of a line that are looked at after a tag; an expression that goes on is broken off there.
LONGEST = 2000
#: Bytes of words that the automaton sees at once.
SECTION = 1 << 20

_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+|\S")
_NAME = re.compile(r"[a-z0-9][a-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def family(identifier: str) -> str:
    """The label of an identifier: its name without version numbers and the like, such as ``gpl`` of ``gpl-2.0-only``."""
    parts = identifier.rstrip("+").split("-")
    kept = [p for k, p in enumerate(parts) if not k or p.isalpha() and p not in ("only", "or", "later", "clause")]
    for n in range(len(kept), 0, -1):
        if "-".join(kept[:n]) in BURDEN:
            return "-".join(kept[:n])
    return kept[0]


@dataclass(frozen=True)
class Verdict:
    labels: frozenset[str]
    burden: float
    whole: bool  # whether it parsed


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard: identifiers and operators in the order of evaluation; None if the expression isn't one."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # whether an identifier or a bracket may come next
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            waiting.append(t)
        elif t == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif t in _BINDS:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[t]:
                out.append(waiting.pop())
            waiting.append(t)
            operand = True
        elif operand and _NAME.fullmatch(t):
            out.append(t)
            operand = False
        else:
            return None
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def expression_tokens(line: str) -> list[str]:
    """The tokens of the expression at the start of a line; what can't follow (a comment's end, say) ends it."""
    out: list[str] = []
    depth, operand = 0, True
    for t in _TOKEN.findall(line.lower()):
        if t == "(" and operand:
            depth += 1
        elif t == ")" and depth and not operand:
            depth -= 1
        elif t in _BINDS and not operand:
            operand = True
        elif t not in _BINDS and operand and _NAME.fullmatch(t):
            operand = False
        else:
            break
        out.append(t)
    return out


def evaluate(tokens: list[str]) -> Verdict:
    """Labels and burden of an expression."""
    order = postfix(tokens)
    if order is None:
        labels = frozenset(family(t) for t in tokens if t not in _BINDS and t not in "()")
        return Verdict(labels, max((BURDEN.get(x, UNKNOWN) for x in labels), default=0.0), False)
    stack: list[tuple[frozenset[str], float]] = []
    for t in order:
        if t not in _BINDS:
            stack.append((frozenset([family(t)]), BURDEN.get(family(t), UNKNOWN)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if t == "with":  # an exception is no licence
            stack.append((left, EXCEPTION * a))
        else:
            stack.append((left | right, min(a, b) if t == "or" else max(a, b)))
    return Verdict(*stack[0], True)


_automata: list = []


def automaton():
    if not _automata:
        made = ahocorasick.Automaton()
        for phrase in [*NOTICES, *BASE, *TAGS]:
            made.add_word(f" {phrase} ", (phrase, len(phrase) + 2, phrase.count(" ")))
        made.make_automaton()
        _automata.append(made)
    return _automata[0]


def _sections(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about SECTION bytes that cut no word."""
    lo = 0
    while lo < len(data):
        hi = min(lo + SECTION, len(data))
        while hi < len(data):
            gap = np.flatnonzero(~_WORD[data[hi : hi + SECTION]])
            hi += gap[0] if len(gap) else SECTION
            if len(gap):
                break
        hi = min(hi, len(data))
        yield lo, hi
        lo = hi


def places(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[tuple[str, int, int]]]:
    """Words of each document, and (phrase or tag, first word in the run, byte after its last word) of every place."""
    n_words, found = np.zeros(len(offs) - 1, np.int64), []
    search, seen, count, row = None, 0, 0, -1
    # where the latest words begin in what the automaton has seen, and where they end in the data
    begin, finish = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def collect() -> None:
        for end, (phrase, length, further) in search:
            k = int(np.searchsorted(begin, end - length + 2))
            found.append((phrase, count - len(begin) + k, int(finish[k + further])))

    for lo, hi in _sections(data):
        starts, ends, rows = tk.runs(_WORD[data[lo:hi]], np.clip(offs - lo, 0, hi - lo))
        if not len(starts):
            continue
        n_words += tk.counts(rows, len(n_words))
        # a blank before each word, two where a document begins, so that no phrase reaches into the next one
        size = ends - starts
        fresh = np.append(row, rows[:-1]) != rows
        at = np.cumsum(size + 1 + fresh) - size
        text = np.full(int(at[-1] + size[-1]), 0x20, np.uint8)
        inside = np.arange(int(size.sum())) + np.repeat(at - np.append(0, np.cumsum(size)[:-1]), size)
        text[inside] = _LOWER[data[lo:hi][_WORD[data[lo:hi]]]]
        begin, finish = np.append(begin[-_MOST_WORDS:], at + seen), np.append(finish[-_MOST_WORDS:], ends + lo)
        seen, count, row = seen + len(text), count + len(starts), rows[-1]
        piece = text.tobytes().decode("latin-1")
        if search is None:
            search = automaton().iter(piece)
        else:
            search.set(piece)
        collect()
    if search is not None:
        search.set(" ")  # the blank after the last word
        collect()
    return n_words, found


#: No phrase or tag has more words.
_MOST_WORDS = 1 + max(p.count(" ") for p in (*BASE, *NOTICES, *TAGS))
_GIVEN = re.compile(r"\s*[:=]\s*[\"']?")


def expression(data: np.ndarray, at: int, end: int) -> list[str]:
    """The tokens of the expression that follows a tag, if a colon or an equals sign comes first."""
    line = data[at : min(at + LONGEST, end)].tobytes().split(b"\n", 1)[0].decode("utf-8", "replace")
    given = _GIVEN.match(line)
    return expression_tokens(line[given.end() :]) if given else []


_NOTICE = pa.struct([("label", pa.string()), ("word", pa.int64()), ("base", pa.bool_())])
_EXPRESSION = pa.struct([("text", pa.string()), ("labels", pa.list_(pa.string())), ("burden", pa.float64()), ("whole", pa.bool_())])
SCHEMA = (
    "doc_id long, n_words long, notices array<struct<label string, word long, base boolean>>, "
    "expressions array<struct<text string, labels array<string>, burden double, whole boolean>>, score double"
)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, notices (label, first word, whether of BASE), expressions and score of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(batch.column(1)):
                n_words, found = places(data, offs)
                notices: list[list] = [[] for _ in range(hi - lo)]
                stated: list[list] = [[] for _ in range(hi - lo)]
                score = np.zeros(hi - lo)
                first = np.append(0, np.cumsum(n_words))
                for phrase, word, end in found:
                    k = int(np.searchsorted(first, word, side="right")) - 1
                    if phrase in TAGS:
                        if tokens := expression(data, end, int(offs[k + 1])):
                            v = evaluate(tokens)
                            stated[k].append({"text": " ".join(tokens), "labels": sorted(v.labels), "burden": v.burden, "whole": v.whole})
                            score[k] = max(score[k], v.burden)
                        continue
                    label = BASE.get(phrase) or NOTICES[phrase]
                    notices[k].append({"label": label, "word": word - int(first[k]), "base": phrase in BASE})
                    score[k] = max(score[k], BURDEN[label])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(n_words), pa.array(notices, pa.list_(_NOTICE)), pa.array(stated, pa.list_(_EXPRESSION)), pa.array(score)],
                    names=["doc_id", "n_words", "notices", "expressions", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of what ``scan`` gives."""
    base = F.filter("notices", lambda x: x["base"])
    label = lambda xs: F.transform(xs, lambda x: x["label"])
    every = F.concat(label(F.col("notices")), F.flatten(F.transform("expressions", lambda x: x["labels"])))
    listed = lambda xs: F.concat_ws(",", F.array_sort(F.array_distinct(xs)))
    words = F.transform(base, lambda x: x["word"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        listed(label(base)).alias("base_labels"), listed(every).alias("labels"), "score",
    )
