"""Fill-in-the-middle rearrangement of whole texts.

A text of n units is cut twice: the prefix ends after the smaller, the middle after the larger of two numbers drawn
from a hash of its id, and prefix, middle and suffix are put in the order in which a model learns to fill gaps. Units are
code points, or words or lines with what follows them.

The cuts are found by one numpy kernel for a whole run of texts over their Arrow UTF-8 buffer: a table gives each byte's
class, the classes of a byte and of the one before it tell where a unit begins, cumulative sums of that mask (reset at
each document by the sum before it) count units, and one ``searchsorted`` turns the cuts of all documents into byte positions.
A text of many megabytes is counted a section at a time, and only the sections that hold a cut are counted again.

A text that is empty (or null), that contains one of the marks, or that is drawn to stay so is ``plain``: output and text are
equal, and lengths of its parts are null. A null id is hashed as an empty number. Equal ids (ties) are cut by the same
numbers; repeated rows have equal results; an empty table gives an empty result; a text may have any length; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensemblecast.llm import textkit as tk
from ensemblecast.session import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes whose units are counted at once.
SECTION = 1 << 21

INSIDE, BLANK, BREAK, OPEN, CLOSE, LETTER, OTHER = range(7)


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[0x80:0xC0] = INSIDE
    table[tk.SPACE] = BLANK
    table[0x0A] = BREAK
    table[[ord("<"), ord(">")]] = OPEN, CLOSE
    table[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = LETTER
    return table


CLASS = _classes()
#: BEGINS[unit][class before, class]: whether a unit begins at a byte. At a document's first byte one always does.
BEGINS = {
    "char": np.array([[c != INSIDE for c in range(7)] for _ in range(7)]),
    "word": np.array([[before in (BLANK, BREAK) and c not in (BLANK, BREAK) for c in range(7)] for before in range(7)]),
    "line": np.array([[before == BREAK for _ in range(7)] for before in range(7)]),
}


class Units:
    """Where the units of a run of texts begin."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, unit: str):
        self.data, self.offs, self.begins = data, offs, BEGINS[unit]
        self.first = np.unique(offs[:-1][np.diff(offs) > 0])
        self.edges = np.arange(0, len(data) + SECTION, SECTION)
        self.edges[-1] = len(data)
        #: Units that begin before each section, and before each offset.
        self.before, self.at = np.zeros(len(self.edges), np.int64), np.zeros(len(offs), np.int64)
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int32))
        for s in range(len(self.edges) - 1):
            sums = self._sums(s)
            inside = slice(*np.searchsorted(offs, (self.edges[s] + 1, self.edges[s + 1] + 1)))
            self.at[inside] = self.before[s] + sums[offs[inside] - self.edges[s] - 1]
            self.before[s + 1] = self.before[s] + (sums[-1] if len(sums) else 0)

    def _sums(self, s: int) -> np.ndarray:
        """Cumulative number of units that begin in a section."""
        if self.last[0] != s:
            a, b = self.edges[s], self.edges[s + 1]
            own = CLASS[self.data[max(0, a - 1) : b]]
            if not a:
                own = np.append(np.uint8(BREAK), own)
            mask = self.begins[own[:-1], own[1:]]
            mask[self.first[slice(*np.searchsorted(self.first, (a, b)))] - a] = True
            self.last = s, np.cumsum(mask, dtype=np.int32)
        return self.last[1]

    def count(self) -> np.ndarray:
        """Units of each document."""
        return np.diff(self.at)

    def positions(self, after: np.ndarray) -> np.ndarray:
        """Byte positions at which so many units of each document are over, in any order within it (one row of ``after`` a document)."""
        out = np.repeat(self.offs[1:, None], after.shape[1], axis=1)
        wanted = self.at[:-1, None] + after + 1  # the position is where this unit of the run begins
        open_ = after < self.count()[:, None]
        section = np.searchsorted(self.before, wanted[open_], side="left") - 1
        found = np.empty(len(section), np.int64)
        for s in np.unique(section):
            mine = section == s
            found[mine] = self.edges[s] + np.searchsorted(self._sums(s), wanted[open_][mine] - self.before[s], side="left")
        out[open_] = found
        return out


def marked(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which documents contain a mark."""
    out = np.zeros(len(offs) - 1, bool)
    for a in range(0, len(data), SECTION):
        own = CLASS[data[a : a + SECTION + 2]]
        at = np.flatnonzero((own[:-2] == OPEN) & (own[1:-1] == LETTER) & (own[2:] == CLOSE)) + a
        row = np.searchsorted(offs, at, side="right") - 1
        out[row[at + 3 <= offs[row + 1]]] = True
    return out


def arrange(data: np.ndarray, offs: np.ndarray, draws: np.ndarray, plain_share: int, spm_share: int, unit: str) -> tuple[np.ndarray, ...]:
    """(units, form, prefix and middle units, the pieces' bytes, their offsets) of a run of texts, with four draws each."""
    units = Units(data, offs, unit)
    n = units.count()
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    plain = (n == 0) | marked(data, offs) | (draws[:, 2] % 100 >= 100 - plain_share)
    form = np.where(plain, 0, np.where(draws[:, 3] % 100 < spm_share, 2, 1))
    at = units.positions(np.where(plain[:, None], 0, cuts))
    whole, a, b = memoryview(np.ascontiguousarray(data)), at[:, 0].tolist(), at[:, 1].tolist()
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    pieces: list = []
    for k, (kind, lo, hi) in enumerate(zip(form.tolist(), offs[:-1].tolist(), offs[1:].tolist())):
        if kind == 0:
            pieces.append(whole[lo:hi])
        elif kind == 1:
            pieces += (p, whole[lo : a[k]], s, whole[b[k] : hi], m, whole[a[k] : b[k]])
        else:
            pieces += (s, whole[b[k] : hi], p, whole[lo : a[k]], m, whole[a[k] : b[k]])
    sizes = np.diff(offs) + np.where(form == 0, 0, len(p) + len(s) + len(m))
    return n, form, cuts[:, 0], cuts[:, 1] - cuts[:, 0], b"".join(pieces), np.append(0, np.cumsum(sizes))


FORMS = np.array(["plain", "psm", "spm"])


def draws(doc_id, seed: int = 1, many: int = 4):
    """The first ``many`` 8-digit groups of the sha256 of ``seed:doc_id``, as an array of numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(many)))


def transform(docs: DataFrame, seed: int = 1, plain_share: int = 10, spm_share: int = 20, unit: str = "char") -> DataFrame:
    """doc_id, n, form, prefix and middle units, text and output of every row; shares are percentages."""
    ship(docs.sparkSession)
    names = ["doc_id", "n", "form", f"prefix_{unit}s", f"middle_{unit}s", "text", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = batch.column(2).flatten().to_numpy().reshape(-1, 4)
            for lo, hi, data, offs in tk.chunks(batch.column(1)):
                n, form, prefix, middle, body, ends = arrange(data, offs, drawn[lo:hi], plain_share, spm_share, unit)
                output = pa.StringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body))
                cut = [pa.array(x, mask=form == 0) for x in (prefix, middle)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n), pa.array(FORMS[form]), *cut, batch.column(1)[lo:hi], output], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), draws(F.col("doc_id").cast("long"), seed).alias("draws"))
    return rows.mapInArrow(run, f"doc_id long, n long, form string, {names[3]} long, {names[4]} long, text string, output string")


def restored(output, form):
    """The text that an output of the given form came from, as a column; no part of it holds a mark, so the first one counts."""
    mark = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    head = F.call_function("substring_index", body, mark, F.lit(1))
    rest = F.substr(body, F.length(head) + F.lit(len(PREFIX) + 1))
    tail = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(tail) + F.lit(len(MIDDLE) + 1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
