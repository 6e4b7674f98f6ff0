"""Removal of repeated runs of lines by winnowing, in DataFrame functions only.

Lines with a word count; blank lines always stay. A line goes if a run of ``run`` such lines that covers it also
starts earlier: in a document with a smaller doc_id, or further up in the same document. Fingerprints are the
window minima of hashes of ``run - 1`` lines, ``WINDOW`` of them a window, so any shared run has a shared
fingerprint at the same place. Positions are joined only for fingerprints that occur twice; each match is
extended both ways to all runs that hold the fingerprint, and runs that aren't the first of their kind go.
Counts and firsts are pre-aggregated, no pairs are made.

With ``words``, shorter runs count too if they hold that many words (anything between white space): each such run is
a fingerprint of itself, so passages that stand on fewer than ``run`` lines are found as well.

Lines are compared by 96 bits of two hash functions, rows by a hash and their id. What is counted by a key is
written before it is joined by that key, so that both sides of the join are plain shuffles of tables, which adaptive
execution splits where a line or a run is very common.

A null text has no lines and stays null; a null doc_id counts as the largest; rows with the same doc_id and place
never remove from each other (a tie); equal rows have equal results; a text may have any number of lines, which are
rows of their own from the first step on, and any length; an empty table gives an empty result; other columns are
ignored unless they are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensemblecast.session import cut

#: Fingerprint candidates a window.
WINDOW = 2
#: Words of a passage that counts on however few lines, where that is asked for.
PASSAGE = 50
_LAST = (1 << 63) - 1
_WORD = r"[^\x20\x09-\x0D]"


def remove_repeats(docs: DataFrame, run: int = 3, carry: bool = False, words: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text, kept_sha256 and emptied (no line with a word is left) of every row.

    A repeat is a run of ``run`` lines, or, with ``words``, fewer lines with at least so many words in all. With ``carry`` the other columns come along in a struct named ``row``.
    """
    core = run - WINDOW + 1
    lines = F.split("text", "\n", -1)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), lines.alias("l"), F.xxhash64("doc_id", "text").alias("rid"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] if carry else []),
    )
    full = F.filter(F.transform("l", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].rlike(_WORD))
    of = lambda f: F.transform("full", lambda s: f(s["x"]))
    # arrays as columns of a table: Spark would compute them again for each element of a lambda that names them
    hashed = cut(
        rows.where("l is not null").select("rid", "doc", full.alias("full")).select(
            "rid", "doc", of(F.xxhash64).alias("h"), of(F.hash).alias("g"), of(lambda x: F.lit(0) if words is None else F.regexp_count(x, F.lit(_WORD + "+"))).alias("w"),
            F.transform("full", lambda s: s["i"]).alias("raw"),
        ).where(F.size("h") >= (run if words is None else 1))
    )

    def joint(at, n):
        return F.xxhash64(*[F.col("h")[at + F.lit(k)] for k in range(n)])

    def check(at, n):
        """Of another hash function, for the run that ``joint`` stands for."""
        return F.hash(*[F.col("g")[at + F.lit(k)] for k in range(n)])

    def enough(at, n):
        return sum((F.col("w")[at + F.lit(k)] for k in range(n)), F.lit(0)) >= words

    def mark(at, n, size):
        return F.struct(joint(at, size).alias("key"), (check(at, n) if n < run else F.lit(0)).alias("check"), at.alias("pos"), F.lit(n).alias("n"))

    def of_size(n, found):
        return F.when(F.size("h") >= n, found).otherwise(F.array().cast("array<struct<key: long, check: int, pos: int, n: int>>"))

    def short(n):
        """Runs of ``n`` lines with enough words, but for those that two shorter ones cover."""
        at = F.filter(F.sequence(F.lit(0), F.size("h") - n), lambda p: enough(p, n) & ~(enough(p, n - 1) & enough(p + F.lit(1), n - 1) if n > 1 else F.lit(False)))
        return of_size(n, F.transform(at, lambda p: mark(p, n, n)))

    least = lambda s: F.least(*[F.struct(joint(s + F.lit(k), core).alias("key"), (s + F.lit(k)).alias("pos")) for k in range(WINDOW)])["pos"]
    minima = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - run), least))
    marks = [of_size(run, F.transform(minima, lambda p: mark(p, run, core)))]
    marks += [short(n) for n in range(1, run)] if words is not None else []
    start = F.greatest(F.col("f.pos") - (WINDOW - 1), F.lit(0))
    length = F.when(F.col("f.n") == run, F.col("f.pos") + core + WINDOW - 1 - start).otherwise(F.col("f.n"))
    around = lambda c: F.when(F.col("f.n") == run, F.slice(c, start + 1, length)).alias(c)
    raws = F.slice("raw", F.when(F.col("f.n") == run, start).otherwise(F.col("f.pos")) + 1, length)
    marked = cut(
        hashed.withColumn("f", F.explode(F.concat(*marks)))
        .select("rid", "doc", "f.key", "f.check", "f.n", F.size("h").alias("total"), around("h"), around("g"), raws.alias("raw"))
    )
    fingerprints = marked.where(F.col("n") == run)
    again = cut(fingerprints.groupBy("key").count().where("count > 1").select("key"))
    found = fingerprints.join(again, "key").select("rid", "doc", "total", "h", "g", "raw", F.explode(F.sequence(F.lit(0), F.size("h") - run)).alias("s"))
    found = found.select("rid", "doc", "total", F.slice("raw", F.col("s") + 1, run).alias("raw"), joint(F.col("s"), run).alias("key"), check(F.col("s"), run).alias("check"))
    if words is not None:
        found = found.unionByName(marked.where(F.col("n") < run).select("rid", "doc", "total", "raw", "key", "check"))
    found = cut(found)
    place = F.struct(F.col("doc"), F.col("raw")[0].alias("at"))
    firsts = found.groupBy("key", "check").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = cut(firsts.where("first < last").select("key", "check", "first"))
    later = found.join(firsts, ["key", "check"]).where(place > F.col("first"))
    gone = later.groupBy("rid", "doc").agg(F.array_distinct(F.flatten(F.collect_set("raw"))).alias("covered"), F.max("total").alias("total"))

    # the lines come through the join as an array, as they are asked for one by one
    out = rows.join(gone, ["rid", "doc"], "left")
    every = F.sequence(F.lit(0), F.size("l") - 1)
    left = F.when(F.col("covered").isNull(), F.col("l")).otherwise(F.transform(F.array_except(every, "covered"), lambda i: F.col("l")[i]))
    return out.withColumn("kept_text", F.array_join(left, "\n")).select(
        "doc_id",
        F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
        "kept_text",
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
        "rid", F.coalesce(F.size("covered") == F.col("total"), F.lit(False)).alias("emptied"), *(["row"] if carry else []),
    )


#: The same result as doc_id, n_lines, n_removed, kept_sha256 for a run of 3.
SQL = r"""
with d as (select doc_id, text, row_number() over () as r from documents),
l as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as raw from d where text is not null),
n as (select *, row_number() over (partition by r order by raw) as p from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
w as (select *, lead(line, 1) over (partition by r order by p) as l2, lead(line, 2) over (partition by r order by p) as l3 from n),
k as (select *, l3 is not null and rank() over (partition by line, l2, l3 order by coalesce(doc_id, 9223372036854775807), p) > 1 as hit from w),
c as (select r, raw, hit or coalesce(lag(hit, 1) over (partition by r order by p), false) or coalesce(lag(hit, 2) over (partition by r order by p), false) as gone from k),
o as (select l.r, count(*) as n_lines, count(*) filter (where gone) as n_removed, string_agg(line, chr(10) order by l.raw) filter (where not coalesce(gone, false)) as kept from l left join c on l.r = c.r and l.raw = c.raw group by l.r)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join o on d.r = o.r
"""


def passage_sql(words: int = PASSAGE) -> str:
    """The same result for a run of 3 and ``words``, from the contract: windows of one, two and three lines."""
    return rf"""
with d as (select doc_id, text, row_number() over () as r from documents),
l as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as raw from d where text is not null),
n as (select *, coalesce(doc_id, 9223372036854775807) as doc, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as c, row_number() over (partition by r order by raw) as p from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
w as (select *, lead(line, 1) over o as l2, lead(line, 2) over o as l3, lead(c, 1) over o as c2 from n window o as (partition by r order by p)),
k as (select *, c >= {words} and rank() over (partition by line order by doc, p) > 1 as hit1,
 l2 is not null and c + c2 >= {words} and rank() over (partition by line, l2 order by doc, p) > 1 as hit2,
 l3 is not null and rank() over (partition by line, l2, l3 order by doc, p) > 1 as hit3 from w),
c as (select r, raw, hit1 or hit2 or hit3 or coalesce(lag(hit2, 1) over o, false) or coalesce(lag(hit3, 1) over o, false) or coalesce(lag(hit3, 2) over o, false) as gone from k window o as (partition by r order by p)),
o as (select l.r, count(*) as n_lines, count(*) filter (where gone) as n_removed, string_agg(line, chr(10) order by l.raw) filter (where not coalesce(gone, false)) as kept from l left join c on l.r = c.r and l.raw = c.raw group by l.r)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join o on d.r = o.r
"""
