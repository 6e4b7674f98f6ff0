"""A corpus cleaning pipeline: language, repeated lines, near duplicates, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``docs``. A row that a stage rejects is gone for the stages after it. Columns beyond those of ``documents`` are
kept as they are, null texts go at the first stage, equal rows are copies of which one stays, texts may have any
length, and an empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensemblecast.llm import decontam, jaccard, langid, line_dedup, packing, queries
from ensemblecast.session import cut


#: Share of the texts of a learned language that may be taken for foreign, if their tail were exponential, and the shares between
#: which that tail is measured. They lie so far in that a few hundredths of foreign texts among the others move it little.
FALSE_ALARMS, TAIL = 1e-6, (0.02, 0.1)
#: Odds at which the claim of ``lang`` counts as contradicted.
CONTRADICTED = 0.9999
_LAST = (1 << 63) - 1


def _rows(docs: DataFrame, *but: str) -> DataFrame:
    """The columns in a struct named ``row``, so that no name clashes, the hash ``rid`` that the operators return, and the id."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but]).alias("row")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    return docs.select(row, F.xxhash64(F.col("doc_id").cast("long"), "text").alias("rid"), doc, *but)


def language_verdicts(docs: DataFrame) -> DataFrame:
    """row, lang, text and ``reason``, null for texts that stay: no_letter, foreign (far from every learned language), contradicted.

    How far is too far is measured on texts that the model hasn't seen and whose predicted language is the claimed one: the tail of
    their typicality between the shares of TAIL, carried on to FALSE_ALARMS. A claim of a learned language is contradicted where another
    one has odds of CONTRADICTED or more and the text is no less typical of it than nine tenths of those texts are; texts in two
    languages, one of them the claimed one, stay.
    """
    held = queries.id_hash(4) == 2
    model = langid.fit(docs.where(~held))
    judged = cut(
        langid.classify(_rows(docs, "text", "lang"), model, ("row", "lang", "text"))
        .withColumn("held", F.crc32(F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))) % 4 == 2)
    )
    own = judged.where("held and lang_pred = lang and typicality is not null")
    far, near = own.agg(F.percentile_approx("typicality", list(TAIL), 100_000)).first()[0] or (float("-inf"), float("-inf"))
    least = far + (near - far) * math.log(FALSE_ALARMS / TAIL[0]) / math.log(TAIL[1] / TAIL[0]) if math.isfinite(far) else far
    learned = F.col("lang").isin(list(model.languages)) if len(model.languages) <= 1000 else F.col("lang").isNotNull()
    against = learned & (F.col("lang") != F.col("lang_pred")) & (F.col("score") >= CONTRADICTED) & (F.col("typicality") >= F.lit(near))
    reason = F.when(F.col("lang_pred") == "und", "no_letter").when(F.col("typicality") < F.lit(least), "foreign").when(against, "contradicted")
    return judged.select("row", "lang", "text", reason.alias("reason"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, foreign to every learned language, or of another language than claimed, go; ``lang`` stays as it is."""
    kept = language_verdicts(docs).where("reason is null")
    own = {"text": F.col("text"), "lang": F.col("lang")}
    return kept.select(*(own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the runs of lines, and shorter passages of 50 words, that stand earlier; what has no word left goes."""
    kept = line_dedup.remove_repeats(docs, carry=True, words=line_dedup.PASSAGE).where("not emptied")
    columns = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("kept_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, columns["n_chars"]).otherwise(F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*(columns[c].alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each group of near copies stays; groups are told apart by their links, not by ids."""
    grouped = cut(jaccard.near_duplicates(docs).select("rid", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "group_id"))
    first = grouped.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct("doc", "rid")).alias("head"))
    heads = first.select("head.rid", "head.doc").unionByName(grouped.where("group_id is null").select("rid", "doc")).distinct()
    return _rows(docs).join(heads, ["rid", "doc"], "left_semi").dropDuplicates(["rid", "doc"]).select("row.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that cover a benchmark item go."""
    found = decontam.find_leaks(docs, queries.table(spark, sf_dir, "benchmark")).where("contaminated")
    leaks = found.select("rid", F.coalesce("doc_id", F.lit(_LAST)).alias("doc")).distinct()
    return _rows(docs).join(leaks, ["rid", "doc"], "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the token sequences."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("language", language),
    ("line_dedup", lines),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]
#: SQL can't express the learned model, the MinHash forest and the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what each returns is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
