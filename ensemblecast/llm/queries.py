"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensemblecast.llm import decontam, fim, jaccard, langid, licences, line_dedup, merkle, oracles, packing, quality, sharding, substring, suffix_dedup, toxicity
from ensemblecast.session import shared_folder


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_hash(modulus: int):
    """crc32 of doc_id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.reshard_files(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_hash(4) == 2)
    model = langid.fit(docs.where("not held_out"))
    return langid.classify(docs, model, ("doc_id", "held_out")).drop("typicality")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines, and passages of 50 words on one or two lines."""
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents"), words=line_dedup.PASSAGE).drop("kept_text", "rid", "emptied")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("rid", "group_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_hash(5) == 0)
    labels = table(spark, sf_dir, "labels").where(id_hash(5) != 0)
    model = toxicity.fit(docs.where("not held_out"), labels)
    return toxicity.score(docs, model, ("doc_id", "held_out")).drop("hits")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(table(spark, sf_dir, "documents")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``other`` is the leaf after tampering, where that is drawn."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    other = F.when(id_hash(3) == 0, merkle.leaf_hash(*(lowered if c == "text" else F.col(c) for c in merkle.FIELDS)))
    made = merkle.manifest(docs, other=other).withColumn("folded_root", merkle.fold(F.coalesce("other", "leaf"), F.col("proof")))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_reshard": op1_reshard,
    "op2_pack": op2_pack,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_licences": op12_licences,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = dict(oracles.SQL)
