"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .interleave import SHARDS, interleave
from .mixture import mix_sources
from .neighbours import nearest_neighbours
from .oracle import ORACLE  # noqa: F401 - read by the registry
from .packing import pack
from .pii import personal_data
from .sentences import remove_repeated_sentences
from .simhash import simhash_groups
from .spelling import TYPO_EVERY, spelling_variants
from .substrings import kept_text, remove_repeats
from .toxicity import score_toxicity
from .urlrules import judge_urls
from .whitening import whiten


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents`` by SimHash."""
    groups = simhash_groups(spark, table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every hundredth row of ``embeddings``."""
    return nearest_neighbours(spark, table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every row of ``documents``."""
    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` into 24 shards that match the mixture of sources."""
    placed = interleave(spark, table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without bytes of repeated 400-byte strings."""
    kept = remove_repeats(spark, table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                       kept_text("kept").alias("kept"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every URL of ``pages``."""
    return judge_urls(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without sentences of repeated spans."""
    kept = remove_repeated_sentences(spark, table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_sentences", "n_removed", F.length("kept").cast("long").alias("n_kept_chars"),
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every row of ``documents``."""
    return personal_data(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as token pieces packed into sequences of 2048."""
    return pack(spark, table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every row of ``documents``."""
    return score_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` on their four largest components, whitened."""
    return whiten(spark, table(spark, sf_dir, "embeddings"))


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of each row of ``documents``."""
    mixed, sources = mix_sources(spark, table(spark, sf_dir, "documents"), keep=("doc_id", "source"))
    sources = F.broadcast(sources.select("source", "source_size", "target"))  # a row per source
    return (mixed.alias("m").join(sources.alias("s"), F.col("m.source").eqNullSafe(F.col("s.source")))
            .select("doc_id", F.col("mix_size").alias("size"), "source_size", "target",
                    F.col("mix_taken").alias("taken"), "m.source"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of ``documents``, some of them cut by a letter."""
    return spelling_variants(spark, table(spark, sf_dir, "documents"), typo_every=TYPO_EVERY)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_neighbours": op2_neighbours,
    "op3_decontamination": op3_decontamination,
    "op4_sharding": op4_sharding,
    "op5_substrings": op5_substrings,
    "op6_urls": op6_urls,
    "op7_sentences": op7_sentences,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_mixture": op12_mixture,
    "op13_spelling": op13_spelling,
}
