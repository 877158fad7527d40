"""The queries ``opN_<name>`` over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fixity, language_model, manifest, mixture, slots
from .common import crc_remainder
from .decontaminate import benchmark_hits
from .fingerprint import fingerprints
from .language import fit_language, identify_language, training_rows
from .language_model import score_texts
from .mixture import pareto_mixture
from .ngram_jaccard import near_duplicate_groups
from .quality import fit_quality, score_quality
from .repeats import remove_repeats
from .toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources to target weights takes of each document."""
    docs = _table(spark, sf_dir, "documents")
    return pareto_mixture(docs, weights=(5, 2, 1), share=(3, 2), most=2).select("doc_id", "size", "source_size", "target", "taken")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs, within 5% of edits."""
    return benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "distance", "hits")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingles reach a Jaccard similarity of 0.85."""
    docs = _table(spark, sf_dir, "documents")
    return near_duplicate_groups(docs, k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    docs = _table(spark, sf_dir, "documents")
    model = fit_language(training_rows(docs))
    held = (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return identify_language(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each document is of good quality."""
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    held = (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each document is toxic."""
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    held = (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of each document under an n-gram model of the others, and under word frequencies alone."""
    return score_texts(_table(spark, sf_dir, "documents"), language_model.training_rows())


def op8_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a replica of the archive of all pages, with known damage, differs from it."""
    pages = _table(spark, sf_dir, "pages")
    expected = pages.select(F.col("page_id").alias("key"), fixity.record(F.col("page_id"), F.col("url"), F.col("html")).alias("value"))
    return fixity.audit(expected, fixity.damaged(pages)).select(F.col("key").alias("page_id"), "fault", "offset", "bytes", "replica_bytes")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and what they tell of their likeness."""
    return fingerprints(_table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document when repeated passages of 50 words are taken out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, window=50, digest=True).select("doc_id", "n_words", "n_removed", F.col("text").alias("kept_sha256"))


def op11_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, through a map of virtual slots."""
    found = slots.sharded(_table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual", "part")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ in their words, and each source's leading terms."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle manifest of all documents, and each one's proof against it, some with tampered text."""
    return manifest.manifest_proofs(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture": op1_mixture,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_language_model": op7_language_model,
    "op8_fixity": op8_fixity,
    "op9_fingerprint": op9_fingerprint,
    "op10_repeats": op10_repeats,
    "op11_slots": op11_slots,
    "op12_divergence": op12_divergence,
    "op13_manifest": op13_manifest,
}

ORACLE_SQL: dict[str, str] = {"op1_mixture": mixture.SQL, "op8_fixity": fixity.SQL, "op11_slots": slots.SQL, "op12_divergence": divergence.SQL, "op13_manifest": manifest.SQL}
