"""From documents to a training mix: five stages, each written as Parquet before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.llm.common import discard, set_aside, unpacked_text, written
from lumengrid.llm.decontaminate import without_items
from lumengrid.llm.language import fit_language, identify_language, training_rows
from lumengrid.llm.mixture import pareto_mixture
from lumengrid.llm.ngram_jaccard import near_duplicate_groups
from lumengrid.llm.repeats import remove_repeats

#: The columns that stages look at; others are carried, whatever their names.
OWN = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose most likely language gets less than this go.
LEAST_LANGUAGE_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones among them) and those that no language claims, by
    the text of each row alone; lang stays as it was. Where no text has a lang, nothing can be learned,
    every text is unknown and all go."""
    docs, put_back = set_aside(docs, *OWN)
    model = fit_language(training_rows(docs))
    kept = identify_language(docs, model)
    return put_back(kept.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles link at a similarity of 0.8, one row stays: that with the
    smallest doc_id, one without doc_id only where no other has any. Texts of fewer words than a
    shingle link as wholes, texts without words with nothing. Rows are told apart by a number of
    their own, so those that share a doc_id or have none don't share their fate. An empty table stays
    one; other columns are carried."""
    docs, put_back = set_aside(docs, "doc_id", "text")
    # the join hands all columns on, so that rows are numbered and read once
    rows = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.struct("doc_id", "carried").alias("carried"))
    groups = near_duplicate_groups(rows, k=5, num=80, den=100, whole=True)
    place = F.struct(F.col("carried.doc_id").isNull().alias("none"), F.col("carried.doc_id").cast("long").alias("id"), F.col("doc_id").alias("row"))
    stay = groups.groupBy("component_id").agg(F.min(place).alias("first")).select(F.col("first.row").alias("doc_id"))
    kept = groups.join(stay, "doc_id", "left_semi").select("text", "carried")
    return put_back(unpacked_text(kept).select("carried.doc_id", "text", F.col("carried.carried").alias("carried")))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes 50-word passages out of all documents but the first that has them; documents of which
    nothing is left go. n_chars follows the text. Rows of null text or without words lose nothing and
    stay, rows that share a doc_id take nothing from each other, an empty table stays one; other columns are
    carried."""
    docs, put_back = set_aside(docs, *OWN)
    cut = remove_repeats(docs, window=50)
    kept = cut.where(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words"))))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return put_back(kept)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows in whose text an item of ``benchmark`` occurs; doc_id has no part in it. Null and
    empty texts hold none and stay, so does all where the test set is empty; other columns are carried."""
    docs, put_back = set_aside(docs, *OWN)
    return put_back(without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents with their columns, how often each is in it (``copies``) and its
    words in it. Rows are drawn each for itself, whatever their doc_id; those of null source are a
    source of their own; rows of null, empty or wordless text have no words to give and go. An empty
    table gives an empty mix. Columns that are named like those of the mix are replaced, others carried."""
    docs, put_back = set_aside(docs, *OWN)
    mix = pareto_mixture(docs, carry=tuple(docs.columns))
    copies = F.coalesce(F.try_divide(F.col("taken"), F.col("size")), F.lit(0)).cast("long")
    return put_back(mix.withColumn("copies", copies).where("taken > 0"), "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("mixture", mixed),
]

#: SQL can't train the language model nor run the edit matching; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = written(out, f"stage-{name}")
            discard(docs)
        docs = out
    return docs
