"""The corpus pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_groups, brute_repeats

from lumengrid.llm import decontaminate


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").withColumn("extra", F.lit(1))


def test_stages(spark, small, docs):
    names = docs.columns
    known = cp.known_language(spark, docs, small).cache()
    assert known.columns == names
    lost = docs.join(known, "doc_id", "left_anti").collect()
    assert len(lost) <= 0.01 * docs.count()

    unique = cp.one_of_each_group(spark, known, small).cache()
    assert unique.columns == names
    rows = known.select("doc_id", "text").orderBy("doc_id").collect()
    groups = brute_groups([r["text"] for r in rows], 5, 80, 100)
    assert {r["doc_id"] for r in unique.collect()} == {rows[root]["doc_id"] for _, root in groups.values()}

    cut = cp.without_repeats(spark, unique, small).cache()
    assert cut.columns == names
    want = brute_repeats([(r["doc_id"], r["text"]) for r in unique.collect()], 50)
    assert {r["doc_id"]: len(r["text"].split()) for r in cut.select("doc_id", "text").collect()} == {i: n - gone for i, (n, gone, _) in want.items() if not (gone and gone == n)}

    clean = cp.without_benchmark(spark, cut, small).cache()
    items = [p for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if (p := decontaminate.plain(r["text"]))]
    texts = {r["doc_id"]: decontaminate.plain(r["text"]) for r in cut.select("doc_id", "text").collect()}
    exact = {i for i, t in texts.items() if any(x in t for x in items)}
    kept = {r["doc_id"] for r in clean.collect()}
    assert not exact & kept
    assert len(kept) >= len(texts) - len(exact) - 2

    mix = cp.mixed(spark, clean, small).collect()
    assert mix
    assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * r["size"] for r in mix)


def test_run(spark, small):
    assert cp.run(spark, small).count() > 0
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "repeats", "benchmark", "mixture"]


def test_nulls_and_empty_tables(spark, small, docs):
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", None, None, None, 1), (1, "Some words here.", "en", None, 5, 1)], docs.schema)
    for rows in (odd, odd.limit(0)):
        for _, stage in cp.STAGES:
            assert stage(spark, rows, small).count() <= 3


#: Names that stages use inside.
CLASHING = ("size", "source_size", "target", "taken", "copies", "_doc", "_gone", "_row", "carried", "score", "lang_pred", "n_words", "n_removed", "component_id", "class", "w", "p", "of", "rank", "_seq", "_n", "a.b", "c0")


def test_clashing_names_and_long_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    long = spark.createDataFrame([(10**6, " ".join(f"the word number {i} of a very long text" for i in range(40_000)), "en", "long", 1)], docs.schema)
    rows = docs.unionByName(long).withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, rows, small)
        assert got.columns == rows.columns
        kept = got.collect()
        assert kept and all(r[c] == f"own {c}" for r in kept for c in CLASHING)
    mix = cp.mixed(spark, rows, small)
    assert mix.columns == [c for c in rows.columns if c not in ("size", "source_size", "target", "taken", "copies")] + ["size", "source_size", "target", "taken", "copies"]
    assert all(r["taken"] == r["copies"] * r["size"] and r["_doc"] == "own _doc" for r in mix.collect())
