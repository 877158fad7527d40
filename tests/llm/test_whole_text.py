"""Text operators and stages do the whole job: repeated rows, rows without id, items that share an id."""

import corpus_pipeline as cp

from lumengrid.llm import decontaminate, language_model, toxicity


def test_language_model_keeps_equal_partitions_apart(spark):
    own = [(0, "one two three"), (1, "two three four"), (2, "five")]
    parts = [own, own, [(0, "")], [(None, "")]]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda p: p), "doc_id long, text string")
    got = language_model.score_texts(docs, language_model.training_rows()).collect()
    want = [(-1 if i is None else i, len(t.split()) + 1) for p in parts for i, t in p]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got) == sorted(want)


def test_items_that_share_an_id_are_all_searched(spark):
    items = ["the first item has a dozen words or so in it", "another item under the very same id is here", "an item that came without any id at all", "a second item that came without its id"]
    keys = [1, 1, None, None]
    rows = spark.createDataFrame([*zip(keys, items, strict=True), (1, items[0].upper()), (None, None), (2, " .. ")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate([*items, "nothing of them"])], "doc_id long, text string")
    got = decontaminate.benchmark_hits(docs, rows).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in got) == [(i, k or 0) for i, k in enumerate(keys)]


def test_stages_decide_row_by_row(spark, tmp_path):
    item = "the benchmark asks how many apples are left in the basket of the old man"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {item} ok"), (None, "a clean text that nobody gave an id"), (7, f"again {item} here"), (7, "a clean text of the same id as another"), (8, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["text"] for r in cp.without_benchmark(spark, docs, str(tmp_path)).collect()} == {rows[i][1] for i in (1, 3, 4)}

    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a")), (None, text("a") + " more"), (None, text("b")), (None, text("c")), (None, text("c") + " more"), (5, text("a")), (5, text("d"))]
    got = cp.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:1]) for r in got) == [(0, "b"), (0, "c"), (1, "a"), (5, "d")]


def test_misspelled_mined_terms_are_met(spark):
    bad = ["you grovnax", "such grovnaxes here", "all grovnaxing again", "a zub"]
    texts = [f"{t} number {i} of many" for i in range(200) for t in (bad[i % 4], "quiet words of peace")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(len(texts))], "doc_id long, toxic int"))
    assert {"grovnax", "zub"} <= set(model.terms)
    said = ["you grovnax", "you gravnax", "you zub", "you quiet"]
    scores = {r["text"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), model).collect()}
    assert scores["you gravnax"] > scores["you quiet"] and scores["you zub"] > scores["you quiet"]
    lexicon = toxicity.FuzzyLexicon([], ["lowei", "abcd"], stem_edits=True)
    assert [lexicon.match(w) for w in ("loweichen", "lawei", "laweichen", "laxeichen", "abxd")] == [0, 1, 1, 99, 99]
