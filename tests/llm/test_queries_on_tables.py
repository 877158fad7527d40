"""The registered queries on the real tables: against brute force on the smallest, on held-out labels of the next."""

import hashlib
import zlib

import pytest
from test_text_operators import brute_groups, brute_repeats, edit_distance_in

from lumengrid.llm import decontaminate, fingerprint, queries


@pytest.fixture(scope="module")
def rows(spark, small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def test_op2(spark, small, rows):
    items = {r["item_id"]: p for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if (p := decontaminate.plain(r["text"]))}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.op2_decontamination(spark, small).collect()}
    texts = {i: decontaminate.plain(t) for i, t in rows}
    exact = {(i, k) for i, t in texts.items() for k, p in items.items() if p in t}
    assert exact <= set(got)
    assert all(got[x] == 0 for x in exact)
    for i, k in set(got) - exact:
        assert got[i, k] == edit_distance_in(items[k], texts[i]) <= decontaminate.error_budget(len(items[k]), 0.05, 8)


def test_op3(spark, small, rows):
    got = [(r["n_shingles"], r["component_id"]) for r in queries.op3_ngram_jaccard(spark, small).orderBy("doc_id").collect()]
    want = brute_groups([t for _, t in rows], 4, 85, 100)
    assert got == [(n, rows[root][0]) for n, root in (want[i] for i in range(len(rows)))]


def test_op9(spark, small, rows):
    got = {r["doc_id"]: r for r in queries.op9_fingerprint(spark, small).collect()}
    near = []
    for n, (i, t) in enumerate(rows):
        t, following = t or "", rows[(n + 1) % len(rows)][1] or ""
        other = fingerprint.edited(t, following)
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(other.encode()).hexdigest())
        near.append((got[i]["near_edited"], got[i]["near_next"]))
    assert sum(a >= 0.6 for a, _ in near) > 0.95 * len(near)
    assert sum(b < 0.3 for _, b in near) > 0.9 * len(near)


def test_op10(spark, small, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op10_repeats(spark, small).collect()}
    assert got == brute_repeats(rows, 50)


def area(pairs):
    """Area under the curve of (score, label)."""
    good, bad = ([s for s, y in pairs if y == v] for v in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.fixture(scope="module")
def held(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    return folder, labels


def test_op4_on_held_out_languages(spark, held):
    folder, _ = held
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op4_language(spark, folder).collect() if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(got) > 100
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.98 * len(got)


def test_op5_on_held_out_labels(spark, held):
    folder, labels = held
    got = [(r["score"], int(labels[r["doc_id"]]["quality"])) for r in queries.op5_quality(spark, folder).collect() if r["doc_id"] in labels]
    assert area(got) > 0.95


def test_op6_on_held_out_labels(spark, held):
    folder, labels = held
    got = [(r["score"], int(labels[r["doc_id"]]["toxic"])) for r in queries.op6_toxicity(spark, folder).collect() if r["doc_id"] in labels]
    print("toxic", area(got), sum(s >= 0.3 for s, y in got if y), sum(y for _, y in got), sum(s >= 0.3 for s, y in got if not y))
    assert area(got) > 0.75
