"""The text operators against plain Python, on a few documents with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumengrid.llm import common, decontaminate, fingerprint, fixity, language, language_model, mixture, ngram_jaccard, quality, repeats, toxicity
from lumengrid.operators.components import components
from lumengrid.llm.elias_fano import EliasFano

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def documents(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL)


def sample_texts(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    out = [None, "", " \t\n", "one", "One", "a b c", passage]
    while len(out) < n:
        k = rng.randint(1, 120)
        text = rng.choice(" \n").join(rng.choice(vocabulary) for _ in range(k))
        roll = rng.random()
        if roll < 0.2:
            text = out[rng.randrange(7, len(out))] if len(out) > 8 else text
        elif roll < 0.4 and len(out) > 8:
            base = (out[rng.randrange(7, len(out))] or "").split(" ")
            if base:
                base[rng.randrange(len(base))] = "edited"
            text = " ".join(base)
        elif roll < 0.5:
            text = text + "\n" + passage + " " + text[:20]
        out.append(text)
    return out


# ---------------------------------------------------------------- shared parts


def test_words_are_the_contracts_words():
    texts = ["Ab  cD\tx", "", None, "é É \x0b q\x1cr", "end"]
    w = common.Words(pa.array(texts, pa.string()).fill_null(""), lower=True)
    for i, t in enumerate(texts):
        own = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)][w.first[i] : w.first[i + 1]]
        assert own == [x.lower() for x in words_of(t)]
    again = common.Words(pa.array(["x ab", "AB"], pa.string()), lower=True)
    assert again.hash[1] == again.hash[2] == w.hash[0]
    assert len(set(w.hash.tolist())) == len({x.lower() for t in texts for x in words_of(t)})


def test_spans_are_equal_where_words_are():
    h = np.array([5, 7, 9, 5, 7, 9, 1], np.uint64)
    s = common.spans(h, 3)
    assert s[0] == s[3]
    assert len(set(s.tolist())) == 4
    assert len(common.spans(h, 8)) == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (3, 9), (4, 4), (9, -5)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n for n, r in got.items() if r == -5} == {-5, 1, 2, 3, 9}
    assert got[11] == 10
    assert {got[i] for i in range(100, 131)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 mixture


def test_mixture(spark):
    docs = documents(spark, sample_texts(90))
    docs = docs.unionByName(docs.where("doc_id = 20")).unionByName(spark.createDataFrame([(None, "a b", "en", "s1", 3)], DDL)).withColumn("size", F.lit("clash")).withColumn("rank", F.lit(1))
    got = mixture.pareto_mixture(docs).collect()
    assert len(got) == 92
    assert sorted(map(str, mixture.pareto_mixture(docs).collect())) == sorted(map(str, got))
    total = sum(r["size"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
        assert r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    assert sum(rows[0]["target"] for rows in by.values()) == pytest.approx(1.5 * total)
    for rows in by.values():
        assert rows[0]["source_size"] == sum(r["size"] for r in rows)
        assert rows[0]["target"] <= 2 * rows[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 0.1 * rows[0]["target"] + 5
    assert mixture.pareto_mixture(docs.limit(0)).count() == 0


def test_mixture_draws_rows_not_ids(spark):
    rows = [(None, f"w{i % 7} " * 10, "en", "a", 1) for i in range(200)] + [(5, "w " * 7, "en", "b", 1) for _ in range(300)] + [(i, "w " * 7, "en", "b", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, DDL)
    got = mixture.pareto_mixture(docs, weights=(1,), share=(1, 2), carry=("lang",)).collect()
    for source, size in (("a", 10), ("b", 7)):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < size
    again = mixture.pareto_mixture(docs.repartition(5), weights=(1,), share=(1, 2)).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert {r["lang"] for r in got} == {"en"}


def test_mixture_prefers_larger_documents(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "w " * rng.choice((4, 64)), "en", "s", 1) for i in range(3000)], DDL)
    got = mixture.pareto_mixture(docs, weights=(1,), share=(1, 4)).collect()
    large = [r for r in got if r["size"] == 64]
    small = [r for r in got if r["size"] == 4]
    share = lambda rows: sum(r["taken"] > 0 for r in rows) / len(rows)
    # inclusion probabilities are in proportion to size: 64 * p(64) / 4 and so on
    level = 0.25 * sum(r["size"] for r in got) / sum(r["size"] ** 2 for r in got)
    assert share(large) == pytest.approx(64 * level, rel=0.15)
    assert share(small) == pytest.approx(4 * level, rel=0.6)


def test_mixture_chances_follow_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 5, "en", "s", 10) for i in range(2000)], DDL).withColumn("good", F.col("doc_id") % 2)
    got = mixture.pareto_mixture(docs, weights=(1,), share=(1, 2), weight=F.when(F.col("good") == 1, 4.0).otherwise(1.0)).collect()
    taken = collections.Counter(r["doc_id"] % 2 for r in got if r["taken"])
    assert sum(taken.values()) == 1000
    assert taken[1] > 1.7 * taken[0]


# ---------------------------------------------------------------- 2 decontamination


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_finds_the_best_place():
    rng = random.Random(3)
    for _ in range(200):
        item = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 90)))
        assert decontaminate.myers_best(item, text)[0] == edit_distance_in(item, text)


def test_decontamination(spark):
    rng = random.Random(5)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    edited = item.replace(item[40], "z", 1)[:150] + "!!" + item[151:]
    texts = [f"before {item.upper()} after", "x " + edited + " y", item[: len(item) // 2], None, "", "nothing " * 50, f"{item}\n\n{item}"]
    items = spark.createDataFrame([(1, item), (2, None), (3, " .. "), (4, "short one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.benchmark_hits(documents(spark, texts).withColumn("item_id", F.lit(9)), items).collect()}
    assert set(got) == {(0, 1), (1, 1), (6, 1)}
    assert got[0, 1]["distance"] == 0
    assert 0 < got[1, 1]["distance"] <= decontaminate.error_budget(len(item), 0.05, 8)
    assert got[6, 1]["hits"] == 2
    assert decontaminate.benchmark_hits(documents(spark, texts), items.limit(0)).count() == 0


def test_every_match_within_budget_is_found(spark):
    rng = random.Random(8)
    item = "".join(rng.choice("abcdefghij ") for _ in range(120)).strip()
    item = decontaminate.plain(item)
    budget = decontaminate.error_budget(len(item), 0.05, 8)
    texts = []
    for _ in range(60):
        s = list("".join(rng.choice("abcdefghij") for _ in range(30)) + item + "".join(rng.choice("abcdefghij") for _ in range(30)))
        for _ in range(rng.randint(0, 2 * budget)):
            s[rng.randrange(30, 30 + len(item))] = rng.choice("kl")
        texts.append("".join(s))
    got = {r["doc_id"] for r in decontaminate.benchmark_hits(documents(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {i for i, t in enumerate(texts) if edit_distance_in(item, decontaminate.plain(t)) <= budget}


# ---------------------------------------------------------------- 3 n-gram Jaccard


def brute_groups(texts, k, num, den):
    sets = {}
    for i, t in enumerate(texts):
        w = [x.lower() for x in words_of(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_texts(seed, n):
    """Texts around a few bases, at all distances from them, so that tiles fall into pieces."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.choice((8, 12, 30, 60, 100)))] for _ in range(6)]
    out = [None, "", "a", "A", "a b"]
    while len(out) < n:
        b = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(b) // 10))):
            b[rng.randrange(len(b))] = f"e{rng.randrange(10)}"
        if rng.random() < 0.3:
            b += [f"x{rng.randrange(50)}" for _ in range(rng.randint(1, 6))]
        out.append(" ".join(b))
    return out


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 4, 85, 100), (2, 1, 80, 100)])
def test_jaccard_groups(spark, monkeypatch, seed, k, num, den):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    texts = near_texts(seed, 220)
    docs = documents(spark, texts).withColumn("class", F.lit("clash")).withColumn("size", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicate_groups(docs, k, num, den).collect()}
    assert got == brute_groups(texts, k, num, den)


def test_jaccard_edges(spark):
    docs = spark.createDataFrame([(3, "same text here now", None, None, 0), (3, "same text here now", None, None, 0), (None, "SAME text here now", None, None, 0), (None, None, None, None, 0), (7, "same text here now", None, None, 0)], DDL)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicate_groups(docs).collect())
    assert got == [("3", 1, 3), ("3", 1, 3), ("7", 1, 3), ("None", 0, None), ("None", 1, 3)]
    assert ngram_jaccard.near_duplicate_groups(docs.limit(0)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        drop = int(rng.integers(0, max(1, n // 7) + 1))
        y = np.concatenate([x[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 12) + 1)), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        common_ = len(np.intersect1d(x, y))
        if 100 * common_ >= 85 * (len(x) + len(y) - common_) and len(x) and not np.array_equal(x, y):
            assert len(np.intersect1d(ngram_jaccard.signatures(x, 85, 100), ngram_jaccard.signatures(y, 85, 100)))


# ---------------------------------------------------------------- 4 language


def test_language(spark):
    rng = random.Random(2)
    parts = {"xx": ["tion", "the", "ing", "ou"], "yy": ["sch", "keit", "ung", "der"], "zz": ["ção", "não", "lha", "em"]}
    rows = []
    for i in range(150):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(20)), lang if i % 11 else None, "s", 1))
        truth = rows[-1]
    docs = spark.createDataFrame([*rows, (900, None, "xx", "s", 1), (901, "", "xx", "s", 1), (902, "123 --", "xx", "s", 1), (None, truth[1], "xx", "s", 1)], DDL).withColumn("score", F.lit("clash"))
    model = language.fit_language(language.training_rows(docs))
    got = {r["doc_id"]: r for r in language.identify_language(docs, model).collect()}
    assert len(got) == 154
    assert all(got[i]["lang_pred"] == lang for i, _, lang, *_ in rows if lang)
    assert all(0 < got[i]["score"] <= 1 for i in range(150))
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    empty = language.identify_language(docs, language.fit_language(docs.limit(0)))
    assert {(r["lang_pred"], r["score"]) for r in empty.collect()} == {("und", 0.0)}


def test_letters_beyond_the_first_plane():
    assert not len(language.ngram_buckets("\U0001F600\U0001F600 123 \U0001D7CE"))
    assert len(language.ngram_buckets("\U00010400"))


def test_calibration_is_not_certain():
    logits = np.array([[5.0, 0.0]] * 50)
    labels = np.array([0] * 40 + [1] * 10)
    p = language.softmax(logits / language.calibrate(logits, labels))
    assert p[0, 0] == pytest.approx(0.8, abs=0.03)


# ---------------------------------------------------------------- 5 quality


def test_quality_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_additive(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    assert np.all(quality.AdditiveModel().score(x[:3]) == 0.5)


def test_quality(spark, small):
    docs = spark.createDataFrame([(i, ("Good words make a line.\n" if i % 2 else "!! ### | ") * (3 + i % 5), "en", "s", 1) for i in range(120)] + [(500, None, None, None, 0), (501, "", None, None, 0)], DDL)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs.withColumn("score", F.lit("clash")), quality.fit_quality(docs, labels)).collect()}
    assert min(got[i] for i in range(120) if i % 2) > 0.7 > 0.3 > max(got[i] for i in range(120) if i % 2 == 0)
    assert got[500] == got[501]
    none = quality.score_quality(docs, quality.fit_quality(docs, labels.limit(0)))
    assert {r["score"] for r in none.collect()} == {0.5}


# ---------------------------------------------------------------- 6 toxicity


def within(a, b, k):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1] if row[-1] <= k else 99


def test_automata_accept_what_edit_distance_allows():
    terms = ["moron", "scum", "disgusting", "morons"]
    lexicon = toxicity.FuzzyLexicon(terms, [])
    rng = random.Random(1)
    for _ in range(2000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            roll = rng.random()
            if roll < 0.4 and at < len(word):
                word[at] = rng.choice("mornxs")
            elif roll < 0.7:
                word.insert(at, rng.choice("mornxs"))
            elif at < len(word) and len(word) > 1:
                del word[at]
        word = "".join(word)
        assert lexicon.match(word) == min(within(word, t, toxicity.edits_allowed(t)) for t in terms)


def test_stems_match_beginnings():
    lexicon = toxicity.FuzzyLexicon([], ["lowei", "chlla"])
    assert lexicon.match("loweichen") == 0
    assert lexicon.match("lowe") == 99
    assert lexicon.match("xlowei") == 99


def test_quotation_counts_less():
    lexicon, known = toxicity.FuzzyLexicon(["idiot"], []), {}
    x = lambda t: dict(zip(toxicity.FEATURES, toxicity.context_features(t, lexicon, known), strict=True))
    assert x("you are an idiot")["addressed"] > 0
    assert x('the word "idiot" is an insult')["quoted"] > 0
    assert x('the word "idiot" is an insult')["exact"] == 0
    assert x("an idi0t")["any_edited"] == 1
    assert not any(x("").values())
    model = toxicity.ToxicityModel()
    a, b = (model.score(toxicity.context_features(t, lexicon, known)[None])[0] for t in ("you idiot", 'he wrote "idiot" there'))
    assert a > b


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(200):
        words = [rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(("moron", "grobian" + rng.choice("abc")))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None, None, None, 0)], DDL).withColumn("score", F.lit("clash"))
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(s.startswith("grob") for s in model.stems + model.terms)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, t in labels)
    assert got[900] < 0.3
    assert toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).terms == sorted(toxicity.TERMS)


# ---------------------------------------------------------------- 7 language model


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(3)
    for n, top in ((0, 10), (1, 1 << 40), (1000, 1500), (5000, 1 << 50), (300, 1 << 64)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=False)) if n else np.zeros(0, np.uint64)
        s = EliasFano(values, top, tmp_path, f"x{n}-{top}")
        if len(values):
            assert (s.find(values) == np.arange(len(values))).all()
        others = np.setdiff1d(rng.integers(0, top, 200, dtype=np.uint64, endpoint=False), values)
        assert (s.find(others) == -1).all()


def test_elias_fano_gets_and_searches_between(tmp_path):
    values = np.sort(np.random.default_rng(5).integers(0, 5000, 3000, dtype=np.uint64))
    s = EliasFano(values, 5000, tmp_path, "y")
    assert (s.get(np.arange(3000)) == values).all()
    distinct = np.unique(values)
    t = EliasFano(distinct, 5000, tmp_path, "z")
    at = np.arange(len(distinct))
    assert (t.find(distinct, at, at + 1) == at).all()
    assert (t.find(distinct, at + 1, at + 3) == -1).all()


def test_language_model_of_one_very_long_text(spark):
    n = (1 << 21) + 5000
    docs = spark.createDataFrame([(0, " ".join(map(str, range(n)))), (2, "1 2 x"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_model.score_texts(docs, F.col("doc_id") < 2).collect()}
    assert (got[0]["n_tokens"], got[0]["n_known"], got[0]["train_tokens"]) == (n + 1, n + 1, n + 1)
    assert (got[2]["n_tokens"], got[2]["n_known"]) == (4, 3)
    mass = n + 1 + 0.5 * (n + 2)
    assert got[0]["base_score"] == pytest.approx((n + 1) * math.log10(1.5 / mass), rel=1e-9)


def test_language_model_beats_word_frequencies(spark, small):
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = language_model.score_texts(docs, language_model.training_rows()).where("held_out and n_tokens > 1").collect()
    assert sum(r["score"] > r["base_score"] for r in got) > 0.75 * len(got)
    none = language_model.score_texts(docs.limit(5), F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in none} == {(0, 0)}
    assert language_model.score_texts(docs.limit(0), language_model.training_rows()).count() == 0


def test_language_model(spark):
    texts = sample_texts(80, seed=6)
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id in (1, 11)")).withColumn("train", F.lit("clash"))
    tokens = {i: [w.lower() for w in words_of(t)] + [None] for i, t in enumerate(texts)}
    rows = [r["doc_id"] for r in docs.select("doc_id").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c, pairs, before = collections.Counter(), collections.Counter(), collections.Counter()
    for i in rows:
        if not held[i]:
            c.update(tokens[i])
            pairs.update(zip(["<"] + tokens[i][:-1], tokens[i], strict=True))
            before.update(["<"] + tokens[i][:-1])
    n = sum(c.values())
    mass = n + 0.5 * (len(c) + 1)
    got = language_model.score_texts(docs, language_model.training_rows()).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        t = tokens[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.5) / mass) for w in t)
        two = sum(math.log10((pairs[v, w] + language_model.MASS * (c[w] + 0.5) / mass) / (before[v] + language_model.MASS)) for v, w in zip(["<"] + t[:-1], t, strict=True))
        most = max(base, two)
        score = most + math.log10(0.5 * 10 ** (base - most) + 0.5 * 10 ** (two - most))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-8)
        assert r["score"] == pytest.approx(score, abs=1e-3 * len(t))


# ---------------------------------------------------------------- 8 fixity


def test_fixity(spark):
    rows = [(i * 37 - 500, f"record {i}" * (i % 5 + 1)) for i in range(400)]
    ours = spark.createDataFrame(rows, "key long, value string")
    theirs = spark.createDataFrame([(k, "x" if k == rows[7][0] else v) for k, v in rows if k != rows[100][0]] + [(10**6, "extra")], "key long, value string")
    got = {r["key"]: r for r in fixity.audit(ours, theirs).collect()}
    assert {k: r["fault"] for k, r in got.items()} == {rows[7][0]: "changed", rows[100][0]: "missing", 10**6: "extra"}
    sizes = [len(v) + 4 for _, v in rows]
    assert got[rows[7][0]]["offset"] == sum(sizes[:7])
    assert got[rows[100][0]]["offset"] == sum(sizes[:100])
    assert got[10**6]["offset"] == sum(sizes)
    assert got[rows[7][0]]["compared"] < 400
    assert fixity.audit(ours, ours).count() == 0
    assert fixity.audit(ours.limit(0), ours.limit(0)).count() == 0
    twice = ours.unionByName(ours.limit(1)).unionByName(spark.createDataFrame([(None, "x")], "key long, value string"))
    assert fixity.audit(twice, ours).count() == 1


def test_fixity_of_null_values(spark):
    ours = spark.createDataFrame([(1, None, 0), (2, "x", 0), (3, "", 0), (4, None, 0)], "key long, value string, hash int")
    theirs = spark.createDataFrame([(1, "x", 0), (2, None, 0), (3, None, 0), (4, None, 0), (5, None, 0)], "key long, value string, bytes int")
    assert {r["key"]: r["fault"] for r in fixity.audit(ours, theirs).collect()} == {1: "changed", 2: "changed", 3: "changed", 5: "extra"}


def test_warc_round_trip(spark, tmp_path, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").unionByName(spark.createDataFrame([(10**6, None, None)], "page_id long, url string, html string"))
    fixity.write_warc(pages, str(tmp_path / "warc"))
    back = {r["record_id"]: r for r in fixity.read_warc(spark, str(tmp_path / "warc" / "part-*")).collect()}
    for r in pages.collect():
        found = back[f"<urn:page:{r['page_id']}>"]
        assert bytes(found["body"]).decode() == (r["html"] or "")
        assert found["url"] == (r["url"] or "")


# ---------------------------------------------------------------- 9 fingerprints


def test_fingerprints(spark):
    texts = sample_texts(40, seed=9) + ["x" * 5000, "𝔘nicode ñ " * 40]
    docs = documents(spark, texts).repartition(7).unionByName(spark.createDataFrame([(None, "no id", None, None, 0)], DDL))
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs.withColumn("kind", F.lit(1))).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        edited = fingerprint.edited(t, following)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.fingerprint(t), fingerprint.fingerprint(edited))
        assert r["near_next"] == fingerprint.likeness(fingerprint.fingerprint(t), fingerprint.fingerprint(following))
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
    only = fingerprint.fingerprints(spark.createDataFrame([(4, "abcdefgh", None, None, 0)], DDL)).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert only["near_next"] == 1.0


def test_common_extension_is_found_to_within_a_mark():
    rng = random.Random(7)
    for n in (0, 1, 20, 33, 500, 5000):
        a = "".join(rng.choice("abcdefgh ") for _ in range(n))
        for keep in (0, n // 3, 3 * n // 4, n):
            b = a[:keep] + "".join(rng.choice("ijk") for _ in range(rng.randint(0, n)))
            true = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            x, y = fingerprint.fingerprint(a), fingerprint.fingerprint(b)
            found = fingerprint.common_extension(x, y)
            step = max(fingerprint.mark_step(len(a)), fingerprint.mark_step(len(b)))
            assert true - step < found <= true or a == b
            assert fingerprint.likeness(x, y) >= 2 * found / max(1, len(a) + len(b)) - 1e-9
            assert fingerprint.prefix_marks(fingerprint.codes(a) + 1).tolist() == [int(fingerprint.mix(np.array([fingerprint.PrefixHashes(a).span(0, p)[0]], np.uint64))[0]) & 0xFFFF for p in range(fingerprint.mark_step(n), n + 1, fingerprint.mark_step(n))]


def test_fingerprints_of_repeated_ids(spark):
    rows = [(1, "b" * 40), (1, "a" * 40), (1, "b" * 40), (2, "c" * 40), (2, "d" * 40), (None, "e"), (None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in fingerprint.fingerprints(docs).collect())
    first = {1: min(("a" * 40, "b" * 40), key=lambda t: packed(t)), 2: min(("c" * 40, "d" * 40), key=lambda t: packed(t))}
    after = {1: first[2], 2: first[1]}
    want = sorted((i or 0, len(t), hashlib.sha256(fingerprint.edited(t, after.get(i, "")).encode()).hexdigest()) for i, t in rows)
    assert got == want


def packed(text):
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(text.encode())


def test_prefix_hashes():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 60))) for _ in range(2))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert fingerprint.PrefixHashes(a).agree(i, fingerprint.PrefixHashes(b), j) == n


def test_chunks_do_not_show(monkeypatch):
    text = "".join(random.Random(2).choice("abcdefg ") for _ in range(3000))
    whole = fingerprint.fingerprint(text)
    monkeypatch.setattr(fingerprint, "_CHUNK", 100)
    assert fingerprint.fingerprint(text) == whole


# ---------------------------------------------------------------- 10 repeats


def brute_repeats(texts, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                keep[j : j + window] = [False] * window
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "window", "phrase"), [(1, 50, 16), (2, 9, 4)])
def test_repeats(spark, monkeypatch, seed, window, phrase):
    monkeypatch.setattr(repeats, "SPLIT", 5)
    texts = sample_texts(120, seed)
    docs = documents(spark, texts).withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in repeats.remove_repeats(docs, window, phrase, digest=True).collect()}
    assert got == brute_repeats(list(enumerate(texts)), window)
    kept = {r["doc_id"]: r for r in repeats.remove_repeats(docs, window, phrase).collect()}
    for i, t in enumerate(texts):
        if not kept[i]["n_removed"]:
            assert kept[i]["text"] == t
        else:
            assert hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", kept[i]["text"])).encode()).hexdigest() == got[i][2]


def test_repeats_edges(spark):
    p = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, p, None, None, 0), (2, p, None, None, 0), (2, p, None, None, 0), (-1, p, None, None, 0)], DDL)
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in repeats.remove_repeats(docs).collect())
    assert got == [("-1", 0), ("2", 60), ("2", 60), ("None", 0)]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_of_hot_passages(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    hot, other = [word() for _ in range(70)], [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(rng.randint(0, 30))] + (hot if i % 2 else other if i % 5 == 0 else []) + [word() for _ in range(rng.randint(0, 30))]) for i in range(900)]
    docs = documents(spark, texts).repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in repeats.remove_repeats(docs, digest=True).collect()}
    assert got == brute_repeats(list(enumerate(texts)), 50)


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 1 << 60, 200, dtype=np.uint64)
    for w in (1, 2, 7, 35, 200):
        assert (repeats.sliding_least(x, w) == np.array([x[i : i + w].min() for i in range(200 - w + 1)])).all()
    assert len(repeats.sliding_least(x, 201)) == 0


# ---------------------------------------------------------------- bounds and whole words


def test_samples_are_bounded_though_one_id_has_all_rows(spark):
    docs = spark.range(30_000).select(F.when(F.col("id") < 29_000, 4).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    labels = spark.createDataFrame([(i, i % 2) for i in (4, *range(29_000, 29_020))], "doc_id long, quality int")
    sample = common.labelled_sample(docs, labels, "quality", 500)
    assert zlib.crc32(b"4") % 4 != 2
    assert 300 < sample.count() < 700
    taught = language.fit_language(docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 50).cast("string"))), per_language=30, languages=10)
    assert len(taught.langs) <= 10


def test_short_items_stand_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "the party starts"), (2, "an ART show"), (3, "art"), (4, "start art."), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "Art"), (8, "")], "item_id long, text string").withColumns({c: F.lit(1) for c in ("number", "hits", "end", "doc_id")})
    got = {r["doc_id"]: (r["distance"], r["hits"]) for r in decontaminate.benchmark_hits(docs.withColumn("item_id", F.lit("x")), items).collect()}
    assert got == {2: (0, 1), 3: (0, 1), 4: (0, 1)}
    assert [r["doc_id"] for r in decontaminate.without_items(docs, items).orderBy("doc_id").collect()] == [1, 5]
