"""Shards by slots, divergence of sources and the Merkle manifest against plain Python, on hostile tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.llm import divergence, manifest, queries, slots

DDL = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["size", "shard", "slot", "n", "id", "tree", "leaf", "root", "term", "count", "part", "value", "virtual", "_salt", "first", "path"]


def hostile():
    rng = random.Random(7)
    words = ["Ab", "été", "ÉTÉ", "x1y", "_", "zz", "naïve", "Straße", "a-b", "日本", "K"]
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (5, None, "en", "s1", None), (5, "Twice", "en", "s1", 5), (5, "Twice", "en", "s1", 5)]
    rows += [(7, "Hot row A", "en", "hot", 9)] * 80
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "s1", "s2", "ü", None, ""]), i % 9 or None) for i in range(100, 260)]
    rows += [(1000, "Long Word " * 40_000, "fr", "alone", 400_000)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return hostile()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumns({c: F.lit("x") for c in CLASHING})


# ---------------------------------------------------------------- slots


def test_every_row_has_a_place(docs, rows):
    got = slots.sharded(docs, 8).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert set(places) <= set(range(8))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_bytes_are_even_though_one_id_is_hot(spark):
    rows = [(1, f"same id {i:05d}", None, None, None) for i in range(2000)] + [(None, "no id", None, None, None)] * 1500 + [(i, "w" * (i % 50), None, None, None) for i in range(10, 2000)]
    got = slots.sharded(spark.createDataFrame(rows, DDL), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    held = [r["b"] for r in got]
    assert len(held) == 8 and max(held) - min(held) <= 60


def test_reruns_agree(docs):
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(slots.sharded(docs, 8)) == key(slots.sharded(docs.repartition(3), 8))


def test_maps_are_edited_not_made_anew(spark, tmp_path):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("b"), (F.col("id") % 90).cast("int")).alias("text"))
    measured = slots.with_parts(slots.measured(rows), 9)
    loads = slots.slot_loads(measured).cache()
    path = f"file://{tmp_path}/map"
    slots.save_map(slots.next_map(loads, 8), path, 1)
    one = slots.load_map(spark, path)
    slots.save_map(slots.next_map(loads, 9, one), path, 2)
    two = slots.load_map(spark, path)
    assert slots.load_map(spark, path, 1).where("shard = 8").count() == 0
    moved = one.alias("a").join(two.alias("b"), ["virtual", "part"]).where("a.shard <> b.shard")
    total = loads.agg(F.sum("bytes")).first()[0]
    assert total / 9 * 0.8 < moved.agg(F.sum("a.bytes")).first()[0] < total / 9 * 1.2
    held = [r["b"] for r in two.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert len(held) == 9 and max(held) < 1.02 * total / 9
    assert slots.next_map(loads, 9, two).join(two, ["virtual", "part", "shard"]).count() == two.count()
    with pytest.raises(Exception, match="exist"):
        slots.save_map(one, path, 2)


def test_no_python_runs_for_slots(docs):
    plan = slots.sharded(docs, 8)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------- divergence


def brute_divergence(rows, min_docs):
    found = [(lang or "", source or "", [t.encode().lower().decode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {x[0] for x in found}:
        own = [x for x in found if x[0] == lang]
        df = collections.Counter(t for x in own for t in set(x[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        groups = {s: collections.Counter(t for x in own if x[1] == s for t in x[2] if t in set(kept)) for s in {x[1] for x in own}}
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q, p = share(sum(groups.values(), collections.Counter())), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, o, v, k) for k, (o, v) in enumerate(ranked[: 50 if part == "term" else None], 1)]
    return sorted(out)


@pytest.mark.parametrize(("terms", "sources", "min_docs"), [(512, 128, 30), (2, 2, 3), (1, 1, 1)])
def test_divergence(docs, rows, terms, sources, min_docs):
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, min_docs=min_docs, terms=terms, sources=sources).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_divergence(rows, min_docs)


def test_shares_are_exact():
    counts, total = np.array([0, 5, 10**15, 9 * 10**15 - 1]), 9 * 10**15
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * int(c) // total for c in counts]


def test_a_text_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_SLICE", 7)
    text = "Alpha beta, gamma-delta  éclair " * 20
    assert [t for part in divergence.terms_of(text) for t in part] == [t.encode().lower() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]


# ---------------------------------------------------------------- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fan=16):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else t.encode().lower().decode()

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
        return out

    def steps(tree, i):
        for level in tree[:-1]:
            run = level[i // fan * fan : i // fan * fan + fan]
            yield "".join(run[: i % fan]), "".join(run[i % fan + 1 :])
            i //= fan

    groups = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        make = lambda t, i=i, lang=lang, source=source, n=n: sha(*map(field, (i, source, lang, n, t)))
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        groups[source].append(((i is not None, i or 0), make(text), i, make(lower(text)) if hit else None))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for j, (_, value, i, changed) in enumerate(sorted(groups[s], key=lambda x: x[:2])):
            way = [*steps(trees[s], j), *steps(top, k)]
            folded = changed or value
            for left, right in way:
                folded = sha(left, folded, right)
            out.append((i, value, trees[s][-1][0], top[-1][0], sha(*itertools.chain(*way)), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize(("chunk", "joined"), [(8192, 32), (64, 2), (7, 2), (1, 3)])
def test_manifest(spark, rows, docs, chunk, joined):
    got = [tuple(r) for r in manifest.manifest_proofs(docs, chunk, joined).collect()]
    assert collections.Counter(got) == collections.Counter(brute_manifest(rows))


def test_manifest_of_many_sources(spark):
    rows = [(i % 3, f"Text {i}", None, f"s{i * 7919 % 300}" if i % 10 else "big", i) for i in range(700)]
    got = [tuple(r) for r in manifest.manifest_proofs(spark.createDataFrame(rows, DDL), 32, 4).collect()]
    assert collections.Counter(got) == collections.Counter(brute_manifest(rows))


def test_a_single_row(spark):
    rows = [(1, "A", "en", "s", 1)]
    got = [tuple(r) for r in manifest.manifest_proofs(spark.createDataFrame(rows, DDL)).collect()]
    assert got == brute_manifest(rows)
    assert got[0][4] == sha("")


def test_forests_join_in_any_order(spark):
    rng = random.Random(3)
    sizes = [1, 40, 16, 17, 300, 2]
    nodes = [(tree, size, 0, i, sha(str(tree), str(i))) for tree, size in enumerate(sizes) for i in range(size)]

    def forest(some):
        out = manifest.Forest(len(sizes))
        for n in some:
            out.add(*n)
        return out

    whole = list(forest(nodes).nodes())
    assert len(whole) == 1
    for _ in range(20):
        rng.shuffle(nodes)
        cuts = sorted(rng.sample(range(len(nodes)), 6))
        parts = [forest(nodes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(nodes)], strict=True)]
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            parts.append(a.join(b))
        assert list(parts[0].nodes()) == whole


# ---------------------------------------------------------------- all three


@pytest.mark.parametrize("name", ["op11_slots", "op12_divergence", "op13_manifest"])
def test_queries_equal_their_sql(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    with duckdb.connect() as con:
        con.sql(f"create view documents as select * from '{small}/documents.parquet'")
        want = con.sql(queries.ORACLE_SQL[name])
        assert collections.Counter(tuple(r[c] for c in want.columns) for r in df.collect()) == collections.Counter(want.fetchall())


def test_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    for op in (slots.sharded, divergence.source_divergence, manifest.manifest_proofs):
        assert op(none).count() == 0
