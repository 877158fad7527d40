"""Vectors, choices and clusters against plain Python, on the real tables and on ragged and empty ones."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.operators import clustering, pivots, vectors
from lumengrid.plans import queries as plans
from lumengrid.plans import roles


def cosine(a, b):
    return max(-1.0, min(1.0, math.fsum(x * y for x, y in zip(a, b, strict=True))))


@pytest.fixture(scope="module")
def faces(spark, small):
    return [(r["id"], r["media_id"], r["person_id"], [float(x) for x in r["embedding"]]) for r in roles.vectors(spark, small).orderBy("id").collect()]


def plain_choice(frame, library, threshold, margin):
    """frame: (id, vector) in order; library: person to vectors."""
    table = {i: sorted(((max(cosine(v, w) for w in ws), p) for p, ws in library.items()), key=lambda x: (-x[0], x[1])) for i, v in frame}
    offers = sorted(((-s, n, rank, i, p) for n, (i, _) in enumerate(frame) for rank, (s, p) in enumerate(table[i][:3]) if s >= threshold))
    out = {}
    for minus, _, _, i, p in offers:
        used = {q for q, _ in out.values()}
        if i in out or p in used:
            continue
        if len(table[i]) > 1 and -minus - table[i][1][0] < margin:
            free = [s for s, q in table[i] if q != p and q not in used]
            if not used or (free and -minus - max(free) < margin):
                continue
        out[i] = (p, -minus)
    return out


def test_match_frame(spark, small, faces):
    library = collections.defaultdict(list)
    for _, _, person, v in faces:
        if person is not None:
            library[person].append(v)
    frames = collections.defaultdict(list)
    for i, medium, person, v in faces:
        if person is None:
            frames[medium].append((i, v))
    want = {}
    for frame in frames.values():
        want |= plain_choice(frame, library, 0.25, 0.02)
    got = {r["id"]: (r["person_id"], r["similarity"]) for r in plans.QUERIES["match_frame"](spark, small).collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert all(got[i][1] == pytest.approx(s, abs=1e-6) for i, (_, s) in want.items())


def plain_clusters(rows, cfg):
    """rows: (id, vector) in order. Labels, merging and sizes, over all faces at once."""
    n = len(rows)
    sims = [[cosine(a, b) if i != j else -2 for j, (_, b) in enumerate(rows)] for i, (_, a) in enumerate(rows)]
    links = collections.defaultdict(dict)
    for i in range(n):
        for j in sorted(range(n), key=lambda j: (-sims[i][j], j))[: cfg.neighbours]:
            if sims[i][j] >= cfg.edge:
                links[i][j] = links[j][i] = sims[i][j]
    label = list(range(n))
    for turn in clustering.shuffled_turns(n, cfg.iterations):
        old = list(label)
        for i in sorted(range(n), key=lambda i: turn[i]):
            votes = collections.Counter()
            for j in sorted(links[i], key=lambda j: (-links[i][j], j)):
                votes[label[j]] += links[i][j]
            if votes:
                label[i] = min(votes, key=lambda x: (-votes[x], x))
        if label == old:
            break
    groups = collections.defaultdict(list)
    for i, x in enumerate(label):
        groups[x].append(i)

    def middle(g):
        total = [math.fsum(rows[i][1][d] for i in g) for d in range(len(rows[0][1]))]
        size = math.sqrt(sum(x * x for x in total))
        return [x / size for x in total]

    merged = []
    for g in sorted((g for g in groups.values() if len(g) > 1), key=min):
        home = next((m for m in merged if cosine(middle(m), middle(g)) >= cfg.merge), None)
        merged.append(g) if home is None else home.extend(g)
    return sorted((sorted(m) for m in merged if len(m) >= cfg.min_size), key=lambda m: (-len(m), m[0]))


def test_cluster_faces(spark, small, faces):
    cfg = clustering.ClusterSettings(edge=0.30)
    shoots = collections.defaultdict(list)
    for i, medium, _, v in faces:
        shoots[medium % 4].append((i, v))
    want = {(shoot, rows[i][0]): (n, len(c)) for shoot, rows in shoots.items() for n, c in enumerate(plain_clusters(rows, cfg)) for i in c}
    got = {(r["shoot_id"], r["id"]): (r["cluster"], r["size"]) for r in plans.QUERIES["cluster_faces"](spark, small).collect()}
    assert len(got) == len(faces)
    assert {k: v for k, v in got.items() if v[0] is not None} == want


def known_turns(n, rounds):
    """The turns by the published rule of the generator: shifts 12, 25 and 27, then a product modulo 2**64."""
    x, order, out = 0x5EED1234ABCD0001, list(range(n)), []
    for _ in range(rounds):
        for last in reversed(range(1, n)):
            x = (x ^ (x >> 12)) % 2**64
            x = (x ^ (x << 25)) % 2**64
            x = (x ^ (x >> 27)) % 2**64
            pick = x * 2685821657736338717 % 2**64 % (last + 1)
            order[last], order[pick] = order[pick], order[last]
        out.append([order.index(i) for i in range(n)])
    return out


def test_the_generator_is_the_known_one():
    for n in (1, 2, 5, 40):
        assert [t.tolist() for t in clustering.shuffled_turns(n, 6)] == known_turns(n, 6)


def looks_like_persons(n, persons, noise, seed, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(persons, dim))
    v = centres[rng.integers(0, persons, n)] / np.sqrt(dim) + noise * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize(("noise", "least"), [(0.05, 0.8), (0.3, 0.5), (0.05, -0.2)])
def test_pruned_pairs_lose_nothing(spark, monkeypatch, noise, least):
    x = looks_like_persons(500, 12, noise, 5)
    x[7:9] = 0
    x[20] *= 3
    df = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(x)], "group long, id long, embedding array<double>")
    near = np.clip(x @ x.T, -1, 1)
    want = set()
    for i in range(500):
        mine = sorted((j for j in range(500) if j % 2 == i % 2 and j != i and near[i, j] >= least), key=lambda j: (-near[i, j], j))[:4]
        want |= {(i, j) for j in mine} | {(j, i) for j in mine}
    monkeypatch.setattr(pivots, "BLOCK_NUMBERS", 8 * 30)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 30)
    monkeypatch.setattr(pivots, "_SLICE", 100)
    got = vectors.neighbours_within(df, 4, least).collect()
    assert {(r["src"], r["dst"]) for r in got} == want and len(got) == len(want)
    kept = pivots.pruning(df, least).first()
    assert kept["kept"] < kept["pairs"] if noise < 0.1 and least > 0 else kept["kept"] <= kept["pairs"]


@pytest.mark.parametrize("seed", [1, 2])
def test_waves_and_chains_equal_the_order(spark, monkeypatch, seed):
    x = looks_like_persons(160, 9, 0.22, seed, dim=4)
    rows = list(enumerate(x.tolist()))
    cfg = clustering.ClusterSettings(edge=0.6, neighbours=3, merge=0.7, min_size=2)
    want = {rows[i][0]: (n, len(c)) for n, c in enumerate(plain_clusters(rows, cfg)) for i in c}
    df = spark.createDataFrame([(1, i, v) for i, v in rows], "shoot_id long, id long, embedding array<double>")
    monkeypatch.setattr(pivots, "BLOCK_NUMBERS", 4 * 20)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 20)
    for small in (clustering.SMALL, 10):
        got = {r["id"]: (r["cluster"], r["size"], r["cohesion"]) for r in clustering.cluster_faces(df, cfg, small=small).where("cluster is not null").collect()}
        assert {i: g[:2] for i, g in got.items()} == want
        one = [i for i, g in got.items() if g[0] == 0]
        middle = x[one].sum(axis=0) / np.linalg.norm(x[one].sum(axis=0))
        assert got[one[0]][2] == pytest.approx(float((x[one] @ middle).mean()))


def test_chains_hold_all_that_join(spark):
    # directions that drift as groups join, with ties, in three dimensions
    rng = np.random.default_rng(11)
    totals = rng.normal(size=(300, 3)) * rng.integers(1, 9, size=(300, 1))
    totals[50:60] = totals[40:50]
    groups = spark.createDataFrame([(g, i, i, t.tolist()) for g in (1, 2) for i, t in enumerate(totals[: 300 // g])], "group long, label long, first long, total array<double>")
    for threshold in (0.97, 0.62, 1.0):
        got = {(r["group"], r["label"]): r["into"] for r in clustering.merged_groups(groups, threshold).collect()}
        assert got == {(g, i): int(j) for g in (1, 2) for i, j in enumerate(clustering.first_fit(totals[: 300 // g], threshold))}


def test_ragged_and_missing_vectors(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [0.9, 0.1]), (3, 1, [1.0, 0.0, 0.0]), (4, 1, None), (5, 1, []), (6, 2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, shoot_id long, embedding array<float>")
    assert {(r["src"], r["dst"]) for r in vectors.neighbours(df, 3, 0.5).collect()} == {(1, 2), (2, 1), (1, 6), (6, 1), (2, 6), (6, 2)}
    library = spark.createDataFrame([(7, [1.0, 0.0]), (7, None), (8, [0.0, 1.0, 0.0])], "person_id long, embedding array<float>")
    assert {(r["id"], r["person_id"]) for r in vectors.matches(df, library, 0.4, 0.05).collect()} == {(1, 7), (2, 7), (6, 7)}
    got = {r["id"]: r["cluster"] for r in clustering.cluster_faces(df.where("id <> 3"), clustering.ClusterSettings(min_size=2)).collect()}
    assert got == {1: 0, 2: 0, 4: None, 5: None, 6: None}
    none = df.limit(0)
    assert vectors.neighbours(none).count() == 0
    assert clustering.match_frames(none.withColumnRenamed("shoot_id", "media_id"), library).count() == 0
    assert vectors.neighbours(df, 0).count() == 0


def test_choice_rules(spark):
    def choose(scores, **settings):
        rows = [(0, face, p, s, rank) for face, persons in scores.items() for rank, (p, s) in enumerate(persons, 1)]
        df = spark.createDataFrame(rows, "frame long, id long, person_id long, similarity double, rank int")
        return {r["id"]: r["person_id"] for r in clustering.unique_choices(df, clustering.MatchSettings(**settings)).collect()}

    # within the margin and nobody taken: skipped for good
    assert choose({1: [(1, 0.9), (2, 0.88)]}) == {}
    # within the margin, but the runner-up is taken by then
    assert choose({1: [(2, 0.95), (1, 0.2)], 2: [(1, 0.9), (2, 0.88)]}) == {1: 2, 2: 1}
    # within the margin of somebody still free
    assert choose({1: [(2, 0.95), (1, 0.2)], 2: [(1, 0.9), (3, 0.88)]}) == {1: 2}
    assert choose({1: [(1, 0.41)]}) == {}


def test_blocks_do_not_show(spark, small, monkeypatch):
    v = roles.vectors(spark, small)
    whole = {(r["src"], r["dst"]) for r in vectors.neighbours(v, 3, 0.3).collect()}
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 64 * 15)
    monkeypatch.setattr(pivots, "BLOCK_NUMBERS", 64 * 15)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 15)
    assert {(r["src"], r["dst"]) for r in vectors.neighbours(v, 3, 0.3).collect()} == whole
    best = {(r["id"], r["person_id"], r["rank"]) for r in vectors.best_persons(v.where("person_id is null"), v.where("person_id is not null"), 3, slack=0.05).collect()}
    monkeypatch.undo()
    assert best == {(r["id"], r["person_id"], r["rank"]) for r in vectors.best_persons(v.where("person_id is null"), v.where("person_id is not null"), 3, slack=0.05).collect()}


def test_centroids(spark):
    df = spark.createDataFrame([(1, 1, [3.0, 0.0]), (1, 2, [0.0, 4.0]), (1, 3, [9.0]), (2, 4, [0.0, 0.0])], "g long, id long, embedding array<float>")
    got = {r["g"]: (r["centroid"], r["size"]) for r in vectors.centroids(df, "g").collect()}
    assert got[1] == (pytest.approx([0.6, 0.8]), 2)
    assert got[2] == ([0.0, 0.0], 1)
    tight = {r["g"]: r["cohesion"] for r in vectors.cohesion(df.where("id < 3").withColumn("embedding", F.col("embedding")), "g").collect()}
    assert set(tight) == {1}


def test_labels_by_shoot_and_in_waves_are_the_same(spark, monkeypatch):
    x = looks_like_persons(160, 9, 0.22, 1, dim=4)
    rows = list(enumerate(x.tolist()))
    cfg = clustering.ClusterSettings(edge=0.6, neighbours=3, merge=0.7, min_size=2)
    want = {rows[i][0]: (n, len(c)) for n, c in enumerate(plain_clusters(rows, cfg)) for i in c}
    df = spark.createDataFrame([(1, i, v) for i, v in rows], "shoot_id long, id long, embedding array<double>")
    took = []
    for name in ("spread_by_shoot", "_in_waves"):
        monkeypatch.setattr(clustering, name, lambda *a, name=name, f=getattr(clustering, name): took.append(name) or f(*a))
    for held in (160, 10):
        got = {r["id"]: (r["cluster"], r["size"]) for r in clustering.cluster_faces(df, cfg, small=10, held=held).where("cluster is not null").collect()}
        assert got == want
    assert took == ["spread_by_shoot", "_in_waves"]


def test_waves_broadcast_no_labels(spark, monkeypatch):
    links = spark.createDataFrame([(1, i, j, 5) for i in range(60) for j in range(60) if 0 < abs(i - j) < 3], "group long, src long, dst long, weight long")
    turns = spark.createDataFrame([(1, i, i, [(i * 7 + r) % 60 for r in range(3)]) for i in range(60)], "group long, id long, place long, turns array<int>")
    plans, write = [], clustering.written
    monkeypatch.setattr(clustering, "written", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
    got = {r["place"]: r["label"] for r in clustering.spread_in_waves(links, turns, 3).collect()}
    pairs = np.array([(i, j) for i in range(60) for j in range(60) if 0 < abs(i - j) < 3])
    order = [np.array([(i * 7 + r) % 60 for i in range(60)]) for r in range(3)]
    assert [got[i] for i in range(60)] == clustering.spread(60, pairs[:, 0], pairs[:, 1], np.full(len(pairs), 5.0), order).tolist()
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


@pytest.mark.parametrize("most", [1, 4])
def test_nearest_of_copies(most):
    """Each product serves both rows; of equal ones the lower ids come first and no more than asked are kept."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 5)).round(1)
    x[100:400] = x[7]
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = rng.permutation(700)
    near = np.clip(x @ x.T, -1, 1).round(9)
    vectors_of = {int(i): v for i, v in zip(ids, near, strict=True)}

    def plain(own, keys):
        at = {int(i): n for n, i in enumerate(ids)}
        return {(i, j) for i in own for j in sorted((j for j in keys if j != i and vectors_of[i][at[j]] >= 0.3), key=lambda j: (-vectors_of[i][at[j]], j))[:most]}

    def got(found):
        assert len(found[0]) == len(set(zip(*found[:2], strict=True)))
        return collections.Counter(int(i) for i in found[0])

    every = [int(i) for i in ids]
    want = collections.Counter(i for i, _ in plain(every, every))
    assert got(vectors.near_within(ids, x, most, 0.3)) == want
    a, b = every[:300], every[300:]
    want = collections.Counter(i for i, _ in plain(a, b) | plain(b, a))
    assert got(vectors.near_between(ids[:300], x[:300], ids[300:], x[300:], most, 0.3)) == want


def test_tiles_send_a_vector_to_fewer_tasks(spark, monkeypatch):
    """Directions without persons can't be told apart by pivots: every block meets every other, but a vector isn't sent for each."""
    x = np.random.default_rng(4).normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "group long, id long, embedding array<double>")
    monkeypatch.setattr(pivots, "BLOCK_NUMBERS", 12 * 100)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 100)
    sent, pairs = pivots.met_in_tiles(df, 0.3)
    assert sent.groupBy("id").count().agg(F.max("count")).first()[0] <= 5
    assert pivots.met(df, 0.3)[0].count() > 2 * sent.count()
    near = np.clip(x @ x.T, -1, 1)
    np.fill_diagonal(near, -2)
    want = {(i, int(j)) for i in range(400) for j in np.argsort(-near[i])[:5] if near[i, j] >= 0.3}
    got = {(r["src"], r["dst"]): r["similarity"] for r in vectors.neighbours_within(df, 5, 0.3).collect()}
    assert set(got) == want | {(j, i) for i, j in want}
    assert all(s == pytest.approx(near[p], abs=1e-12) for p, s in got.items())


@pytest.mark.parametrize("length", [1.0, 1e-18, 1e10, 1e30])
def test_short_products_decide_nothing(length):
    """Nearness that differs in the last places only, and lengths beyond the range of short floats."""
    rows, keys = np.array([[length, 0.0]]), np.array([[1.0, 0.0], [1.0, 1e-5], [0.6, 0.8], [0.6 - 1e-12, 0.8]]) / length
    i, j, found = vectors.near_between(np.array([0]), rows, np.arange(1, 5), keys, 9, 0.6 - 5e-13)
    assert {int(b): s for a, b, s in zip(i, j, found, strict=True) if a == 0} == {1: pytest.approx(1), 2: pytest.approx(1), 3: pytest.approx(0.6)}
    rows = np.random.default_rng(8).normal(size=(300, 2)) * 1e-9 + [1.0, 0.0]
    plain = rows @ rows.T - 2e9 * np.eye(300)
    i, j, _ = vectors.near_within(np.arange(300), rows, 1, 0.5)
    best = dict(zip(i.tolist(), j.tolist(), strict=True))
    assert all(min(plain[a, best[a]], 1) >= min(plain[a].max(), 1) - 1e-15 for a in range(300))


@pytest.mark.parametrize("threshold", [0.3, 0.62, 0.95])
def test_groups_meet_heads_in_runs(threshold):
    rng = np.random.default_rng(13)
    sums = rng.normal(size=(700, 4)) * rng.integers(1, 9, size=(700, 1))
    sums[500:520], sums[40] = sums[480:500], 0
    unit = lambda v: v / n if (n := np.linalg.norm(v)) > 1e-12 else v
    heads, want = {}, []
    for i, total in enumerate(sums):
        at = next((h for h, held in heads.items() if unit(held) @ unit(total) >= threshold), i)
        heads[at] = heads.get(at, 0) + total
        want.append(at)
    assert clustering.first_fit(sums, threshold).tolist() == want


def test_lengths_of_sums_are_worked_out_once(spark, monkeypatch):
    """Groups' directions come from a task's arrays, not from a sum over the vector for each of its numbers."""
    groups = spark.createDataFrame([(1, 1, 1, [3.0, 4.0]), (1, 2, 2, [0.0, 0.0]), (1, 3, 3, [2.0]), (2, 4, 4, [0.0, -5.0])], "group long, label long, first long, total array<double>")
    seen, meet = [], clustering.met
    monkeypatch.setattr(clustering, "met", lambda units, least: seen.append(units) or meet(units, least))
    assert {(r["label"], r["into"]) for r in clustering.merged_groups(groups, 0.62).collect()} == {(n, n) for n in (1, 2, 3, 4)}
    assert {r["id"]: r["embedding"] for r in seen[0].collect()} == {1: [pytest.approx(0.6), pytest.approx(0.8)], 2: [0.0, 0.0], 3: [1.0], 4: [0.0, -1.0]}
    assert "aggregate(" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_lengths_of_centroids_are_worked_out_once(spark):
    df = spark.createDataFrame([(1, 1, [3.0, 0.0]), (1, 2, [0.0, 4.0]), (2, 4, [0.0, 0.0])], "g long, id long, embedding array<double>")
    found = vectors.centroids(df, "g")
    assert {r["g"]: r["centroid"] for r in found.collect()} == {1: [pytest.approx(0.6), pytest.approx(0.8)], 2: [0.0, 0.0]}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
