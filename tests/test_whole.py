"""Queries of the media index do the whole job: against plain Python on tables made for it."""

import random

import pytest

from lumengrid.operators import export
from lumengrid.plans import queries as plans
from lumengrid.scratch import numbered


def test_box_overlaps_has_every_order(spark, tmp_path):
    rows = [(o, p, float((o * 7 + p * 3) % 20), ((o + p) % 5) / 100) for o in range(1, 30) for p in range(1, 1 + o % 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for o, p, q, d in rows:
        for o2, p2, q2, d2 in rows:
            if o == o2 and p < p2:
                i = max(30 - abs(q - q2) * 2, 0) * max(30 - abs(d - d2) * 400, 0)
                n, total = want.get(o, (0, 0.0))
                want[o] = n + 1, total + i / (1800 - i)
    got = {r["l_orderkey"]: (r["pairs"], r["total_iou"]) for r in plans.QUERIES["box_overlaps"](spark, str(tmp_path)).collect()}
    assert {o: n for o, (n, _) in got.items()} == {o: n for o, (n, _) in want.items()}
    assert all(got[o][1] == pytest.approx(t, abs=2e-6) for o, (_, t) in want.items())


def test_frame_plan_intervals_has_every_order(spark, tmp_path):
    prices = [0.0, 900.0, 299_999.0, 300_000.0, 301_000.0, 499_999.0]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["id"]: r["n"] for r in plans.QUERIES["frame_plan_intervals"](spark, str(tmp_path)).collect()}
    assert got == {i: max(1, -(-int(p // 1000) // 5)) for i, p in enumerate(prices)}


def test_nms_on_every_order(spark, small):
    items = spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_discount", "l_extendedprice").collect()
    frames = {}
    for r in items:
        x, y = float(r["l_quantity"]) * 2, float(r["l_discount"]) * 400
        frames.setdefault(r["l_orderkey"], []).append((x, y, x + 30, y + 30, float(r["l_extendedprice"]) / 1e5))

    def overlap(a, b):
        i = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        return i / (1800 - i)

    want = set()
    for order, boxes in frames.items():
        kept = []
        for b in sorted(sorted(boxes), key=lambda b: -b[4]):
            if all(overlap(k, b) <= 0.4 for k in kept) and len(kept) < 64:
                kept.append(b)
        want |= {(order, round(b[0], 4), round(b[1], 4), round(b[4], 6)) for b in kept}
    got = [(r["l_orderkey"], round(r["x1"], 4), round(r["y1"], 4), round(r["score"], 6)) for r in plans.QUERIES["nms"](spark, small).collect()]
    assert set(got) == want


def test_names_that_look_like_copies(spark):
    rng = random.Random(2)
    names = ["a.jpg", "A.JPG", "a (2).jpg", "a (3).jpg", "a (2) (2).jpg", "b", "b (2)", ".hidden", ".hidden (2)", "c.d.e", "a.png", "x (2).jpg"]
    rows = [(i, i % 3, rng.choice(names)) for i in range(120)]
    want, taken = {}, {}
    for i, scope, name in rows:
        want[i] = export.free_name(name, taken.setdefault(scope, set()))
    df = spark.createDataFrame(rows, "id long, scope long, filename string").repartition(3)
    assert {r["id"]: r["target"] for r in export.deduplicated(df, ["scope"], ["id"]).collect()} == want


def test_rows_are_numbered_in_order(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "k long, v long").repartition(5)
    assert {r["k"]: r["n"] for r in numbered(df, ["k"], "n").collect()} == {k: k + 1 for k in range(1000)}
    assert numbered(df.limit(0), ["k"], "n").count() == 0
