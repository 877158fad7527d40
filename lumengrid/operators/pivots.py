"""Pairs of blocks of vectors that can hold similar ones.

Vectors of a group are told by their angles to a few pivots. Neighbouring vectors (same nearest
pivot, like angle to it) make a block. By the triangle inequality two vectors are at least as far
apart as their angles to any pivot differ, so the ranges of two blocks' angles bound the
similarity of all their pairs from above, and pairs of blocks that can't reach what is asked for
are never brought together. Every pair that is left comes once, the lower block first; or pairs of neighbouring blocks
come together, as a tile, so that a vector is sent to fewer tasks and each hands on the best of more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: A block holds about so many numbers at most, and as many rows at least, if it can.
BLOCK_NUMBERS, BLOCK_ROWS = 1 << 21, 2048
#: Neighbouring blocks make one side of a tile up to about so many numbers.
SIDE_NUMBERS = 1 << 20
#: Pivots of a group, and the vectors they are chosen from.
PIVOTS, CANDIDATES = 16, 128
#: Vectors of one call that looks for nearest pivots, and steps of the angle to the nearest.
_SLICE, _RINGS = 1 << 14, 64
#: Angles are told to within this.
_SLACK = 1e-5

_TOLD = "group long, dim int, id long, embedding {}, norm double, cell int, ring int, angles array<float>"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one size as rows."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((v * v).sum(axis=1))
    return v / np.maximum(norm, 1e-300)[:, None], norm


def _chosen(table: pa.Table) -> pa.Table:
    """(group, dim, pivots): of a group's candidates some that lie far apart, each next one farthest from those before."""
    table = table.sort_by("id")
    unit, _ = _units(matrix(table.column("embedding")))
    picked, near = [0], unit @ unit[0]
    while len(picked) < min(PIVOTS, len(unit)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[picked[-1]])
    flat = unit[picked].ravel()
    return pa.table({"group": table.column("group")[:1], "dim": table.column("dim")[:1], "pivots": pa.array([flat.tolist()], pa.list_(pa.float64()))})


def _told(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """A slice of a group's vectors with their nearest pivot and the angles to all."""
    if not rows.num_rows:
        more = [pa.array([], t) for t in (pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float32()))]
        return pa.table([*(rows.column(c) for c in ("group", "dim", "id", "embedding")), *more], names=["group", "dim", "id", "embedding", "norm", "cell", "ring", "angles"])
    unit, norm = _units(matrix(rows.column("embedding")))
    held = np.array(pivots.column("pivots")[0].as_py()).reshape(-1, unit.shape[1])
    angles = np.arccos(np.clip(unit @ held.T, -1, 1))
    cell = angles.argmin(axis=1)
    ring = np.minimum((angles[np.arange(len(cell)), cell] * (_RINGS / np.pi)).astype(np.int32), _RINGS - 1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, angles.size + 1, len(held), dtype=np.int32)), pa.array(angles.astype(np.float32).ravel()))
    return pa.table({"group": rows.column("group"), "dim": rows.column("dim"), "id": rows.column("id"), "embedding": rows.column("embedding"), "norm": norm, "cell": cell.astype(np.int32), "ring": ring, "angles": lists})


def placed(vectors: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, dim, id, embedding, norm, cell, ring, block, angles) of vectors (group, dim, id, embedding); ``sizes`` has (group, dim, n)."""
    order = Window.partitionBy("group", "dim").orderBy(F.xxhash64("id"), "id")
    some = vectors.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= CANDIDATES).drop("_rank")
    pivots = some.groupBy("group", "dim").applyInArrow(_chosen, "group long, dim int, pivots array<double>")
    # a large group is dealt to slices, and its pivots go to each
    parts = sizes.select("group", "dim", F.ceil(F.col("n") / _SLICE).alias("_parts"))
    dealt = vectors.join(parts, ["group", "dim"]).withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "id"), F.col("_parts"))).drop("_parts")
    sent = pivots.join(parts, ["group", "dim"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    keys = ["group", "dim", "slice"]
    told = written(dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_told, _TOLD.format(vectors.schema["embedding"].dataType.simpleString())), "vectors-told")

    # rings of a cell, from the pivot outwards, fill blocks; a ring that is too large for one is dealt to several
    cells = Window.partitionBy("group", "dim", "cell").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    rings = told.groupBy("group", "dim", "cell", "ring").agg(F.count("*").alias("_n")).withColumn("_most", most_rows(F.col("dim")))
    rings = rings.withColumn("_run", F.floor(F.coalesce(F.sum("_n").over(cells), F.lit(0)) / F.col("_most"))).withColumn("_parts", F.ceil(F.col("_n") / F.col("_most")))
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.col("_parts"))
    # a run of small rings is one block; of a ring with parts of its own each is one
    block = F.xxhash64("cell", "_run", F.when(F.col("_parts") > 1, F.struct("ring", part)))
    return told.join(rings.drop("_n", "_most"), ["group", "dim", "cell", "ring"]).select("group", "dim", "id", "embedding", "norm", "cell", "ring", block.alias("block"), "angles")


def most_rows(dim: Column) -> Column:
    return F.greatest(F.floor(F.lit(BLOCK_NUMBERS) / dim), F.lit(BLOCK_ROWS))


def block_pairs(blocks: DataFrame, least: float) -> DataFrame:
    """(group, dim, i, j, kept) for all pairs of blocks, the lower one first: whether they can hold vectors
    whose product reaches ``least``."""
    low = [F.min(F.coalesce(F.col("angles")[p], F.lit(0.0))).cast("double") for p in range(PIVOTS)]
    high = [F.max(F.coalesce(F.col("angles")[p], F.lit(0.0))).cast("double") for p in range(PIVOTS)]
    sums = written(blocks.groupBy("group", "dim", "block").agg(F.array(*low).alias("low"), F.array(*high).alias("high"), F.max("norm").alias("norm")), "vector-blocks")
    side = lambda s: sums.select("group", "dim", F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("low", "high", "norm")])
    gaps = F.zip_with(F.zip_with("low_j", "high_i", lambda a, b: a - b), F.zip_with("low_i", "high_j", lambda a, b: a - b), lambda a, b: F.greatest(a, b))
    apart = F.greatest(F.array_max(gaps) - _SLACK, F.lit(0.0))
    # the product is at most that of the lengths times the cosine; beyond a right angle it is at most 0
    best = F.when(apart < np.pi / 2, F.col("norm_i") * F.col("norm_j") * F.cos(apart)).otherwise(0.0)
    pairs = side("i").join(side("j"), ["group", "dim"]).where("i <= j")
    return pairs.select("group", "dim", "i", "j", ((F.col("i") == F.col("j")) | (best + 1e-9 >= F.least(F.lit(least), F.lit(1.0)))).alias("kept"))


def met(vectors: DataFrame, least: float) -> tuple[DataFrame, bool]:
    """(group, dim, i, j, block, id, embedding), and whether every group is one block: each vector (group, id, embedding) once for each pair of blocks
    that it has a part in; ``block`` is the one of the two that it is of. Vectors of different sizes never meet."""
    rows = vectors.where(F.size("embedding") > 0).select("group", F.size("embedding").alias("dim"), "id", "embedding")
    sizes = written(rows.groupBy("group", "dim").agg(F.count("*").alias("n")), "vector-sizes")
    zero = F.lit(0).cast("long")
    if sizes.where(F.col("n") > most_rows(F.col("dim"))).isEmpty():
        # a block each
        return rows.select("group", "dim", zero.alias("i"), zero.alias("j"), zero.alias("block"), "id", "embedding"), True
    blocks = written(placed(rows, sizes), "vectors-placed")
    pairs = written(block_pairs(blocks, least).where("kept").drop("kept"), "vector-pairs")
    ends = pairs.withColumn("block", F.col("i")).unionByName(pairs.where("i <> j").withColumn("block", F.col("j")))
    return blocks.select("group", "dim", "block", "id", "embedding").join(ends, ["group", "dim", "block"]).select("group", "dim", "i", "j", "block", "id", "embedding"), False


def met_in_tiles(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame | None]:
    """Rows (group, dim, i, j, side, block, id, embedding) and pairs (group, dim, i, j, low, high) of tiles: each vector once for each
    tile (i, j) that it has a part in, ``side`` being the one of the two that it is of, and for each tile the pairs of blocks
    that can hold vectors whose product reaches ``least``. Where every group is one block there is one tile each, and no pairs."""
    rows = vectors.where(F.size("embedding") > 0).select("group", F.size("embedding").alias("dim"), "id", "embedding")
    sizes = written(rows.groupBy("group", "dim").agg(F.count("*").alias("n")), "vector-sizes")
    if sizes.where(F.col("n") > most_rows(F.col("dim"))).isEmpty():
        return rows, None
    blocks = written(placed(rows, sizes), "vectors-placed")
    pairs = block_pairs(blocks, least).where("kept").drop("kept")
    order = Window.partitionBy("group", "dim").orderBy("cell", "ring", "block").rowsBetween(Window.unboundedPreceding, -1)
    sides = blocks.groupBy("group", "dim", "block").agg(F.count("*").alias("_n"), F.min("cell").alias("cell"), F.min("ring").alias("ring"))
    most = F.greatest(F.floor(F.lit(min(SIDE_NUMBERS, BLOCK_NUMBERS)) / F.col("dim")), F.lit(BLOCK_ROWS))
    side = F.floor(F.coalesce(F.sum("_n").over(order), F.lit(0)) / most)
    sides = written(sides.select("group", "dim", "block", side.alias("side")), "vector-sides")
    end = lambda c, s: sides.select("group", "dim", F.col("block").alias(c), F.col("side").alias(s))
    pairs = pairs.join(end("i", "a"), ["group", "dim", "i"]).join(end("j", "b"), ["group", "dim", "j"])
    pairs = written(pairs.select("group", "dim", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), F.col("i").alias("low"), F.col("j").alias("high")), "vector-pairs")
    ends = pairs.select("group", "dim", "i", "j", F.explode(F.array("low", "high")).alias("block")).distinct().join(sides, ["group", "dim", "block"])
    sent = blocks.select("group", "dim", "block", "id", "embedding").join(ends, ["group", "dim", "block"])
    return sent.select("group", "dim", F.col("i").alias("i"), F.col("j").alias("j"), "side", "block", "id", "embedding"), pairs


def pruning(vectors: DataFrame, least: float) -> DataFrame:
    """(blocks, pairs, kept): how many pairs of blocks there are, and how many of them are looked into."""
    rows = vectors.where(F.size("embedding") > 0).select("group", F.size("embedding").alias("dim"), "id", "embedding")
    found = block_pairs(placed(rows, rows.groupBy("group", "dim").agg(F.count("*").alias("n"))), least)
    return found.agg(F.count_if(F.col("i") == F.col("j")).alias("blocks"), F.count("*").alias("pairs"), F.count_if("kept").alias("kept"))
