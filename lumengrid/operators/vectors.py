"""Vectors of faces: matching against a library, nearest neighbours, centroids.

Two tables of vectors are compared block by block: each side is dealt to blocks of bounded
size, every block of one side meets every block of the other in one task, and a task hands on
only the best of each row. Neighbours within one table go through ``pivots``, which leaves out pairs of
blocks that are too far apart. Vectors of different sizes are not compared; rows without a vector
have no part in it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pivots import matrix, met_in_tiles

#: A block holds about so many numbers.
BLOCK_NUMBERS = 1 << 19
#: Products of one call, in numbers.
_STRIP = 1 << 22
#: Rows and columns of a product whose pairs are offered to both.
_ROWS, _COLUMNS = 256, 2048
#: Vectors longer than this are not multiplied as short numbers, and so many pairs are worked out in full at a time.
_FAR, _GATHER = 1e15, 4096

_PAIR = pa.schema([("group", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("similarity", pa.float64())])

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def near_keys(ids: np.ndarray, rows: np.ndarray, keys: np.ndarray, others: np.ndarray, most: int, least: float, slack: float = 0.0, apart: bool = False) -> Found:
    """(id, key, similarity): of each row the ``most`` best keys of the others that reach ``least``, with those that equal
    the last of them and those less than ``slack`` below it. A strip of rows at a time is multiplied."""
    keys, at = np.unique(keys, return_inverse=True)
    order = np.argsort(at, kind="stable")
    heads = np.searchsorted(at[order], np.arange(len(keys)))
    columns = others[order].T
    out: list[Found] = []
    step = max(1, _STRIP // max(1, len(order)))
    for lo in range(0, len(rows), step):
        own = ids[lo : lo + step]
        # a key with several vectors counts by the nearest
        near = np.clip(rows[lo : lo + step] @ columns, -1, 1)
        near = near if len(heads) == near.shape[1] else np.maximum.reduceat(near, heads, axis=1)
        if apart:
            near[keys[None, :] == own[:, None]] = -np.inf
        floor = np.partition(near, -most, axis=1)[:, -most] if near.shape[1] > most else np.full(len(own), -np.inf)
        i, j = np.nonzero((near >= least) & ((near >= floor[:, None]) | (near > floor[:, None] - slack)))
        out.append((own[i], keys[j], near[i, j]))
    return tuple(np.concatenate([x[c] for x in out]) for c in range(3)) if out else (np.array([], np.int64),) * 2 + (np.array([], np.float64),)


def _best_of_blocks(least: float, most: int, slack: float, apart: bool) -> Callable[[pa.Table], pa.Table]:
    """A task's work on a block of rows and one of keys."""

    def run(table: pa.Table) -> pa.Table:
        left, right = (table.filter(pc.equal(table.column("side"), side)) for side in (0, 1))
        if not left.num_rows or not right.num_rows:
            return _PAIR.empty_table()
        ids, keys = left.column("id").to_numpy(), right.column("id").to_numpy()
        found = near_keys(ids, matrix(left.column("embedding")), keys, matrix(right.column("embedding")), most, least, slack, apart)
        return pa.table([np.full(len(found[0]), left.column("group")[0].as_py(), np.int64), *found], schema=_PAIR)

    return run


def first_keys(ids: np.ndarray, keys: np.ndarray, near: np.ndarray, most: int) -> Found:
    """Each (id, key) once, with its largest similarity, and of each id the first ``most``, ties by key."""
    order = np.lexsort((-near, keys, ids))
    ids, keys, near = ids[order], keys[order], near[order]
    once = np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))[: len(ids)]
    ids, keys, near = ids[once], keys[once], near[once]
    order = np.lexsort((keys, -near, ids))
    ids, keys, near = ids[order], keys[order], near[order]
    rank = np.arange(len(ids)) - np.searchsorted(ids, ids)
    return ids[rank < most], keys[rank < most], near[rank < most]


class _Nearest:
    """Of each of n rows the first ``most`` keys among those offered so far, ties to the lower place. Places of keys are
    offered in ascending order, so that once a row has as many, another must be nearer than the last: ``floor`` is what it must reach."""

    def __init__(self, n: int, most: int, least: float):
        self.most, self.floor, self._room, self._new = most, np.full(n, float(least)), 2 * n * most, 0
        self._held: list[Found] = [(np.array([], np.int64), np.array([], np.int64), np.array([], np.float64))]

    def offer(self, rows: np.ndarray, keys: np.ndarray, near: np.ndarray) -> None:
        self._held.append((rows, keys, near))
        self._new += len(rows)
        if self._new > self._room:
            self.settled()

    def settled(self) -> Found:
        rows, keys, near = (np.concatenate([h[c] for h in self._held]) for c in range(3))
        order = np.lexsort((keys, -near, rows))
        rows, keys, near = rows[order], keys[order], near[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = rank == self.most - 1
        # nothing is nearer than 1
        self.floor[rows[last]] = np.where(near[last] < 1, np.nextafter(near[last], np.inf), np.inf)
        kept = rank < self.most
        self._held, self._new = [(rows[kept], keys[kept], near[kept])], 0
        return self._held[0]


class _Products:
    """Products of two sets of rows that reach a floor. They are sifted as short floats, with room for what those can be off by, and
    worked out in full for the few that may reach it."""

    def __init__(self, rows: np.ndarray, others: np.ndarray):
        self.rows, self.others = rows, others
        far = np.sqrt(np.maximum(*((x * x).sum(axis=1).max(initial=0) for x in (rows, others))))
        # lengths that could leave the range of the short numbers are sifted in full
        self.kind = np.float32 if far < _FAR else np.float64
        self.off = (rows.shape[1] + 8) * np.finfo(self.kind).eps * far * far + 1e-30 if far < _FAR else 0.0
        self._rows = rows.astype(self.kind, copy=False)
        self._others = self._rows if others is rows else others.astype(self.kind, copy=False)

    def of(self, lo: int, hi: int, at: int, to: int) -> np.ndarray:
        return self._rows[lo:hi] @ self._others[at:to].T

    def reaching(self, near: np.ndarray, lo: int, at: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of those that reach the floor, which has one number a row or one a column."""
        short = floor if self.kind is np.float64 else np.nextafter((floor - self.off).astype(self.kind), self.kind(-np.inf))
        i, j = np.divmod(np.flatnonzero(near >= short), near.shape[1])
        if self.kind is np.float64:
            return lo + i, at + j, np.clip(near[i, j], -1, 1)
        found = np.concatenate([np.einsum("ij,ij->i", self.rows[lo + i[c : c + _GATHER]], self.others[at + j[c : c + _GATHER]]) for c in range(0, max(1, len(i)), _GATHER)])
        found = np.clip(found, -1, 1)
        kept = np.flatnonzero(found >= np.broadcast_to(floor, near.shape)[i, j])
        return lo + i[kept], at + j[kept], found[kept]


def near_within(ids: np.ndarray, rows: np.ndarray, k: int, least: float) -> Found:
    """(id, key, similarity): of each row its k nearest others that reach ``least``, ties to the lower id. Each product is
    worked out once and offered to both of its rows; ids are distinct."""
    order = np.argsort(ids)
    ids, rows = ids[order], rows[order]
    best, products = _Nearest(len(ids), k, least), _Products(rows, rows)
    for lo in range(0, len(ids), _ROWS):
        hi = min(lo + _ROWS, len(ids))
        near = products.of(lo, hi, lo, hi)
        np.fill_diagonal(near, -np.inf)
        best.offer(*products.reaching(near, lo, lo, best.floor[lo:hi, None]))
        for at in range(hi, len(ids), _COLUMNS):
            to = min(at + _COLUMNS, len(ids))
            near = products.of(lo, hi, at, to)
            best.offer(*products.reaching(near, lo, at, best.floor[lo:hi, None]))
            i, j, found = products.reaching(near, lo, at, best.floor[None, at:to])
            best.offer(j, i, found)
    i, j, near = best.settled()
    return ids[i], ids[j], near


def near_between(ids: np.ndarray, rows: np.ndarray, keys: np.ndarray, others: np.ndarray, k: int, least: float) -> Found:
    """The same of the rows of two tables that have no id in common, both ways."""
    (ids, rows), (keys, others) = ((x[order], v[order]) for x, v, order in ((ids, rows, np.argsort(ids)), (keys, others, np.argsort(keys))))
    left, right, products = _Nearest(len(ids), k, least), _Nearest(len(keys), k, least), _Products(rows, others)
    for lo in range(0, len(ids), _ROWS):
        hi = min(lo + _ROWS, len(ids))
        for at in range(0, len(keys), _COLUMNS):
            to = min(at + _COLUMNS, len(keys))
            near = products.of(lo, hi, at, to)
            left.offer(*products.reaching(near, lo, at, left.floor[lo:hi, None]))
            i, j, found = products.reaching(near, lo, at, right.floor[None, at:to])
            right.offer(j, i, found)
    (i, j, near), (y, x, back) = left.settled(), right.settled()
    return np.append(ids[i], keys[y]), np.append(keys[j], ids[x]), np.append(near, back)


def linked(ids: np.ndarray, rows: np.ndarray, k: int, least: float) -> Found:
    """(src, dst, similarity) of the neighbours of all rows of one table, with the same links the other way round."""
    distinct = len(np.unique(ids)) == len(ids)
    src, dst, near = near_within(ids, rows, k, least) if distinct else first_keys(*near_keys(ids, rows, ids, rows, k, least, apart=True), k)
    return first_keys(np.append(src, dst), np.append(dst, src), np.append(near, near), len(src) * 2 + 1)


def _links_of_group(k: int, least: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = linked(table.column("id").to_numpy(), matrix(table.column("embedding")), k, least)
        return pa.table([np.full(len(found[0]), key[0].as_py(), np.int64), *found], schema=_PAIR)

    return run


def _near_in_tile(ids: np.ndarray, rows: np.ndarray, left: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, least: float) -> Found:
    """The k nearest of each row of a tile: of the rows that are ``left`` with the others, or of all if there are no others.
    Where most pairs of blocks are left all is multiplied, else each block with those that it is paired with."""
    one = bool(left.all())
    names, of, n = np.unique(block, return_inverse=True, return_counts=True)
    low, high = np.searchsorted(names, low), np.searchsorted(names, high)
    every = len(ids) ** 2 / 2 if one else left.sum() * (~left).sum()
    if 2 * (n[low] * n[high] * np.where(low == high, 0.5, 1)).sum() >= every:
        return near_within(ids, rows, k, least) if one else near_between(ids[left], rows[left], ids[~left], rows[~left], k, least)
    found = []
    for a in np.unique(low):
        own, others = of == a, np.isin(of, high[(low == a) & (high != a)])
        if (high[low == a] == a).any():
            found.append(near_within(ids[own], rows[own], k, least))
        if others.any():
            found.append(near_between(ids[own], rows[own], ids[others], rows[others], k, least))
    return first_keys(*(np.concatenate([f[c] for f in found]) for c in range(3)), k)


def _best_of_tile(k: int, least: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table, pairs: pa.Table) -> pa.Table:
        group, _, i, j = (x.as_py() for x in key)
        ids, rows, left = table.column("id").to_numpy(), matrix(table.column("embedding")), table.column("side").to_numpy() == i
        if len(np.unique(ids)) == len(ids):
            found = _near_in_tile(ids, rows, left, table.column("block").to_numpy(), pairs.column("low").to_numpy(), pairs.column("high").to_numpy(), k, least)
        else:
            ends = [(left, left)] if i == j else [(left, ~left), (~left, left)]
            parts = [near_keys(ids[a], rows[a], ids[b], rows[b], k, least, apart=True) for a, b in ends]
            found = tuple(np.concatenate([f[c] for f in parts]) for c in range(3))
        return pa.table([np.full(len(found[0]), group, np.int64), *found], schema=_PAIR)

    return run


def best_keys(rows: DataFrame, others: DataFrame, most: int, least: float = -1.0, slack: float = 0.0, apart: bool = False) -> DataFrame:
    """(group, id, key, similarity, rank): the ``most`` nearest keys of each row, and those less than
    ``slack`` below the last of them; ties by key.

    Both tables have (group, id, embedding), the second's ids being the keys; only vectors of one
    group and size are compared. ``apart``: a row's own id is no key for it.
    """
    dim = F.size("embedding").alias("dim")
    left = rows.where(F.size("embedding") > 0).select("group", "id", "embedding", dim)
    right = others.where(F.size("embedding") > 0).select("group", "id", "embedding", dim)
    count = lambda df, name: df.groupBy("group", "dim").agg(F.ceil(F.count("*") * F.col("dim") / BLOCK_NUMBERS).cast("int").alias(name))
    blocks = count(left, "n_left").join(count(right, "n_right"), ["group", "dim"])

    def dealt(df: DataFrame, side: int) -> DataFrame:
        (own, n_own), (other, n_other) = (("i", "n_left"), ("j", "n_right"))[:: 1 - 2 * side]
        placed = df.join(blocks, ["group", "dim"]).withColumn(own, F.pmod(F.xxhash64("id", "embedding"), F.col(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).select("group", "dim", "i", "j", "id", "embedding", F.lit(side).alias("side"))

    met = dealt(left, 0).unionByName(dealt(right, 1)).groupBy("group", "dim", "i", "j")
    found = met.applyInArrow(_best_of_blocks(least, most, slack, apart), "group long, id long, key long, similarity double")
    found = found.groupBy("group", "id", "key").agg(F.max("similarity").alias("similarity"))
    ranks = found.withColumn("rank", F.row_number().over(Window.partitionBy("group", "id").orderBy(F.desc("similarity"), "key")))
    if not slack:
        return ranks.where(F.col("rank") <= most)
    last = F.max(F.when(F.col("rank") == most, F.col("similarity"))).over(Window.partitionBy("group", "id"))
    near = F.coalesce(F.col("similarity") > last - slack, F.lit(True))
    return ranks.withColumn("near", near).where((F.col("rank") <= most) | F.col("near")).drop("near")


def best_persons(queries: DataFrame, library: DataFrame, most: int = 3, slack: float = 0.0) -> DataFrame:
    """(id, person_id, similarity, rank): each query (id, embedding) with the nearest persons of the
    library (person_id, embedding), by the person's most similar sample."""
    one = F.lit(0).cast("long").alias("group")
    found = best_keys(queries.select(one, "id", "embedding"), library.select(one, F.col("person_id").alias("id"), "embedding"), most, slack=slack)
    return found.select("id", F.col("key").alias("person_id"), "similarity", "rank")


def ranked(queries: DataFrame, library: DataFrame, most: int = 3) -> DataFrame:
    """The best persons of each query, with their rank from 1 and the score of the second."""
    top = best_persons(queries, library, max(most, 2))
    second = F.max(F.when(F.col("rank") == 2, F.col("similarity"))).over(Window.partitionBy("id"))
    return top.withColumn("runner_up", second).where(F.col("rank") <= most)


def matches(queries: DataFrame, library: DataFrame, threshold: float = 0.42, margin: float = 0.05) -> DataFrame:
    """(id, person_id, similarity, runner_up) of queries whose best person reaches the threshold and
    leads the second by the margin."""
    lead = F.col("runner_up").isNull() | (F.col("similarity") - F.col("runner_up") >= margin)
    return ranked(queries, library, 1).where((F.col("similarity") >= threshold) & lead).select("id", "person_id", "similarity", "runner_up")


def neighbours_within(vectors: DataFrame, k: int = 12, least: float = 0.45) -> DataFrame:
    """(group, src, dst, similarity): for each vector (group, id, embedding) its k most similar others of
    the group that reach ``least``, ties to the lower id, and the same links the other way round.
    Exact: only pairs of blocks that can't reach ``least`` are left out. k = 0 gives none."""
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "group long, src long, dst long, similarity double")
    rows, pairs = met_in_tiles(vectors, least)
    if pairs is None:
        found = rows.groupBy("group", "dim").applyInArrow(_links_of_group(k, least), "group long, id long, key long, similarity double")
        return found.select("group", F.col("id").alias("src"), F.col("key").alias("dst"), "similarity")
    tile = ["group", "dim", "i", "j"]
    # parts by tiles, which are long work on few bytes; what a part holds of what they found then doesn't grow
    parts = max(1, pairs.select(*tile).distinct().count())
    found = rows.repartition(parts, *tile).groupBy(*tile).cogroup(pairs.groupBy(*tile)).applyInArrow(_best_of_tile(k, least), "group long, id long, key long, similarity double")
    # dealt by row once: what follows of a row is done where it is
    found = found.repartition(parts, "group", "id").groupBy("group", "id", "key").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("group", "id").orderBy(F.desc("similarity"), "key"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    ends = F.array(F.struct(F.col("id").alias("src"), F.col("key").alias("dst")), F.struct(F.col("key").alias("src"), F.col("id").alias("dst")))
    both = top.select("group", "similarity", F.explode(ends).alias("end"))
    return both.groupBy("group", "end.src", "end.dst").agg(F.max("similarity").alias("similarity")).select("group", "src", "dst", "similarity")


def neighbours(vectors: DataFrame, k: int = 12, least: float = 0.45) -> DataFrame:
    """(src, dst, similarity) of all vectors (id, embedding), as one group."""
    one = vectors.select(F.lit(0).cast("long").alias("group"), "id", "embedding")
    return neighbours_within(one, k, least).drop("group")


def vector_sums(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, size): the sum and number of each group's vectors of the group's first size.

    ``members`` has the group's columns, id and embedding. Sums are taken number by number, so a
    group of any size is added up by all tasks.
    """
    first = members.groupBy(*by).agg(F.min_by(F.size("embedding"), "id").alias("_dim"))
    fitting = members.join(first, by).where(F.size("embedding") == F.col("_dim"))
    sums = fitting.select(*by, F.posexplode("embedding").alias("pos", "x")).groupBy(*by, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return sums.groupBy(*by).agg(F.transform(parts, lambda p: p["x"]).alias("total"), F.max("n").alias("size"))


def centroids(members: DataFrame, *by: str) -> DataFrame:
    """(by, centroid, size): the mean direction of each group's vectors of the group's first size."""
    norm = F.sqrt(F.aggregate("total", F.lit(0.0), lambda acc, x: acc + x * x))
    # a name for the length, which would else be worked out anew for each number
    unit = F.transform(F.array(norm), lambda n: F.transform("total", lambda x: F.when(n > 1e-12, x / n).otherwise(x)))[0]
    return vector_sums(members, list(by)).select(*by, unit.alias("centroid"), "size")


def cohesion(members: DataFrame, *by: str) -> DataFrame:
    """(by, cohesion): the mean cosine of a group's vectors with its centroid."""
    from ..functions.geometry import cosine

    joined = members.join(centroids(members, *by), list(by))
    return joined.groupBy(*by).agg(F.avg(cosine(F.col("embedding"), F.col("centroid"))).alias("cohesion"))


def suggest_for_clusters(members: DataFrame, group: str, library: DataFrame, threshold: float = 0.42, margin: float = 0.05) -> DataFrame:
    """A person for each cluster whose centroid matches one."""
    queries = centroids(members, group).select(F.col(group).alias("id"), F.col("centroid").alias("embedding"))
    return matches(queries, library.select("person_id", F.col("embedding").cast("array<double>").alias("embedding")), threshold, margin).withColumnRenamed("id", group)
