"""A Merkle manifest of a dataset: one hash that speaks for all rows, and a proof for each.

A source's rows, in order, are the leaves of a tree; each 16 nodes make one of the next level.
The tops of the sources are the leaves of one more tree. Rows are sorted and cut into chunks that
know nothing of the trees' edges, so a chunk resolves what runs it holds whole and keeps the rest as a
sparse forest: open nodes by tree, level and index. Forests join in any order and grouping: as soon
as the siblings of a run are all there (how many there are follows from the tree's leaves), the run
becomes its parent. Reduced in a tree of such joins nothing but the root is left.

The way back hands each open node the siblings on its path to the root, forest by forest, so
every row gets its proof in the task of its chunk. Neither tree nor paths pass the driver, which
gets the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, numbered, written

FAN = 16
#: Rows of a chunk, and forests that one task joins.
CHUNK, JOINED = 8192, 32
#: The tree over the sources; those of the sources are numbered from 0.
TOP = -1

Node = tuple[int, int, int]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves."""
    out = 0
    while leaves > 1:
        leaves, out = -(-leaves // FAN), out + 1
    return out


class Forest:
    """Open nodes of some trees, keyed by tree, level and index; joining forests is associative and commutative.

    ``links`` says for each node that this forest resolved its siblings to the left and to the right
    and its parent.
    """

    def __init__(self, sources: int):
        self.sizes: dict[int, int] = {TOP: sources}
        self.open: dict[Node, dict[int, str]] = {}
        self.links: dict[Node, tuple[str, str, Node]] = {}
        self.tops: dict[int, str] = {}

    def add(self, tree: int, size: int, level: int, index: int, value: str) -> None:
        while True:
            self.sizes[tree] = size
            width = -(-size // FAN**level)
            if width == 1 and tree != TOP:
                # a source's top is a leaf of the tree over the sources
                self.tops[tree] = value
                self.links[tree, level, 0] = ("", "", (TOP, 0, tree))
                tree, size, level, index = TOP, self.sizes[TOP], 0, tree
                continue
            run = index // FAN
            held = self.open.setdefault((tree, level, run), {})
            held[index] = value
            if width == 1 or len(held) < min(FAN, width - run * FAN):
                return
            del self.open[tree, level, run]
            values = [held[i] for i in sorted(held)]
            for k, i in enumerate(sorted(held)):
                self.links[tree, level, i] = ("".join(values[:k]), "".join(values[k + 1 :]), (tree, level + 1, run))
            level, index, value = level + 1, run, digest(*values)

    def nodes(self) -> Iterator[tuple[int, int, int, int, str]]:
        """(tree, size, level, index, digest) of what is open."""
        for (tree, level, _), held in self.open.items():
            for index, value in held.items():
                yield tree, self.sizes[tree], level, index, value

    def join(self, other: Forest) -> Forest:
        for node in list(other.nodes()):
            self.add(*node)
        return self

    def paths(self, above: dict[Node, tuple]) -> Callable[[Node], tuple]:
        """The siblings (left, right) of a node and its ancestors up to the root, ``above`` being those of the open nodes."""
        known = dict(above)

        def path(node: Node) -> tuple:
            way = []
            while node not in known:
                way.append(node)
                node = self.links[node][2]
            found = known[node]
            for n in reversed(way):
                left, right, parent = self.links[n]
                # only the step from a source's top to the tree over the sources has no hash of its own
                found = known[n] = found if parent[0] == TOP != n[0] else ((left, right), *found)
            return found

        return path


# ---------------------------------------------------------------- leaves


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def tampered() -> Column:
    """Rows that the check of the manifest changes."""
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


# ---------------------------------------------------------------- tasks

_OPEN = "id long, tree long, size long, level long, index long, digest string"
_PATH = "id long, tree long, level long, index long, path array<string>"
_OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _rows(table: pa.Table, *columns: str) -> Iterable[tuple]:
    return zip(*(table.column(c).to_pylist() for c in columns), strict=True)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _chunk(leaves: pa.Table, pieces: pa.Table, sources: int) -> tuple[Forest, list[Node]]:
    """The forest of a chunk's leaves, and the node of each, in order of ``n``; ``leaves`` is sorted."""
    forest, at, nodes = Forest(sources), 0, []
    numbers, values = leaves.column("n").to_pylist(), leaves.column("leaf").to_pylist()
    for tree, first, size in sorted(_rows(pieces, "tree", "first", "size")):
        while at < len(numbers) and numbers[at] < first + size:
            nodes.append((tree, 0, numbers[at] - first))
            forest.add(tree, size, 0, numbers[at] - first, values[at])
            at += 1
    return forest, nodes


def _local(sources: int) -> Callable:
    def run(key: tuple, leaves: pa.Table, pieces: pa.Table) -> pa.Table:
        forest, _ = _chunk(leaves.sort_by("n"), pieces, sources)
        return _table([(key[0].as_py(), *node) for node in forest.nodes()], _OPEN)

    return run


def _joined(nodes: pa.Table, sources: int) -> Forest:
    forest = Forest(sources)
    for node in _rows(nodes, "tree", "size", "level", "index", "digest"):
        forest.add(*node)
    return forest


def _up(sources: int) -> Callable:
    def run(key: tuple, nodes: pa.Table) -> pa.Table:
        return _table([(key[0].as_py(), *node) for node in _joined(nodes, sources).nodes()], _OPEN)

    return run


def _above(paths: pa.Table) -> dict[Node, tuple]:
    return {(t, v, i): tuple(zip(p[::2], p[1::2], strict=True)) for t, v, i, p in _rows(paths, "tree", "level", "index", "path")}


def _down(sources: int) -> Callable:
    def run(nodes: pa.Table, paths: pa.Table) -> pa.Table:
        path = _joined(nodes, sources).paths(_above(paths))
        return _table([(*row, [x for step in path(row[1:]) for x in step]) for row in _rows(nodes, "id", "tree", "level", "index")], _PATH)

    return run


def _fold(value: str, steps: tuple) -> str:
    for left, right in steps:
        value = digest(left, value, right)
    return value


def _proofs(sources: int, root: str) -> Callable:
    def run(leaves: pa.Table, help_: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("n")
        whole = pc.is_null(help_.column("path"))
        pieces, paths = help_.filter(whole), help_.filter(pc.invert(whole))
        forest, nodes = _chunk(leaves, pieces, sources)
        path = forest.paths(_above(paths))
        rows, tops = [], dict(forest.tops)
        for node, (doc_id, value, changed) in zip(nodes, _rows(leaves, "doc_id", "leaf", "changed"), strict=True):
            steps = path(node)
            if node[0] not in tops:
                tops[node[0]] = _fold(value, steps[: height(forest.sizes[node[0]])])
            folded = _fold(value if changed is None else changed, steps)
            rows.append((doc_id, value, tops[node[0]], root, digest(*[x for step in steps for x in step]), folded, folded == root))
        return _table(rows, _OUT)

    return run


def _reduced(opened: DataFrame, sources: int) -> str:
    """The root: forests of partitions, reduced in a tree; one node reaches the driver."""

    def forest(rows: Iterable) -> Iterator[Forest]:
        out = Forest(sources)
        for r in rows:
            out.add(r["tree"], r["size"], r["level"], r["index"], r["digest"])
        out.links.clear()
        yield out

    def join(a: Forest, b: Forest) -> Forest:
        a.join(b).links.clear()
        return a

    whole = opened.rdd.mapPartitions(forest).treeReduce(join, depth=3)
    return next(whole.nodes())[4]


# ---------------------------------------------------------------- the manifest


def manifest_proofs(docs: DataFrame, chunk: int = CHUNK, joined: int = JOINED) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    The manifest is that of the rows as they are; each row is then proved against the root, those
    that ``tampered`` names with their text's A-Z in lower case. Rows of a source are in order of
    doc_id, null first, and of their leaf where they share one; repeated rows are leaves each. Rows
    without source are a source. An empty table gives an empty result; other columns aren't looked at.
    """
    spark = docs.sparkSession
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(F.col("text")).alias("leaf"), F.when(tampered(), leaf(lower)).alias("changed"))
    once = written(rows.withColumn("_salt", F.monotonically_increasing_id()), "manifest-leaves")
    placed = numbered(once, ["source", "doc_id", "leaf", "_salt"], "n").drop("_salt")
    leaves = written(placed.withColumn("id", F.floor((F.col("n") - 1) / chunk)), "manifest-placed")

    sources = leaves.groupBy("source").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    sources = written(numbered(sources, ["first"], "tree").withColumn("tree", F.col("tree") - 1), "manifest-sources")
    many = sources.count()
    if not many:
        return spark.createDataFrame([], _OUT)
    span = F.sequence(F.floor((F.col("first") - 1) / chunk), F.floor((F.col("first") + F.col("size") - 2) / chunk))
    pieces = sources.select(F.explode(span).alias("id"), "tree", "first", "size")

    opened = [written(leaves.select("id", "n", "leaf").groupBy("id").cogroup(pieces.groupBy("id")).applyInArrow(_local(many), _OPEN), "manifest-open")]
    root = _reduced(opened[0], many)
    up = F.floor(F.col("id") / joined)
    ids = leaves.agg(F.max("id")).first()[0] + 1
    while ids > 1:
        opened.append(written(opened[-1].groupBy(up.alias("up")).applyInArrow(_up(many), _OPEN), "manifest-open"))
        ids = -(-ids // joined)
    paths = opened[-1].select("id", "tree", "level", "index", F.array().cast("array<string>").alias("path"))
    for nodes in opened[-2::-1]:
        known = paths.withColumnRenamed("id", "up").groupBy("up")
        paths = written(nodes.withColumn("up", up).groupBy("up").cogroup(known).applyInArrow(_down(many), _PATH), "manifest-paths")
    discard(once, *opened[:-1])
    help_ = pieces.withColumns({"level": F.lit(None).cast("long"), "index": F.lit(None).cast("long"), "path": F.lit(None).cast("array<string>")})
    help_ = help_.unionByName(paths.withColumns({"first": F.lit(None).cast("long"), "size": F.lit(None).cast("long")}))
    return leaves.select("id", "n", "doc_id", "leaf", "changed").groupBy("id").cogroup(help_.groupBy("id")).applyInArrow(_proofs(many, root), _OUT)


#: The same level by level, for comparison on small tables.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([0,1,2,3,4,5,6,7], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), fields AS (
  SELECT doc_id, source, text,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
                         lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 5 = 0 AS hit
  FROM documents, crc
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
               CASE WHEN hit THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS changed FROM fields)
), lower_nodes AS (
  SELECT tree, CAST(0 AS BIGINT) AS level, CAST(idx AS BIGINT) AS idx, leaf AS h, CAST(n AS BIGINT) AS n FROM leaves
  UNION ALL
  SELECT tree, any_value(level) + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), any_value(n + 15) // 16 FROM lower_nodes WHERE n > 1 GROUP BY tree, idx // 16
), tops AS (
  SELECT tree, level AS high, h AS subroot FROM lower_nodes WHERE n = 1
), upper_nodes AS (
  SELECT CAST(0 AS BIGINT) AS level, CAST(tree AS BIGINT) AS idx, subroot AS h, (SELECT count(*) FROM tops) AS n FROM tops
  UNION ALL
  SELECT any_value(level) + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), any_value(n + 15) // 16 FROM upper_nodes WHERE n > 1 GROUP BY idx // 16
), steps AS (
  SELECT tree, level, a.idx, coalesce((SELECT string_agg(h, '' ORDER BY b.idx) FROM lower_nodes b WHERE b.tree = a.tree AND b.level = a.level AND b.idx // 16 = a.idx // 16 AND b.idx < a.idx), '') AS l,
         coalesce((SELECT string_agg(h, '' ORDER BY b.idx) FROM lower_nodes b WHERE b.tree = a.tree AND b.level = a.level AND b.idx // 16 = a.idx // 16 AND b.idx > a.idx), '') AS r
  FROM lower_nodes a WHERE n > 1
), top_steps AS (
  SELECT level, a.idx, coalesce((SELECT string_agg(h, '' ORDER BY b.idx) FROM upper_nodes b WHERE b.level = a.level AND b.idx // 16 = a.idx // 16 AND b.idx < a.idx), '') AS l,
         coalesce((SELECT string_agg(h, '' ORDER BY b.idx) FROM upper_nodes b WHERE b.level = a.level AND b.idx // 16 = a.idx // 16 AND b.idx > a.idx), '') AS r
  FROM upper_nodes a WHERE n > 1
), walks AS (
  SELECT doc_id, leaf, tree, high, subroot, CAST(0 AS BIGINT) AS level, CAST(idx AS BIGINT) AS idx, coalesce(changed, leaf) AS h, '' AS proof, false AS up FROM leaves JOIN tops USING (tree)
  UNION ALL
  SELECT w.doc_id, w.leaf, w.tree, w.high, w.subroot,
         CASE WHEN NOT w.up AND w.level = w.high THEN 0 ELSE w.level + 1 END, CASE WHEN NOT w.up AND w.level = w.high THEN w.tree ELSE w.idx // 16 END,
         CASE WHEN NOT w.up AND w.level = w.high THEN w.h ELSE sha256(coalesce(s.l, t.l) || w.h || coalesce(s.r, t.r)) END,
         w.proof || coalesce(s.l, t.l, '') || coalesce(s.r, t.r, ''), w.up OR w.level = w.high
  FROM walks w LEFT JOIN steps s ON NOT w.up AND s.tree = w.tree AND s.level = w.level AND s.idx = w.idx LEFT JOIN top_steps t ON w.up AND t.level = w.level AND t.idx = w.idx
  WHERE NOT w.up OR w.level < (SELECT max(level) FROM upper_nodes)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = root AS verified
FROM walks w, (SELECT h AS root FROM upper_nodes WHERE n = 1) WHERE up AND level = (SELECT max(level) FROM upper_nodes)
"""
