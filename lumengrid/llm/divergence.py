"""How far the sources of a language differ in their words.

Terms are counted inside the tasks that read the texts, so what is shuffled is a count for each
term of a group and task. The common terms of a language fall into blocks; a block's counts become
one dense table of whole numbers, groups by terms, in which every pair of groups is compared by
broadcasting. The matrices of pairs are added up over the blocks, and each group's heap of leading
terms is merged with those of the other blocks. Where a language has many sources, they fall into
blocks too, and each two of these meet in a task of their own.

All arithmetic is on whole numbers and exact as long as a language has less than 9e15 words.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, tidy, written

#: A share is a whole number of billionths, found thousand by thousand.
_SCALE_STEPS = 3
#: Terms and sources of a block, about.
TERMS, SOURCES = 512, 128
#: A task hands on its counts when it holds so many.
_HELD = 400_000
_SLICE = 4 << 20

# letters of ASCII in lower case and all bytes of other characters; the rest parts terms
_TERM = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in slices of some MB."""
    data = text.encode().translate(_TERM)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and numbers of documents by (lang, source, term); a null term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def table() -> pa.RecordBatch:
        rows = [(g, t, n, docs[t]) for g, (counts, docs) in held.items() for t, n in counts.items()]
        columns = [pa.array([r[0][i] for r in rows], pa.string()) for i in (0, 1)]
        columns += [pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema=_COUNTS)

    for batch in batches:
        for part in small_batches([batch], "text", 8 << 20):
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                counts, docs = held.setdefault((lang or "", source or ""), (Counter({None: 0}), Counter()))
                docs[None] += 1
                distinct: set[bytes] = set()
                for some in terms_of(text or ""):
                    counts.update(some)
                    distinct.update(some)
                docs.update(distinct)
            if sum(len(c) for c, _ in held.values()) > _HELD:
                yield table()
                held.clear()
    yield table()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences of each term in each group, and in how many of its
    rows it is; the row with a null term stands for the group. Null lang and source are the empty one."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * counts / total), exact for totals below 9e15."""
    out, rest = counts // total, counts % total
    for _ in range(_SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _tile(least: int, most: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A task's work on one block of terms and two blocks of sources of a language. ``least`` is added to
    each count, ``most`` is how many terms of a group are handed on."""

    def heap(p: np.ndarray, q: np.ndarray, counts: np.ndarray, terms: list[bytes]) -> list[tuple[int, bytes]]:
        far = p - q
        at = np.flatnonzero((counts > 0) & (far > 0))
        if len(at) > most:
            at = at[far[at] >= np.partition(far[at], -most)[-most]]
        return heapq.nsmallest(most, ((-int(far[t]), terms[t]) for t in at))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, _, i, j = (k.as_py() for k in key)
        group = np.array([t is None for t in table.column("term").to_pylist()], bool)
        source = np.array([s.encode() for s in table.column("source").to_pylist()], object)
        count, total, block = (table.column(c).to_numpy() for c in ("count", "total", "block"))
        v, wide = int(table.column("v")[0].as_py()), int(table.column("wide").to_numpy()[group][0])
        words = [t.encode() for t in table.column("term").to_pylist() if t is not None]
        terms, column = np.unique(np.array(words, object), return_inverse=True) if words else (np.array([], object), np.array([], int))
        sums = np.zeros(len(terms), np.int64)
        sums[column] = total[~group]
        rows: list[tuple[bytes, str, bytes, int]] = []

        def dense(b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = group & (block == b)
            names, place = np.unique(source[own], return_inverse=True)
            size = np.empty(len(names), np.int64)
            size[place] = count[own]
            here = block[~group] == b
            counts = np.zeros((len(names), len(terms)), np.int64)
            counts[np.searchsorted(names, source[~group][here]), column[here]] = count[~group][here]
            # the last column: the share of terms that none of these groups has
            padded = np.pad(counts, ((0, 0), (0, 1)))
            return names, counts, shares(padded + least, size[:, None] + least * v) if wide else padded

        names, counts, p = dense(i)
        others, _, r = (names, counts, p) if i == j else dense(j)
        weight = np.append(np.ones(len(terms), np.int64), wide - len(terms))
        step = max(1, (4 << 20) // max(1, r.size))
        for lo in range(0, len(names), step):
            apart = np.abs(p[lo : lo + step, None, :] - r[None, :, :]) @ weight
            for a, values in enumerate(apart, lo):
                rows += [(names[a], "pair", others[b], int(values[b])) for b in range(a + 1 if i == j else 0, len(others))]
        if i == j and len(terms):
            q = shares(sums + least, int(total[group][0]) + least * v)
            for a, name in enumerate(names):
                rows += [(name, "term", t, -minus) for minus, t in heap(p[a, : len(q)], q, counts[a], terms.tolist())]
        text = lambda k: pa.array([x[k] for x in rows], pa.binary()).cast(pa.string())
        return pa.table([pa.array([lang] * len(rows), pa.string()), text(0), pa.array([x[1] for x in rows], pa.string()), text(2), pa.array([x[3] for x in rows], pa.int64())], schema=_FOUND)

    return run


def source_divergence(docs: DataFrame, min_docs: int = 30, least: int = 5, most: int = 50, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank) from documents (text, lang, source).

    Part ``pair``: how far a group's shares of the terms that ``min_docs`` rows of its language have are
    from those of each other source of the language, summed over the terms. Part ``term``: the ``most``
    terms that a group uses more than its language. A share is counted in billionths, with ``least`` added
    to each count. Null text, lang and source are empty ones, repeated rows count each, a language
    without common terms has pairs of value 0, an empty table gives nothing; other columns aren't looked at.
    """
    counts = written(term_counts(docs), "divergence-counts")
    real = counts.where("term is not null")
    kept = real.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= min_docs).drop("docs")
    kept = written(kept, "divergence-terms")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    used = written(real.drop("docs").join(kept, ["lang", "term"]), "divergence-kept")
    sizes = used.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left")
    many = groups.groupBy("lang").agg(F.count("*").alias("s"))
    langs = many.join(of_lang, "lang", "left").select(
        "lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"), F.ceil(F.col("s") / sources).alias("s_blocks"), F.greatest(F.ceil(F.col("v") / terms), F.lit(1)).alias("t_blocks")
    )
    langs = written(langs, "divergence-languages")

    block = F.pmod(F.xxhash64("source"), F.col("s_blocks")).alias("block")
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("s_blocks") - 1)).alias("other")
    columns = ["lang", "t", "block", "other", "source", "term", "count", "total", "v", "wide"]
    t_of = F.pmod(F.xxhash64("term"), F.col("t_blocks")).alias("t")
    wide = kept.join(langs, "lang").select("lang", t_of).groupBy("lang", "t").agg(F.count("*").alias("wide"))
    cells = used.join(langs, "lang").select("*", block, t_of, F.lit(0).cast("long").alias("wide")).select("*", meets).select(*columns)
    # each group stands in every block of terms, those it has none of too
    heads = groups.join(langs, "lang").select("*", block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("t_blocks") - 1)).alias("t")).join(wide, ["lang", "t"], "left").select("*", meets)
    heads = heads.select("lang", "t", "block", "other", "source", F.lit(None).cast("string").alias("term"), F.coalesce("n", F.lit(0)).alias("count"), F.col("n_lang").alias("total"), "v", F.coalesce("wide", F.lit(0)).alias("wide"))
    rows = cells.unionByName(heads).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = rows.groupBy("lang", "t", "i", "j").applyInArrow(_tile(least, most), "lang string, source string, part string, item string, value long")
    found = written(found, "divergence-found")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    back = pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    both = pairs.unionByName(back).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(own))
    leading = found.where("part = 'term'").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)
    discard(kept, used, counts, langs)
    return ranked.unionByName(leading)


#: The same by joins of all shares.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), tokens AS (
  SELECT r, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (g.size + 5 * l.v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.total + 5)) // (l.n_lang + 5 * l.v) AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""
