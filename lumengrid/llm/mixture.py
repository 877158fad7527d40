"""Mixing sources to target weights by Pareto order sampling; DataFrame functions alone.

A source of S words with target T takes floor(T / S) whole copies of each document for
certain. The rest, R = T - floor(T / S) * S words, comes from a sample without repeats in which
documents have unequal chances: a document's inclusion probability is p = min(1, L * w), w being
its size with all but the 4 leading bits cleared (times its own weight, where given), and L is
such that the words expected, the sum of p * size, are R. Documents with p = 1 are
certain; the others are ranked by their random odds u / (1 - u) divided by their inclusion
odds p / (1 - p), and taken in that order as long as their words fit into R. One closing
document, the one whose size comes closest to what is left, then brings the source to its
target.

No window holds a source. L is found from sums over the sizes with cleared bits, of which
there are at most 8 for each power of two. Where the order crosses R is found by counting
words in bins of the rank twice, the second time inside the bin where the first crossed; as
the sum of p is what is taken, that is near odds of 1, where bins aren't crowded. So a source
with a third of all rows is counted by all tasks. Only the sources themselves, one row each,
meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, written

BINS = 4096
LEADING = 4


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share[0] / share[1]`` of all words by weight; none gets more than ``most`` times its own
    words, and what it can't take is shared again among the rest.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    # Full sources are those with the least cap for their weight: level = what a weight of 1 gets
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))
    onward = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * share[0] / share[1]
    level = (total - F.coalesce(before, F.lit(0))) / onward
    leveled = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    lowest = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(lowest, F.lit(0.0)) * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def uniform(row: Column, ordinal: Column, seed: str) -> Column:
    """A number in (0, 1) that is the same in every run, from md5 of seed, row and ordinal."""
    hex13 = F.substring(F.md5(F.concat_ws("|", F.lit(seed), row, ordinal.cast("string"))), 1, 13)
    return (F.conv(hex13, 16, 10).cast("double") + 0.5) / float(1 << 52)


def leading_bits(size: Column) -> Column:
    """The size with all but its LEADING leading bits cleared."""
    spare = F.greatest(F.length(F.bin(size)) - LEADING, F.lit(0))
    unit = F.pow(F.lit(2.0), spare).cast("long")
    return F.floor(size / unit).cast("long") * unit


def ordinals(rows: DataFrame) -> DataFrame:
    """(_seq, _ordinal) of rows that stand for the same document: from 1 on, whatever the partitions.

    Rows are numbered inside their partition, and partitions follow each other: no window holds
    more of a row's repeats than one partition does.
    """
    slim = rows.select("_row", "_part", "_seq")
    each = slim.groupBy("_row", "_part").agg(F.count("*").alias("n"))
    several = each.groupBy("_row").agg(F.sum("n").alias("all")).where("all > 1").select("_row")
    before = F.sum("n").over(Window.partitionBy("_row").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = each.join(several, "_row").select("_row", "_part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("_row", "_part").orderBy("_seq"))
    return slim.join(starts, ["_row", "_part"]).select("_seq", (own + F.col("before")).cast("long").alias("_ordinal"))


def inclusion_levels(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(of, lambda): the L of each source with which the sum of min(1, L * w) * size is what is wanted.

    ``sized`` has (of, w, size). Rows come down to a row for each w before they meet.
    """
    by_w = sized.groupBy("of", "w").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("of").orderBy("w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("of").orderBy("w").rowsBetween(1, Window.unboundedFollowing)
    # if all above w are certain
    tilted = F.sum(F.col("w") * F.col("words")).over(up)
    sure = F.coalesce(F.sum("words").over(down), F.lit(0))
    tried = by_w.join(plan.select("of", "wanted"), "of").withColumn("lambda", F.try_divide(F.col("wanted") - sure, tilted.cast("double")))
    return tried.where("lambda > 0 and lambda * w <= 1").groupBy("of").agg(F.max_by("lambda", "w").alias("lambda"))


def pareto_mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: str = "mix",
    weight: Column | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for every row of ``docs``, and its columns ``carry``.

    ``taken`` is 0, 1 or up to ``most`` times ``size`` and depends on ``seed`` and the rows
    alone. ``weight`` (1 or more, whole numbers; null counts as 1) multiplies a document's chance.
    Null text or text without words: size 0, taken 0. Null source: a source of its own, last
    in order. Rows that share a doc_id, or have none, have chances of their own, by their text; of rows
    that are equal in all three each has its own too, in no order. An empty table gives an
    empty result. Other columns of ``docs`` are looked at only if named in ``carry``; one that is named like
    a column of the result comes back as ``carried_`` and its name.
    """
    row = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))), F.coalesce(F.col("source").cast("string"), F.lit(""))))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            # one key for joins: equality of a nullable source
            F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name")).alias("of"),
            words.alias("size"),
            (leading_bits(words) * F.coalesce((weight if weight is not None else F.lit(1)).cast("long"), F.lit(1))).alias("w"),
            row.alias("_row"),
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().alias("_seq"),
            *[F.col(c).alias(f"_carry_{c}") for c in carry],
        ),
        "mixture-sizes",
    )
    sizes = base.groupBy("of").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes.select(F.when(~F.col("of.none"), F.col("of.name")).alias("source"), "source_size"), weights, share, most)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    plan = written(
        targets.withColumn("sure", F.floor(rate).cast("long"))
        .withColumn("wanted", F.col("target") - F.col("sure") * F.col("source_size"))
        .withColumn("of", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))),
        "mixture-plan",
    )
    level = written(inclusion_levels(base.where("size > 0").select("of", "w", "size"), plan.where("wanted > 0")), "mixture-levels")
    repeated = written(ordinals(base), "mixture-repeats")
    drawn = base.join(repeated, "_seq", "left").join(level, "of", "left").withColumn("p", F.when((F.col("size") > 0) & F.col("lambda").isNotNull(), F.least(F.lit(1.0), F.col("lambda") * F.col("w"))))
    u = uniform(F.col("_row"), F.coalesce("_ordinal", F.lit(1).cast("long")), seed)
    odds = F.when(F.col("p") >= 1, 0.0).otherwise((u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    drawn = drawn.withColumn("rank", odds / (1 + odds))
    ranked = written(drawn.where("p > 0").select("of", "_seq", "size", "rank"), "mixture-ranked")

    # twice: words before the bin of the rank where the order crosses what is wanted, and that bin
    at = plan.where("wanted > 0").select("of", "wanted", F.lit(0.0).alias("before"), F.lit(0).cast("long").alias("bin"))
    width = 1
    for _ in range(2):
        finer = F.floor(F.col("rank") * (width * BINS)).cast("long")
        inside = ranked.withColumn("fine", finer).withColumn("bin", F.floor(F.col("fine") / BINS).cast("long")).join(at, ["of", "bin"])
        sums = inside.groupBy("of", "fine").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("of").orderBy("fine"))
        crossing = sums.withColumn("upto", upto).where("upto > wanted").groupBy("of").agg(F.min_by(F.struct("fine", "wanted", (F.col("upto") - F.col("words")).alias("before")), "fine").alias("x"))
        at = written(crossing.select("of", "x.wanted", "x.before", F.col("x.fine").alias("bin")), "mixture-crossing")
        width *= BINS
    last = ranked.withColumn("bin", F.floor(F.col("rank") * width).cast("long")).join(at, ["of", "bin"])
    walked = last.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("of").orderBy("rank", "_seq")))
    first = F.min(F.when(F.col("upto") > F.col("wanted"), F.struct("rank", "_seq", (F.col("wanted") - F.col("upto") + F.col("size")).alias("gap"))))
    cut = written(walked.groupBy("of").agg(first.alias("x")).select("of", F.col("x.rank").alias("cut_rank"), F.col("x._seq").alias("cut_seq"), F.col("x.gap").alias("gap")), "mixture-cut")
    before_cut = F.col("cut_rank").isNull() | (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("_seq") < F.col("cut_seq")))
    open_ = ranked.join(cut, "of").where(~before_cut).withColumn("miss", F.abs(F.col("size") - F.col("gap"))).where("miss < gap")
    closing = open_.groupBy("of").agg(F.min(F.struct("miss", "rank", "_seq")).alias("c")).select("of", F.col("c._seq").alias("closing_seq"))
    ends = written(plan.join(cut, "of", "left").join(closing, "of", "left").drop("wanted"), "mixture-ends")
    discard(ranked, at, cut)

    extra = F.coalesce((F.col("p") > 0) & (before_cut | (F.col("_seq") == F.col("closing_seq"))), F.lit(False))
    own = ("size", "source_size", "target", "taken")
    taken = (F.col("size") * (F.col("sure") + extra.cast("long"))).alias("taken")
    return drawn.join(ends, "of").select("doc_id", "size", "source", "source_size", "target", taken, *[F.col(f"_carry_{c}").alias(f"carried_{c}" if c in own else c) for c in carry if c not in ("doc_id", "source")])


#: The same by windows over whole sources, for comparison on small tables.
SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')), coalesce(source, ''))) AS row_key
  FROM documents
), base AS (
  SELECT doc_id, source, size, CAST(floor(size / unit) AS BIGINT) * unit AS w,
         (CAST(CAST('0x' || substr(md5('mix|' || row_key || '|' || row_number() OVER (PARTITION BY row_key)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT *, CAST(1 AS BIGINT) << greatest(length(bin(size)) - 4, 0) AS unit FROM rows)
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS cap FROM sizes
), leveled AS (
  SELECT *, (sum(source_size) OVER () * 3 / 2.0 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed
), plan AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, cap / weight) FROM leveled WHERE level * weight <= cap), 0) * weight) AS target
  FROM leveled
), split AS (
  SELECT *, target - sure * source_size AS wanted FROM (SELECT *, CAST(floor(CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END) AS BIGINT) AS sure FROM plan)
), tried AS (
  SELECT b.source, w, (wanted - coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0))
                    / CAST(sum(w * words) OVER (PARTITION BY b.source ORDER BY w) AS DOUBLE) AS pull
  FROM (SELECT source, w, sum(size) AS words FROM base WHERE size > 0 GROUP BY source, w) b JOIN split s ON b.source IS NOT DISTINCT FROM s.source WHERE wanted > 0
), levels AS (
  SELECT source, arg_max(pull, w) AS pull FROM tried WHERE pull > 0 AND pull * w <= 1 GROUP BY source
), drawn AS (
  SELECT b.*, source_size, target, sure, wanted, CASE WHEN size > 0 AND pull IS NOT NULL THEN least(1.0, pull * w) END AS p
  FROM base b JOIN split s ON b.source IS NOT DISTINCT FROM s.source LEFT JOIN levels l ON b.source IS NOT DISTINCT FROM l.source
), ranked AS (
  SELECT *, odds / (1 + odds) AS rank FROM (SELECT *, CASE WHEN p >= 1 THEN 0.0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM drawn)
), walked AS (
  SELECT *, CASE WHEN rank IS NOT NULL THEN sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) END AS upto FROM ranked
), gaps AS (
  SELECT *, first_value(CASE WHEN upto > wanted THEN wanted - upto + size END IGNORE NULLS) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS gap
  FROM walked
), closing AS (
  SELECT source, arg_min(u, (abs(size - gap), rank, doc_id)) AS closing_u FROM gaps WHERE upto > wanted AND abs(size - gap) < gap GROUP BY source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (sure + CASE WHEN rank IS NOT NULL AND (upto <= wanted OR u = closing_u) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM gaps g LEFT JOIN closing c ON g.source IS NOT DISTINCT FROM c.source
"""
