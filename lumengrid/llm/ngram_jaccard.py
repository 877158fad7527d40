"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

Every pair of different shingle sets whose Jaccard similarity reaches the threshold is found,
or is joined through a chain of such pairs; nothing is sampled or capped.

1. Each text becomes a sorted array of 64-bit shingle hashes; equal arrays form one class.
2. Sizes fall into bands. If J(x, y) >= t and the larger set is in band b, the sets differ in
   at most H(b) shingles, so of m > H(b) parts of the hash range (a shingle's part is read
   from its hash) at least m - H(b) hold exactly the same shingles. A class sends a signature
   of each part, for its own band and for each higher band it can have a partner in. Parts
   with few shingles say little: each class leaves out those of up to q shingles, for the
   largest q that leaves out fewer than m - H(b) parts. Of two linked classes take the larger
   q: the parts up to it are fewer than the equal parts, so an equal part remains in both.
   Classes under one (band, part, content) meet; all that meet with the same least class
   form a tile.
3. Each class is compared with the least class of its tiles: bitmaps bound the overlap from
   above, and the pairs that pass are intersected exactly. In tiles that these links leave in
   pieces, one class of each piece is compared with one of the first piece.
4. Tiles still in pieces are compared in full, in blocks, but only pairs of different pieces.
   Texts are fetched for the classes that bitmaps leave a pair, and pairs are intersected
   exactly until the pieces that have a link are joined.
5. Components of all links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, mix, shards, small_batches, spans, tidy, unpacked, unpacked_batches, written
from ..operators.components import components

GROWTH = 1.18
#: A block of a tile has so many classes, and so many shingles in all, or less.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: What follows a class is dealt to so many lots, so that no task has all of a class's pairs.
LOTS = 1024
_FLUSH = 1 << 19
#: So many classes a task remembers as sent.
_SEEN = 1 << 17
#: The bitmap of classes that share a tile has so many words of 64 bits at most: 4 MB, whatever the input.
MARK_WORDS = 1 << 18


# ---------------------------------------------------------------- sets of shingles


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than k words is one shingle."""
    words = Words(texts, lower=True)
    out = []
    every = spans(words.hash, k)
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        if hi - lo >= k:
            out.append(np.unique(every[lo : hi - k + 1]))
        elif hi > lo:
            out.append(spans(words.hash[lo:hi], int(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(hashes: np.ndarray) -> int:
    """A 64-bit number for a sorted array, as a signed long."""
    with np.errstate(over="ignore"):
        order = np.arange(1, len(hashes) + 1, dtype=np.uint64)
        return int(mix(np.array([(mix(hashes + order)).sum() + np.uint64(len(hashes))], dtype=np.uint64)).view(np.int64)[0])


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bits set at the hashes; of a power of two of bits, at least twice the set's size up to 2**14."""
    bits = 256
    while bits < 2 * len(hashes) and bits < 1 << 14:
        bits *= 2
    flat = np.zeros(bits, dtype=bool)
    flat[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flat, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


# ---------------------------------------------------------------- bands and signatures


def band_tops(limit: int) -> list[int]:
    tops = [8]
    while tops[-1] < limit:
        tops.append(int(tops[-1] * GROWTH) + 1)
    return tops


_TOPS = band_tops(1 << 40)


def band_parts(band: int, num: int, den: int) -> tuple[int, int]:
    """(H, m): the most shingles that two linked sets of this band differ in; the parts to cut into."""
    top = _TOPS[band]
    most = (den - num) * 2 * top // (den + num)
    return most, most + 1 + (most + 1) // 4 + 1


def signatures(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of the parts, for each band in which this set can be one of a linked pair."""
    n = len(hashes)
    out = []
    band = int(np.searchsorted(_TOPS, n))
    while True:
        most, parts = band_parts(band, num, den)
        if most:
            # sorted hashes: a part is a range of the hash space, so its members lie together
            part = (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            held = np.bincount(part.astype(np.int64), minlength=parts)
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)])
                edges = np.concatenate([[0], np.cumsum(held)])
                body = sums[edges[1:]] - sums[edges[:-1]]
                sig = mix(body + mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)))
            # the most shingles of the parts - most - 1 thinnest, less those that share it with others
            least = np.partition(held, parts - most - 1)[parts - most - 1]
            out.append(sig[held >= least])
        # the next band's sets have more than top shingles; a partner has at least num/den of that
        if den * n < num * (_TOPS[band] + 1):
            break
        band += 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# ---------------------------------------------------------------- tasks


@tidy
def _profile(batches: Iterator[pa.RecordBatch], k: int, schema: pa.Schema, whole: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, class, first, text) and what is carried: the class is null for a text without words.
    ``first``: this task has not met the class before. The text goes along, compressed, with these, or with all rows."""
    press = zstandard.ZstdCompressor(level=3)
    seen: set[int] = set()
    for batch in small_batches(batches, "text"):
        sets = shingle_sets(batch.column("text").fill_null(""), k)
        names = [digest(s) if len(s) else None for s in sets]
        first, texts = [], []
        for name, text in zip(names, batch.column("text"), strict=True):
            fresh = name is not None and name not in seen
            if fresh:
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(name)
            first.append(fresh)
            texts.append(press.compress(text.as_py().encode()) if fresh or whole and text.is_valid else None)
        found = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), pa.array(first, pa.bool_()), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays([*found, *batch.columns[2:]], names=schema.names)


@tidy
def _send(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, n_shards: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Signatures, packed for each shard they belong to: hashes, and the classes they come from.
    A class that this task has already sent is not sent again."""
    seen: set[int] = set()
    sigs: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        sig, own = np.concatenate(sigs), np.concatenate(owners)
        to = (sig >> np.uint64(33)) % np.uint64(n_shards)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(n_shards + 1))
        sig, own = sig[order], own[order]
        rows = [(i, sig[a:b].tobytes(), own[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=schema)

    for batch in small_batches(batches, "text"):
        for hashes in shingle_sets(batch.column("text").fill_null(""), k):
            if len(hashes) and (name := digest(hashes)) not in seen:
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(name)
                sig = signatures(hashes, num, den)
                if len(sig):
                    sigs.append(sig)
                    owners.append(np.full(len(sig), name, dtype=np.int64))
                    held += len(sig)
        if held >= _FLUSH:
            yield flush()
            sigs, owners, held = [], [], 0
    if held:
        yield flush()


@tidy
def _tiles(table: pa.Table) -> pa.Table:
    """(tile, class) of classes that meet another; a tile is named by its least class."""
    sig = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("sig")])
    own = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("own")])
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    tile = np.repeat(own[at], np.diff(np.append(at, len(sig))))
    met = tile != own
    pairs = np.unique(np.stack([tile[met], own[met]]), axis=1)
    heads = np.unique(pairs[0])
    return pa.table({"tile": np.concatenate([pairs[0], heads]), "class": np.concatenate([pairs[1], heads])})


@tidy
def _members(batches: Iterator[pa.RecordBatch], k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(class, size, bits, text). The text stays compressed: it is a third of the size of its array of hashes."""
    for batch, texts in unpacked_batches(batches, "text"):
        sets = shingle_sets(pa.array(texts, pa.binary()), k)
        columns = [batch.column("class"), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x).tobytes() for x in sets], pa.binary()), batch.column("text")]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def least_common(n: int, m: int, num: int, den: int) -> int:
    """The least intersection with which sets of n and m reach num / den: den * c >= num * (n + m - c)."""
    return -(-num * (n + m) // (num + den))


@tidy
def _fitting(batches: Iterator[pa.RecordBatch], num: int, den: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of pairs with their bitmaps, those whose overlap the bit counts don't bound below the threshold."""
    for batch in batches:
        col = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        keep = []
        for i, (n, m, x, y) in enumerate(zip(col["size_a"], col["size_b"], col["bits_a"], col["bits_b"], strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            w = min(len(x), len(y))
            x, y = fold(x, w), fold(y, w)
            if min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum())) >= least_common(n, m, num, den):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([col[c][i] for i in keep], pa.int64()) for c in ("a", "b")], schema=schema)


@tidy
def _linked(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in order of (a, lot, kind): a class, then those that may follow it. Of these, the pairs that
    reach the threshold."""
    now, head = None, np.zeros(0, np.uint64)
    for batch, texts in unpacked_batches(batches, "text"):
        rows = []
        for a, kind, b, own in zip(*(batch.column(c).to_pylist() for c in ("a", "kind", "b")), shingle_sets(pa.array(texts, pa.binary()), k), strict=True):
            if kind == 0:
                now, head = a, own
            elif a == now and len(np.intersect1d(head, own, assume_unique=True)) >= least_common(len(head), len(own), num, den):
                rows.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(2)], schema=schema)


class Block:
    """One block, or pair of blocks, of a tile: its classes in order of size."""

    def __init__(self, table: pa.Table, num: int, den: int):
        t = table.to_pydict()
        self.num, self.den = num, den
        size = np.array(t["size"], dtype=np.int64)
        self.order = np.lexsort((np.array(t["class"], dtype=np.int64), size))
        self.size = size[self.order]
        self.name = np.array(t["class"], dtype=np.int64)[self.order]
        self.root = np.array(t["root"], dtype=np.int64)[self.order]
        self.side = np.array(t["side"], dtype=np.int64)[self.order]
        self.two = t["left"][0] != t["right"][0]
        bits = [np.frombuffer(t["bits"][i], np.uint64) for i in self.order]
        self.width = np.array([len(b) for b in bits], dtype=np.int64)
        # for each width: where it begins in order of size, and the bitmaps of this width and of twice this width
        self.bits: dict[int, tuple[int, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            lo, hi = np.searchsorted(self.width, [w, 2 * w + 1])
            self.bits[w] = (int(lo), np.stack([fold(b, w) for b in bits[lo:hi]]))

    def survivors(self) -> Iterator[tuple[int, np.ndarray]]:
        """(i, places) of pairs of different pieces that bitmaps don't rule out."""
        for i in range(len(self.size)):
            # sizes from size[i] up to size[i] * den / num
            hi = int(np.searchsorted(self.size, self.size[i] * self.den // self.num, side="right"))
            if hi <= i + 1:
                continue
            ok = self.root[i + 1 : hi] != self.root[i]
            if self.two:
                ok &= self.side[i + 1 : hi] != self.side[i]
            at = np.flatnonzero(ok) + i + 1
            if len(at):
                need = least_common(self.size[i], self.size[at], self.num, self.den)
                fits = np.ones(len(at), dtype=bool)
                lo, bits = self.bits[int(self.width[i])]
                near = at - lo < len(bits)
                mine, theirs = bits[i - lo], bits[at[near] - lo]
                fits[near] = self.size[i] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64) >= need[near]
                fits[near] &= self.size[at[near]] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64) >= need[near]
                if fits.any():
                    yield i, at[fits]


@tidy
def _to_verify(table: pa.Table, num: int, den: int) -> pa.Table:
    """The classes of a block that have a pair left."""
    block = Block(table, num, den)
    left = np.zeros(len(block.size), dtype=bool)
    for i, at in block.survivors():
        left[i] = left[at] = True
    return table.select(["tile", "left", "right", "class"]).take(pa.array(np.sort(block.order[left]), pa.int64()))


@tidy
def _links_of(table: pa.Table, k: int, num: int, den: int) -> pa.Table:
    """The pairs left, intersected exactly until they join a block's pieces: a link for each joining."""
    block = Block(table, num, den)
    texts = table.column("text").to_pylist()
    sets = shingle_sets(pa.array(unpacked([texts[i] for i in block.order]), pa.binary()), k)
    parent = {r: r for r in block.root.tolist()}

    def piece(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    got: list[tuple[int, int]] = []
    root, name = block.root.tolist(), block.name.tolist()
    for i, at in block.survivors():
        for j in at.tolist():
            a, b = piece(root[i]), piece(root[j])
            if a != b:
                x, y = sets[i], sets[j]
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if int((y[place] == x).sum()) >= least_common(len(x), len(y), num, den):
                    parent[a] = b
                    got.append((min(name[i], name[j]), max(name[i], name[j])))
    return pa.table({"a": pa.array([g[0] for g in got], pa.int64()), "b": pa.array([g[1] for g in got], pa.int64())})


# ---------------------------------------------------------------- the join


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose class is in ``wanted``, and a few others: a class is a hash, its lower bits choose a word of a
    bitmap and its upper ones a bit of that. The bitmap is broadcast, as it has ``MARK_WORDS`` words at most."""
    word = F.col("class").bitwiseAND(F.lit(MARK_WORDS - 1)).alias("_word")
    bit = F.shiftrightunsigned("class", 58).cast("int").alias("_bit")
    bits = F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits")
    marks = wanted.select(word, bit).groupBy("_word").agg(bits)
    found = rows.select("*", word, bit).join(F.broadcast(marks), "_word").where("(shiftrightunsigned(_bits, _bit) & 1L) = 1L")
    return found.drop("_word", "_bit", "_bits")


def near_duplicate_groups(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, whole: bool = False) -> DataFrame:
    """(doc_id, n_shingles, class, component_id) for every row of ``docs`` (doc_id long, text string).
    With ``whole`` the text, compressed as by ``packed_text``, and a column ``carried`` come back too, so that ``docs`` needn't be read again.

    Two texts link when ``den * |x & y| >= num * |x | y|`` for their sets of k-word shingles of
    lower-cased words. ``component_id`` is the smallest doc_id that links reach, itself included.

    Null or wordless text: size 0, class null, its own component. Null doc_id: kept; it counts
    for no component_id but where a component has no other. Repeated rows and equal texts
    are one class and come back each. Other columns of ``docs`` are not looked at. Equality of
    shingles is that of 64-bit hashes.
    """
    spark = docs.sparkSession
    more = ["carried"] if whole else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    arrow = lambda **f: pa.schema(list(f.items()))
    ddl = "doc_id long, n_shingles long, class long, first boolean, text binary" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    names = pa.schema([(c.split(" ")[0], pa.null()) for c in ddl.split(", ")[:5]] + [(c, pa.null()) for c in more])
    profile = written(docs.mapInArrow(partial(_profile, k=k, schema=names, whole=whole), ddl), "jaccard-profile")
    sent = docs.select("text").mapInArrow(
        partial(_send, k=k, num=num, den=den, n_shards=shards(spark), schema=arrow(shard=pa.int64(), sig=pa.binary(), own=pa.binary())),
        "shard long, sig binary, own binary",
    )
    tiles = written(sent.groupBy("shard").applyInArrow(_tiles, "tile long, class long").distinct(), "jaccard-tiles")

    # the texts of classes that share a tile with another; those that the bitmap of such classes doesn't
    # mark stay where they are, and the join settles the rest (an inner one: a semi join would go below the bitmap)
    wanted = tiles.select("class").distinct()
    members = written(
        _marked(profile.where("first").select("class", "text"), wanted).join(wanted, "class").dropDuplicates(["class"])
        .mapInArrow(partial(_members, k=k, schema=arrow(**{"class": pa.int64()}, size=pa.int64(), bits=pa.binary(), text=pa.binary())), "class long, size long, bits binary, text binary"),
        "jaccard-members",
    )
    pair = arrow(a=pa.int64(), b=pa.int64())
    fit = partial(_fitting, num=num, den=den, schema=pair)
    link = partial(_linked, k=k, num=num, den=den, schema=pair)

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda s, *cols: members.select(F.col("class").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols])
        near = (F.col("size_a") * den >= F.col("size_b") * num) & (F.col("size_b") * den >= F.col("size_a") * num)
        sized = pairs.join(side("a", "size", "bits"), "a").join(side("b", "size", "bits"), "b").where(near)
        lot = F.pmod(F.xxhash64("b"), F.lit(LOTS)).alias("lot")
        may = written(sized.mapInArrow(fit, "a long, b long").select("a", "b", lot), "jaccard-may")
        # a text goes once to each lot of those that may follow its class
        heads = may.select("a", "lot").distinct().join(members.select(F.col("class").alias("a"), "text"), "a").select("a", "lot", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
        rest = may.join(members.select(F.col("class").alias("b"), "text"), "b").select("a", "lot", F.lit(1).alias("kind"), "b", "text")
        streams = heads.unionByName(rest).repartition(shards(spark), "a", "lot").sortWithinPartitions("a", "lot", "kind")
        out = written(streams.mapInArrow(link, "a long, b long"), "jaccard-links")
        discard(may)
        return out

    def rooted(roots: DataFrame) -> DataFrame:
        """(tile, class, root, least) of tiles that (class, root) leaves in several pieces."""
        own = tiles.join(roots, "class", "left").select("tile", "class", F.coalesce("root", "class").alias("root"))
        open_ = own.groupBy("tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        return written(own.join(open_.select("tile", F.col("lo").alias("least")), "tile"), "jaccard-open")

    # each class with the least leader of its tiles
    links = verified(tiles.where("class <> tile").groupBy("class").agg(F.min("tile").alias("a")).select("a", F.col("class").alias("b")))

    # then, in tiles still in pieces, one class of each piece with one of the first piece
    # a class has one link downwards: two steps of it bring most to one root, and those that it
    # doesn't are only compared once more than they need
    down = links.select(F.col("a").alias("root"), F.col("b").alias("class"))
    open_ = rooted(down.join(links.select(F.col("b").alias("root"), F.col("a").alias("_below")), "root", "left").select("class", F.coalesce("_below", "root").alias("root")))
    if not open_.isEmpty():
        pieces = open_.groupBy("tile", "root", "least").agg(F.min("class").alias("class"))
        heads = pieces.where("root = least").select("tile", F.col("class").alias("head"))
        again = pieces.where("root <> least").join(heads, "tile").select(F.least("head", "class").alias("a"), F.greatest("head", "class").alias("b")).distinct()
        links = links.unionByName(verified(again))
        open_ = rooted(components(links).withColumnRenamed("node", "class"))

    # what is in pieces now is compared in full, in blocks; texts come for what bitmaps leave
    def to_verify(table: pa.Table) -> pa.Table:
        return _to_verify(table, num, den)

    def links_of(table: pa.Table) -> pa.Table:
        return _links_of(table, k, num, den)

    if not open_.isEmpty():
        own = members.select("class", "size")
        large = open_.join(own, "class").groupBy("tile").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        placed = written(
            open_.join(large, "tile").join(members.select("class", "size", "bits"), "class")
            .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("tile", "class", "root", "size", "bits", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), F.col("block").alias("side")),
            "jaccard-blocks",
        )
        left = written(placed.groupBy("tile", "left", "right").applyInArrow(to_verify, "tile long, left int, right int, class long"), "jaccard-left")
        final = placed.join(left, ["tile", "left", "right", "class"]).join(members.select("class", "text"), "class")
        links = links.unionByName(written(final.groupBy("tile", "left", "right").applyInArrow(links_of, "a long, b long"), "jaccard-links"))
        discard(placed, left)
    discard(tiles, members)
    groups = components(links)

    # from classes to documents
    classes = profile.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted_classes = classes.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = rooted_classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted_classes.join(smallest, "root").select("class", "component_id")
    placed = profile.join(named, "class", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return placed.select("doc_id", "n_shingles", "class", "component_id", *(["text", "carried"] if whole else []))
