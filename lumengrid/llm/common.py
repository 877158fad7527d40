"""What the text operators share: memory of tasks, word hashing, splits by id.

Words are runs of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text, which is the same
as ``[^\\x20\\x09-\\x0D]+`` on code points. Lower-casing touches A-Z alone.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator
from functools import partial, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, written

__all__ = ["discard", "written"]

WORD = r"[^\x20\x09-\x0D]+"


def shards(spark: SparkSession) -> int:
    """How many groups hashed keys are dealt to: the session's shuffle partitions, which
    whoever runs the cluster sets in proportion to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as remainder of the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def thinned(rows: DataFrame, key: Column, some: int, found: int) -> DataFrame:
    """``rows``, of which there are ``found``, or about ``some`` of them where that is clearly less; ``key`` tells rows apart."""
    if found <= 1.2 * some:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("thin"), key), F.lit(1 << 30)) / float(1 << 30) < some / found)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """(doc_id, text, label): about ``limit`` of the labelled training rows, chosen by a hash of doc_id.

    Training rows are those whose crc32(doc_id as text) mod 4 is not 2. Rows without doc_id,
    text or label are left out; of several labels of a document the largest counts. Where ids
    stand for so many rows that they would be more than a fifth over ``limit``, rows are drawn
    each for itself down to it, so the sample is bounded whatever one id holds. At most
    twice ``limit`` ids are broadcast; the texts stay where they are.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (crc_remainder(F.col("doc_id"), 4) != 2))
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(column).cast("double")).alias("label"))
    many = max(ids.count(), 1)
    chance = F.pmod(F.xxhash64(F.lit(column), "_id"), F.lit(1 << 30)) / float(1 << 30)
    some = ids.where(chance < limit / many).limit(2 * limit)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_n"))
    rows = rows.join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    return thinned(rows, F.col("_n"), limit, rows.count()).select("doc_id", "text", "label")


# ---------------------------------------------------------------- columns that an operator doesn't look at


def set_aside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but ``own`` in one column ``carried``, whatever their names are, and what
    puts them back in place, followed by the columns that it is told to add."""
    names, rest = docs.columns, [c for c in docs.columns if c not in own]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    carried = F.struct(F.lit(0).alias("c"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("carried")

    def put_back(df: DataFrame, *added: str) -> DataFrame:
        kept = [(F.col("carried")[f"c{rest.index(c)}"] if c in rest else quoted(c)).alias(c) for c in names if c not in added]
        return df.select(*kept, *added)

    return docs.select(*[quoted(c) for c in names if c in own], carried), put_back


# ---------------------------------------------------------------- memory of tasks

_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Hand memory that is free but still held back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidy(task: Callable) -> Callable:
    """A task's function that releases what it leaves: Python workers go on to other tasks, and
    what one stage has held would else be held beside the next."""

    @wraps(task)
    def stream(*args, **kwargs):
        try:
            yield from task(*args, **kwargs)
        finally:
            release()

    @wraps(task)
    def group(table, *args):
        try:
            return task(table, *args)
        finally:
            release()

    return stream if inspect.isgeneratorfunction(task) else group


# ---------------------------------------------------------------- words as numbers

_ODD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while done < n:
            m = min(done, n - done)
            out[done : done + m] = out[:m] * step
            done += m
            step = step * step
    return out


_UP: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; those that one very long text asks for aren't kept."""
    base, usual = int(_ODD), _CHUNK + 4096
    if n > usual:
        return _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
    if not _UP:
        _UP[:] = [_powers(base, usual), _powers(pow(base, -1, 1 << 64), usual)]
    return _UP[0], _UP[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all bits (one-to-one)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """The words of a few texts: a 64-bit hash each, and where they lie in the bytes.

    Word i of text d is at ``first[d] <= i < first[d + 1]``; its bytes are
    ``data[start[i]:end[i]]``. The hash is that of a polynomial over the bytes modulo 2**64,
    read from prefix sums, so no word is touched on its own.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        # Arrow's own buffers: no Python string is made
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        if n == 0:
            self.data, off = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        else:
            _, offsets, data = texts.buffers()
            off = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * texts.offset)
            data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            self.data = data[off[0] : off[-1]]
            off = off - off[0]
        if lower:
            self.data = _LOWER[self.data]
        size = len(self.data)
        word = ~_SPACE[self.data] if size else np.zeros(0, bool)
        edge = np.zeros(size + 1, dtype=bool)
        edge[off] = True
        before = np.zeros(size, dtype=bool)
        before[1:] = word[:-1]
        after = np.zeros(size, dtype=bool)
        after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~before | edge[:size]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.hash = self._hashes(size)

    def _hashes(self, size: int) -> np.ndarray:
        """Chunk by chunk, cut between words, so that the tables stay small."""
        out = np.empty(len(self.start), dtype=np.uint64)
        lo = 0
        with np.errstate(over="ignore"):
            while lo < len(self.start):
                at = int(self.start[lo])
                hi = max(lo + 1, int(np.searchsorted(self.end, at + _CHUNK, side="right")))
                stop = int(self.end[hi - 1])
                up, down = _tables(stop - at + 1)
                sums = np.zeros(stop - at + 1, dtype=np.uint64)
                np.cumsum((self.data[at:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - at], out=sums[1:])
                s, e = self.start[lo:hi] - at, self.end[lo:hi] - at
                out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
                lo = hi
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def spans(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k words (one fewer than k shorter than ``words``)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))


def small_batches(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each have about ``most`` bytes; one longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


# ---------------------------------------------------------------- texts on their way through a shuffle


@tidy
def _pack(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in small_batches(batches, at, 8 << 20):
        small = pa.array([None if t is None else press.compress(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
        yield batch.set_column(at, batch.schema.names[at], small)


def packed_text(df: DataFrame) -> DataFrame:
    """``df`` with ``text`` compressed to binary, about half of what Spark's own codec leaves of it; null stays null."""
    ddl = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(partial(_pack, at=df.columns.index("text")), ddl)


@tidy
def _unpack(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in unpacked_batches(batches, at, 8 << 20):
        yield batch.set_column(at, batch.schema.names[at], pa.array(texts, pa.binary()).cast(pa.string()))


def unpacked_text(df: DataFrame) -> DataFrame:
    """``df`` with ``text`` as it was before ``packed_text``."""
    ddl = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(partial(_unpack, at=df.columns.index("text")), ddl)


def unpacked(texts: list[bytes | None]) -> list[bytes | None]:
    """The UTF-8 bytes of compressed texts."""
    press = zstandard.ZstdDecompressor()
    return [None if t is None else press.decompress(t) for t in texts]


def unpacked_batches(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices whose compressed texts have about ``most`` bytes when unpacked, and these texts."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        lo, held, size = 0, [], 0
        for i, t in enumerate(batch.column(column)):
            small = t.as_py()
            held.append(None if small is None else press.decompress(small))
            size += len(held[-1] or b"")
            if size >= most:
                yield batch.slice(lo, i + 1 - lo), held
                lo, held, size = i + 1, [], 0
        if held:
            yield batch.slice(lo), held
