"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text, sums of (code + 1) * B**i modulo a prime, answers whether two spans
are equal in constant time and, by binary search, how far two texts agree. A fingerprint
holds the length, the hash of the whole text modulo two primes, marks of the prefix array, and a
sketch.

The marks are prefix hashes at multiples of the largest power of two that goes 32 times into the
length, so two texts have marks at common places, and a binary search over these locates
their longest common extension from the start to within a mark. The sketch, for each of 64
buckets the least hash of all spans of 24 code points, tells what two texts have in common
wherever it stands in them, which prefixes can't. Likeness is the larger of the two shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, packed_text, shards, tidy, unpacked_batches, written

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525)
SPAN = 24
BUCKETS = 64
#: A text has so many marks at least, and less than twice as many, unless it is shorter.
MARKS = 32
_CHUNK = 1 << 18


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.int64)
    done, step = 1, base % prime
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * step % prime
        done += m
        step = step * step % prime
    return out


_TABLES: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    key = (which, inverse)
    if key not in _TABLES or len(_TABLES[key]) < n:
        prime = PRIMES[which]
        base = pow(BASES[which], -1, prime) if inverse else BASES[which]
        _TABLES[key] = _power_table(base, prime, max(n, _CHUNK + SPAN + 1))
    return _TABLES[key][:n]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class PrefixHashes:
    """Prefix arrays of a text for both primes."""

    def __init__(self, text: str):
        self.size = len(text)
        c = codes(text) + 1
        self.sums = []
        for which, prime in enumerate(PRIMES):
            s = np.zeros(self.size + 1, dtype=np.int64)
            np.cumsum(c * _powers(which, self.size) % prime, out=s[1:])
            self.sums.append(s % prime)

    def span(self, start: int, size: int) -> tuple[int, int]:
        """The hash of a span, wherever it stands."""
        return tuple(int((s[start + size] - s[start]) % p * int(_powers(w, start + 1, True)[start]) % p) for w, (s, p) in enumerate(zip(self.sums, PRIMES, strict=True)))

    def agree(self, start: int, other: PrefixHashes, at: int) -> int:
        """The longest common extension: code points equal from ``start`` here and ``at`` there."""
        lo, hi = 0, min(self.size - start, other.size - at)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.span(start, mid) == other.span(at, mid) else (lo, mid - 1)
        return lo


def span_hashes(c: np.ndarray, span: int) -> np.ndarray:
    """A hash of every span of so many codes (plus one), from a prefix array modulo the first prime."""
    n = len(c) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prime = PRIMES[0]
    sums = np.zeros(len(c) + 1, dtype=np.int64)
    np.cumsum(c * _powers(0, len(c)) % prime, out=sums[1:])
    return mix(((sums[span:] - sums[:n]) % prime * _powers(0, n, True) % prime).astype(np.uint64))


_EMPTY = np.full(BUCKETS, 0xFFFF_FFFF, dtype=np.int64)


def least_hashes(c: np.ndarray) -> np.ndarray:
    """The least 32-bit hash in each bucket over all spans of ``c``, chunk by chunk."""
    out = _EMPTY.copy()
    for lo in range(0, max(1, len(c) - SPAN + 1), _CHUNK):
        h = span_hashes(c[lo : lo + _CHUNK + SPAN - 1], SPAN)
        np.minimum.at(out, (h >> np.uint64(58)).astype(np.int64), (h & np.uint64(0xFFFF_FFFE)).astype(np.int64)) if len(h) < 256 else _bucket_minima(out, h)
    return out


def _bucket_minima(out: np.ndarray, h: np.ndarray) -> None:
    bucket = (h >> np.uint64(58)).astype(np.int64)
    value = (h & np.uint64(0xFFFF_FFFE)).astype(np.int64)
    # only values that can be a minimum: below a bound that nearly every bucket reaches
    bound = np.int64(min(0xFFFF_FFFF, (1 << 32) * 12 * BUCKETS // len(h)))
    some = value < bound
    np.minimum.at(out, bucket[some], value[some])
    if (out == 0xFFFF_FFFF).any():
        np.minimum.at(out, bucket, value)


def whole_hash(c: np.ndarray, before: tuple[int, int, int] = (0, 0, 0)) -> tuple[int, int, int]:
    """(size, hash, hash) of a text that goes on with ``c`` after what ``before`` describes."""
    size, *sums = before
    for which, prime in enumerate(PRIMES):
        shift = pow(BASES[which], size, prime)
        own = 0
        for lo in range(0, len(c), _CHUNK):
            part = c[lo : lo + _CHUNK]
            own += int((part * _powers(which, len(part)) % prime).sum()) % prime * pow(BASES[which], lo, prime)
        sums[which] = (sums[which] + own * shift) % prime
    return (size + len(c), *sums)


def mark_step(size: int) -> int:
    """The largest power of two that goes MARKS times into the size; 1 for shorter texts."""
    return 1 << max(0, (size // MARKS).bit_length() - 1)


def prefix_marks(c: np.ndarray) -> np.ndarray:
    """16 bits of the prefix hash at each multiple of the step."""
    step, prime = mark_step(len(c)), PRIMES[0]
    at = np.arange(step, len(c) + 1, step)
    out = np.zeros(len(at), np.int64)
    before = 0
    for lo in range(0, len(c), _CHUNK):
        part = c[lo : lo + _CHUNK]
        sums = np.cumsum(part * _powers(0, len(part)) % prime) % prime
        shift = pow(BASES[0], lo, prime)
        here = (at > lo) & (at <= lo + len(part))
        out[here] = (before + sums[at[here] - lo - 1] * shift) % prime
        before = (before + int(sums[-1]) * shift) % prime
    return (mix(out.astype(np.uint64)) & np.uint64(0xFFFF)).astype(">u2")


def common_extension(a: str, b: str) -> int:
    """How many code points two texts have in common from their start, to within a mark, as their fingerprints
    tell it: a binary search, since equal prefixes have equal shorter ones."""
    if a == b:
        return int(a.partition("-")[0], 16)
    sizes = [int(x.partition("-")[0], 16) for x in (a, b)]
    step = max(map(mark_step, sizes))
    x, y = (np.frombuffer(bytes.fromhex(t.split("-")[2]), ">u2")[step // mark_step(n) - 1 :: step // mark_step(n)] for t, n in zip((a, b), sizes, strict=True))
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[mid - 1] == y[mid - 1] else (lo, mid - 1)
    return lo * step


def _string(whole: tuple[int, int, int], marks: np.ndarray, least: np.ndarray) -> str:
    return f"{whole[0]:x}-{whole[1]:08x}{whole[2]:08x}-{marks.tobytes().hex()}-" + (least >> 16).astype(">u2").tobytes().hex()


def fingerprint(text: str) -> str:
    c = codes(text) + 1
    return _string(whole_hash(c), prefix_marks(c), _minima(c))


def _minima(c: np.ndarray) -> np.ndarray:
    """Texts shorter than a span are one span."""
    if len(c) >= SPAN or not len(c):
        return least_hashes(c)
    out = _EMPTY.copy()
    h = int(span_hashes(c, len(c))[0])
    out[h >> 58] = h & 0xFFFF_FFFE
    return out


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of two texts that they have in common (Dice), as their fingerprints tell it: of
    their code points by the longest common extension from the start, or of their spans by the sketch,
    whichever is more. 1 for equal fingerprints, two empty texts among them."""
    if a == b:
        return 1.0
    extension = 2 * common_extension(a, b) / max(1, sum(int(x.partition("-")[0], 16) for x in (a, b)))
    x, y = (np.frombuffer(bytes.fromhex(s.rpartition("-")[2]), ">u2") for s in (a, b))
    held = (x != 0xFFFF) | (y != 0xFFFF)
    same = float(((x == y) & held).sum() / held.sum()) if held.any() else 0.0
    return max(extension, 2 * same / (1 + same))


def edited(text: str, following: str) -> str:
    """The text whose last quarter is replaced by as many code points of the following text, or all."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _both(text: str, following: str) -> tuple[str, str, str]:
    """(fingerprint, edited fingerprint, SHA-256 of the edited text); what both share is hashed once."""
    q = len(text) // 4
    c = codes(text) + 1
    head, tail, new = c[: len(c) - q], c[len(c) - q :], codes(following[:q]) + 1
    sha = hashlib.sha256(edited(text, following).encode()).hexdigest()
    if len(head) < SPAN:
        again = np.concatenate([head, new])
        return fingerprint(text), _string(whole_hash(again), prefix_marks(again), _minima(again)), sha
    shared, whole = least_hashes(head), whole_hash(head)
    edge = head[len(head) - SPAN + 1 :]
    own, other = (np.minimum(shared, least_hashes(np.concatenate([edge, x]))) for x in (tail, new))
    again = np.concatenate([head, new])
    return _string(whole_hash(tail, whole), prefix_marks(c), own), _string(whole_hash(new, whole), prefix_marks(again), other), sha


DDL = "kind int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.binary())])
DONE, FIRST, LAST = 0, 1, 2


def _finished(doc: int | None, text: str, following: str | None, next_print: str | None) -> tuple:
    own, other, sha = _both(text, following or "")
    return (DONE, doc, len(text), sha, own, other, likeness(own, other), likeness(own, next_print) if next_print else 0.0, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


@tidy
def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the largest doc_id down, so that the text that follows is known: the first of the doc_id
    before. The rows of the partition's largest doc_id are passed on as they are, and so is the
    first text of its smallest."""
    now, first, small_first = None, "", b""
    following: str | None = None
    next_print: str | None = None
    for batch, texts in unpacked_batches(batches, "text"):
        rows: list[tuple] = []
        for doc, small, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), texts, strict=True):
            text = raw.decode()
            if doc != now:
                if now is not None:
                    following, next_print = first, fingerprint(first)
                now, first, small_first = doc, text, small
            rows.append((LAST, doc, *[None] * 6, small) if following is None else _finished(doc, text, following, next_print))
        yield _batch(rows)
    if now is not None:
        yield _batch([(FIRST, now, *[None] * 6, small_first)])


@tidy
def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch, texts in unpacked_batches(batches, "text"):
        rows = []
        for doc, raw, after in zip(batch.column("doc_id").to_pylist(), texts, batch.column("after").to_pylist(), strict=True):
            following = unpack.decompress(after).decode()
            rows.append(_finished(doc, raw.decode(), following, fingerprint(following)))
        yield _batch(rows)


@tidy
def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a doc_id: nothing follows them."""
    for batch, texts in unpacked_batches(batches, "text"):
        yield _batch([_finished(None, raw.decode(), None, None) for raw in texts])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The following text is that of the next larger doc_id, after the last that of the first; of
    rows that share a doc_id the one whose compressed text sorts first stands for it, and all of
    them are followed by the next larger one. Null text is the empty text. A row without
    doc_id is followed by nothing, and near_next is 0. An only document follows itself.

    Texts are sorted by doc_id in ranges, compressed; only the first and last rows of each
    range meet once more. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = packed_text(texts.where("doc_id is not null")).repartitionByRange(shards(spark), "doc_id").sortWithinPartitions(F.desc("doc_id"), "text")
    walked = written(known.mapInArrow(_walk, DDL), "fingerprints")
    # rows without a doc_id may be many: they stay where they are
    alone = packed_text(texts.where("doc_id is null")).mapInArrow(_alone, DDL)
    # a few rows for each range: which range comes next
    edges = walked.where(F.col("kind") != DONE).select("kind", "doc_id", "text")
    firsts = edges.where(F.col("kind") == FIRST)
    start = firsts.select(F.col("doc_id").alias("s_id"))
    lasts = edges.where(F.col("kind") == LAST)
    places = start.unionByName(lasts.select(F.col("doc_id").alias("s_id"))).select("s_id").distinct()
    opens = places.join(start.distinct().withColumn("opens", F.col("s_id")), "s_id", "left")
    by = Window.orderBy("s_id")
    named = opens.select("s_id", F.coalesce(F.first("opens", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)), F.min("opens").over(Window.partitionBy())).alias("a_id"))
    tails = lasts.join(named, lasts.doc_id == named.s_id).select("doc_id", "text", "a_id")
    closed = tails.join(firsts.select(F.col("doc_id").alias("f_id"), F.col("text").alias("after")), F.col("a_id") == F.col("f_id")).select("doc_id", "text", "after").mapInArrow(_close, DDL)
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return walked.where(F.col("kind") == DONE).select(columns).unionByName(closed.select(columns)).unionByName(alone.select(columns))
