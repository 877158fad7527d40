"""LM scoring with Elias-Fano n-gram tries.

The model is a mixture for whole texts: half the probability of a text under a unigram
model, half under a bigram model with Dirichlet smoothing,

    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),   p(w | v) = (c(v w) + m p(w)) / (c(v) + m).

The logarithm of p(w | v) falls into a part that needs w, its contexts and counts, and the part
-log(c(v) + m), which needs the count of v alone. So words are dealt to shards by hash, each
shard gathers all it needs about its words from the whole corpus, and texts add up what the
shards say. A shard's trie has a level of words, as an Elias-Fano sequence of their hashes with
exact counts, monotone pointers to where each word's contexts begin, and a level of contexts:
context hashes are made relative to their word's place, so that one Elias-Fano sequence holds
all of them in order, with smoothed log probabilities quantised to 16 bits. A pair is asked for by
its word's place, the two pointers there and the successor of the context between them. Levels
lie in memory-mapped files, which only the task that scores a shard reads and then removes.

The order is two: of three words, the count of the first two and that of all three would lie in
different shards. The prior mass is that of many tokens, since most pairs of words occur once or never.

Words with more than 1/4096 of all tokens are split by context over 64 shards; their counts,
4096 at most, are sent to all tasks.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, crc_remainder, mix, shards, small_batches, tidy
from .elias_fano import EliasFano

MASS = 300.0
HOT = 4096
PARTS = 64
_TEXTS = 2048
_TOKENS = 1 << 21
END = np.uint64(0x656E64)
_BEGIN = np.uint32(0xBE61)
COUNTED = "shard long, keys binary, counts binary"


def _shard(keys: np.ndarray, n: int) -> np.ndarray:
    """Shards are ranges of hashes: sorted keys are sorted by shard."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


# ---------------------------------------------------------------- how often words occur


@tidy
def _count(batches: Iterator[pa.RecordBatch], n_shards: int) -> Iterator[pa.RecordBatch]:
    """Word counts of training texts, packed by shard; the end of a text counts as a word."""
    names = ["shard", "keys", "counts"]
    held: list[np.ndarray] = []
    texts = 0

    def flush() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        keys, counts = np.append(keys, END), np.append(counts, texts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        cuts = np.searchsorted(_shard(keys, n_shards), np.arange(n_shards + 1))
        rows = [(i, keys[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    for batch in small_batches(batches, "text"):
        held.append(Words(batch.column("text").fill_null(""), lower=True).hash)
        texts += batch.num_rows
        if sum(map(len, held)) >= 2 * _TOKENS:
            yield flush()
            held, texts = [], 0
    if texts:
        yield flush()


@tidy
def _vocabulary(table: pa.Table) -> pa.Table:
    """Of one shard: distinct words and tokens, and the words that may be hot."""
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")])
    counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("counts")])
    words, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, counts).astype(np.int64)
    hot = total * HOT >= total.sum()
    return pa.table({"word": pa.array([None, *words[hot].view(np.int64).tolist()], pa.int64()), "tokens": pa.array([int(total.sum()), *total[hot].tolist()], pa.int64()), "distinct": pa.array([len(words), *[1] * int(hot.sum())], pa.int64())})


@dataclass
class Totals:
    """What all tasks know: N, V, hot words in order with their counts."""

    tokens: int
    distinct: int
    hot: np.ndarray
    hot_counts: np.ndarray

    @property
    def mass(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The names under which parts of hot words are dealt, in order, and the counts of the words."""
        names = part_name(np.repeat(self.hot, PARTS), np.tile(np.arange(PARTS, dtype=np.uint32), len(self.hot)))
        order = np.argsort(names)
        return names[order], np.repeat(self.hot_counts, PARTS)[order]


def part_name(words: np.ndarray, context: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(words + np.uint64(0x51ED270B) * ((context % np.uint32(PARTS)).astype(np.uint64) + np.uint64(1)))


def corpus_totals(training: DataFrame) -> Totals:
    """N, V and the hot words of all training texts: at most 4096 words of each shard reach the driver."""
    n = shards(training.sparkSession)
    rows = training.select("text").mapInArrow(partial(_count, n_shards=n), COUNTED).groupBy("shard").applyInArrow(_vocabulary, "word long, tokens long, distinct long").collect()
    sums = [r for r in rows if r.word is None]
    tokens = sum(r.tokens for r in sums)
    hot = sorted((np.uint64(np.int64(r.word).view(np.uint64)), r.tokens) for r in rows if r.word is not None and r.tokens * HOT >= tokens)
    return Totals(tokens, sum(r.distinct for r in sums), np.array([h[0] for h in hot], np.uint64), np.array([h[1] for h in hot], np.int64))


# ---------------------------------------------------------------- bigrams to the shards of their words

_BLOB = np.dtype([("texts", "<i8"), ("words", "<i8"), ("pairs", "<i8"), ("events", "<i8")])
_ANSWER = np.dtype([("text", "<u2"), ("known", "<u4"), ("base", "<f8"), ("bigram", "<f8")])


def group_name(contents: np.uint64, place: np.uint64) -> int:
    """Different at different places even if the contents are the same."""
    return int(mix(contents ^ mix(np.array([place], np.uint64))).view(np.int64)[0])


@tidy
def _send(batches: Iterator[pa.RecordBatch], totals: Totals, n_shards: int) -> Iterator[pa.RecordBatch]:
    """Groups of up to 2048 texts; for each group and shard the shard's words, for each word its
    contexts, for each context the texts and how often. A group is named by its contents, its
    task's partition and its number there: tasks may hold the same rows."""
    pack = zstandard.ZstdCompressor(level=1)
    word: list[np.ndarray] = []
    context: list[np.ndarray] = []
    text: list[np.ndarray] = []
    ids: list[tuple[int | None, bool]] = []
    lengths: list[int] = []
    name = np.uint64(0)
    place = np.uint64(TaskContext.get().partitionId()) << np.uint64(32)
    tokens = 0

    def flush() -> pa.RecordBatch:
        w, c, d = np.concatenate(word), np.concatenate(context), np.concatenate(text)
        if len(totals.hot):
            at = np.minimum(np.searchsorted(totals.hot, w), len(totals.hot) - 1)
            hot = totals.hot[at] == w
            w[hot] = part_name(w[hot], c[hot])
        names, at = np.unique(w, return_inverse=True)
        if len(names) < 1 << 21:
            key = np.sort((at.astype(np.uint64) << np.uint64(43)) | (c.astype(np.uint64) << np.uint64(11)) | d.astype(np.uint64))
            at, c, d = (key >> np.uint64(43)).astype(np.int64), (key >> np.uint64(11)).astype(np.uint32), (key & np.uint64(0x7FF)).astype(np.uint16)
        else:
            # one very long text: its words don't fit into one number with their contexts
            order = np.lexsort((d, c, at))
            at, c, d = at[order], c[order], d[order]
        change = np.ones(len(at), dtype=bool)
        change[1:] = (at[1:] != at[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(change | np.concatenate([[True], d[1:] != d[:-1]]))
        times = np.diff(np.append(first, len(at)))
        head = np.flatnonzero(change[first])
        at, c, d = at[first], c[first], d[first]
        pair_events = np.diff(np.append(head, len(first)))
        word_pairs = np.bincount(at[head], minlength=len(names))
        pair_context = c[head]
        flags = np.packbits(np.array([t for _, t in ids], dtype=bool)).tobytes()
        cuts = np.searchsorted(_shard(names, n_shards), np.arange(n_shards + 1))
        pair_at = np.concatenate([[0], np.cumsum(word_pairs)])
        event_at = np.concatenate([[0], np.cumsum(pair_events)])
        rows = []
        # what is known of the texts goes along with the first blob alone
        known = pack.compress(np.array([-1 if i is None else i for i, _ in ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes() + np.array([(t, i is None) for i, t in ids], np.uint8).tobytes())
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                pa_, pb = pair_at[a], pair_at[b]
                ea, eb = event_at[pa_], event_at[pb]
                size = np.array([(len(ids), b - a, pb - pa_, eb - ea)], _BLOB)
                body = [size, names[a:b], word_pairs[a:b].astype("<u4"), pair_context[pa_:pb].astype("<u4"), pair_events[pa_:pb].astype("<u2"), d[ea:eb].astype("<u2"), times[ea:eb].astype("<u4")]
                rows.append((i, group, pack.compress(b"".join([x.tobytes() for x in body] + [flags])), None if rows else known))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SENT)], schema=_SENT)

    for batch in small_batches(batches, "text"):
        words = Words(batch.column("text").fill_null(""), lower=True)
        train = batch.column("train").to_pylist()
        for i, doc in enumerate(batch.column("doc_id").to_pylist()):
            own = words.hash[words.first[i] : words.first[i + 1]]
            if ids and (len(ids) >= _TEXTS or tokens + len(own) >= _TOKENS):
                group = group_name(name, place)
                yield flush()
                place += np.uint64(1)
                word, context, text, ids, lengths, tokens = [], [], [], [], [], 0
            word.append(np.append(own, END))
            context.append(np.concatenate([[_BEGIN], (mix(own) & np.uint64(0xFFFFFFFF)).astype(np.uint32)]).astype(np.uint32))
            text.append(np.full(len(own) + 1, len(ids), np.uint16))
            ids.append((doc, bool(train[i])))
            lengths.append(len(own) + 1)
            tokens += len(own) + 1
            with np.errstate(over="ignore"):
                own_name = own.sum(dtype=np.uint64) + np.uint64((doc or 0) & 0xFFFFFFFFFFFFFFFF) + np.uint64(len(ids))
                name = mix(np.array([name + own_name], np.uint64))[0]
    if ids:
        group = group_name(name, place)
        yield flush()


_SENT = pa.schema([("shard", pa.int64()), ("group", pa.int64()), ("blob", pa.binary()), ("known", pa.binary())])


class Blob:
    def __init__(self, data: bytes):
        size = np.frombuffer(data, _BLOB, 1)[0]
        at = _BLOB.itemsize
        parts = []
        for kind, n in (("<u8", size["words"]), ("<u4", size["words"]), ("<u4", size["pairs"]), ("<u2", size["pairs"]), ("<u2", size["events"]), ("<u4", size["events"]), ("u1", -(-size["texts"] // 8))):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        self.words, self.word_pairs, self.context, self.pair_events, self.text, self.times, flags = parts
        self.n = int(size["texts"])
        self.train = np.unpackbits(flags, count=self.n).astype(bool)
        self.word_of = np.repeat(np.arange(len(self.words)), self.word_pairs)
        self.pair_of = np.repeat(np.arange(len(self.context)), self.pair_events)


class Trie:
    """Words and their contexts, in files of ``folder``."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, counts: np.ndarray, word_counts: np.ndarray, totals: Totals, folder: Path):
        """``contexts``: for each pair the word's place << 32 | context, in order; ``counts`` of pairs."""
        self.words = EliasFano(words, 1 << 64, folder, "words")
        self.pairs = EliasFano(contexts, max(1, len(words)) << 32, folder, "pairs")
        # where each word's contexts begin: a sequence that never falls
        begin = np.searchsorted(contexts >> np.uint64(32), np.arange(len(words) + 1).astype(np.uint64))
        self.pointers = EliasFano(begin.astype(np.uint64), len(contexts) + 1, folder, "pointers")
        self.counts = EliasFano._mapped(word_counts.astype(np.int64), folder / "counts")
        place = (contexts >> np.uint64(32)).astype(np.int64)
        exact = np.log10(counts + MASS * (word_counts[place] + 0.5) / totals.mass) if len(counts) else np.zeros(0)
        self.low = float(exact.min()) if len(exact) else 0.0
        self.grain = max(float(exact.max()) - self.low, 1e-9) / 65535 if len(exact) else 1.0
        self.codes = EliasFano._mapped(np.round((exact - self.low) / self.grain).astype(np.uint16), folder / "codes")

    def lookup(self, words: np.ndarray, word_of: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word or -1; smoothed log10 count of each pair, NaN where the pair is new)."""
        place = self.words.find(words)
        owner = place[word_of]
        value = np.full(len(context), np.nan)
        known = np.flatnonzero(owner >= 0)
        # a word's contexts lie between its pointer and the next word's
        here = np.maximum(place, 0)
        begin, stop = self.pointers.get(here).astype(np.int64), self.pointers.get(here + 1).astype(np.int64)
        own = word_of[known]
        at = self.pairs.find((owner[known].astype(np.uint64) << np.uint64(32)) | context[known].astype(np.uint64), begin[own], stop[own])
        hit = at >= 0
        value[known[hit]] = self.low + self.grain * self.codes[at[hit]]
        return place, value


@tidy
def _score_shard(table: pa.Table, totals: Totals) -> pa.Table:
    """Builds the shard's trie from the training texts in all groups, then asks it for all texts."""
    unpack = zstandard.ZstdDecompressor()
    packed = table.column("blob")
    words, contexts, counts = [], [], []
    for x in packed:
        b = Blob(unpack.decompress(x.as_py()))
        seen = np.bincount(b.pair_of, b.times * b.train[b.text], minlength=len(b.context))
        some = seen > 0
        words.append(b.words[b.word_of[some]])
        contexts.append(b.context[some])
        counts.append(seen[some])
    names, at = np.unique(np.concatenate(words), return_inverse=True)
    key = (at.astype(np.uint64) << np.uint64(32)) | np.concatenate(contexts).astype(np.uint64)
    pairs, back = np.unique(key, return_inverse=True)
    pair_counts = np.bincount(back, np.concatenate(counts), minlength=len(pairs))
    word_counts = np.bincount((pairs >> np.uint64(32)).astype(np.int64), pair_counts, minlength=len(names))
    part_names, part_counts = totals.parts()

    def true_counts(of: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Parts of hot words count as the whole word."""
        if not len(part_names):
            return found
        i = np.minimum(np.searchsorted(part_names, of), len(part_names) - 1)
        return np.where(part_names[i] == of, part_counts[i], found)

    folder = Path(tempfile.mkdtemp(prefix="trie-"))
    try:
        trie = Trie(names, pairs, pair_counts, true_counts(names, word_counts), totals, folder)
        out = []
        pack = zstandard.ZstdCompressor(level=1)
        for x in packed:
            b = Blob(unpack.decompress(x.as_py()))
            if len(names):
                place, value = trie.lookup(b.words, b.word_of, b.context)
                c = true_counts(b.words, np.where(place >= 0, trie.counts[np.maximum(place, 0)], 0))
            else:
                value, c = np.full(len(b.context), np.nan), true_counts(b.words, np.zeros(len(b.words)))
            new = np.log10(MASS * (c + 0.5) / totals.mass)
            bigram = np.where(np.isnan(value), new[b.word_of], value) - np.log10(c + MASS)[b.word_of]
            event_word = b.word_of[b.pair_of]
            texts, of = np.unique(b.text, return_inverse=True)
            total = lambda v: np.bincount(of, v)  # noqa: B023, E731
            said = np.empty(len(texts), _ANSWER)
            said["text"], said["known"] = texts, np.rint(total(b.times * (c > 0)[event_word]))
            said["base"], said["bigram"] = total(b.times * np.log10(c + 0.5)[event_word]), total(b.times * bigram[b.pair_of])
            out.append(pack.compress(said.tobytes()))
        del trie
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return pa.table({"group": table.column("group"), "sums": pa.array(out, pa.binary()), "known": table.column("known")})


@tidy
def _finish(table: pa.Table, totals: Totals) -> pa.Table:
    """Adds up what the shards say about the texts of one group."""
    unpack = zstandard.ZstdDecompressor()
    data = next(unpack.decompress(x.as_py()) for x in table.column("known") if x.is_valid)
    n = len(data) // 18
    ids, lengths, flags = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, "u1", 2 * n, 16 * n).reshape(n, 2).astype(bool)
    known, base, bigram = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for x in table.column("sums"):
        said = np.frombuffer(unpack.decompress(x.as_py()), _ANSWER)
        at = said["text"]
        known[at] += said["known"]
        base[at] += said["base"]
        bigram[at] += said["bigram"]
    base -= lengths * np.log10(totals.mass)
    score = np.logaddexp(base * np.log(10), bigram * np.log(10)) / np.log(10) + np.log10(0.5)
    return pa.table({
        "doc_id": pa.array(ids, pa.int64(), mask=flags[:, 1]), "held_out": pa.array(~flags[:, 0]), "n_tokens": pa.array(lengths), "n_known": pa.array(known),
        "train_tokens": pa.array(np.full(len(ids), totals.tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(np.minimum(score, 0.0)),
    })


def score_texts(docs: DataFrame, train: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows where ``train`` is true. Null text is the empty text, which is one
    token, its end. Repeated rows come back each; so do rows without doc_id. Without training
    texts every count is 0 and N is 0. Words are told apart by 64-bit hashes, contexts of a
    word by 32 bits.
    """
    spark = docs.sparkSession
    n = shards(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    totals = corpus_totals(rows.where("train"))
    sent = rows.mapInArrow(partial(_send, totals=totals, n_shards=n), "shard long, group long, blob binary, known binary")

    def score(table: pa.Table) -> pa.Table:
        return _score_shard(table, totals)

    def finish(table: pa.Table) -> pa.Table:
        return _finish(table, totals)

    said = sent.groupBy("shard").applyInArrow(score, "group long, sums binary, known binary")
    return said.groupBy("group").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def training_rows() -> Column:
    """crc32(doc_id as text) mod 5 is not 1."""
    return crc_remainder(F.col("doc_id"), 5) != 1
