"""Substring dedup by repeated-phrase automata.

A window is 50 consecutive words of one document. A word goes if it is covered by a window
whose word sequence also starts in a document with a smaller doc_id.

1. Anchors. Of the 16-word phrases of a window, the one with the least hash is its anchor; equal
   windows have equal anchors. Each document sends its distinct anchors (about one for 18
   words), and anchors met in two documents or more are recurring. The smallest such
   document owns the anchor. Of an anchor that many documents of one task have, only the two
   smallest are sent; the task writes down the others, to be joined with the owner.
2. Automata. Recurring phrases are compiled into Aho-Corasick automata over word numbers,
   sharded by owner, so that a copy meets the phrases of its source in one shard. A document
   streams, whole, through the automata of the shards that the owners of its anchors are
   in, which locate each occurrence. An owner that very many documents share anchors with
   has a shard of its own, in parts by document.
3. Confirmation. The windows around located anchors are hashed as a whole, 64 bits. All
   documents that have a window meet in one shard, so a part knows at once who gives it up, but
   for the smallest document it has seen itself; only that is compared with other parts.
4. Each document is cut by the windows it has to give up.

Documents without a recurring anchor have no window in common with others and pass no automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, mix, packed_text, set_aside, shards, small_batches, spans, tidy, unpacked_batches, written

PHRASE = 16
#: An owner that more documents share anchors with has a shard of its own, in parts of so many documents.
SPLIT = 256
#: An anchor that more documents of a flush have is joined with its owner instead of gathered.
HOT = 64
_FLUSH = 1 << 19
#: The shard number of what is not sent to a shard but written down: documents with a hot anchor, smallest documents of windows.
_ASIDE = -1


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, from running minima of blocks both ways."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    if width == 1:
        return x
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[width - 1 : width - 1 + n])


SENT = "shard long, keys binary, docs binary"
_SENT = pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])
_ANCHORS = _SENT.append(pa.field("anchor", pa.int64()))


class Pairs:
    """(hash, doc_id) pairs that a task gathers."""

    def __init__(self):
        self.held = 0
        self.keys: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []

    def add(self, keys: np.ndarray, doc: int) -> None:
        if len(keys):
            self.keys.append(keys)
            self.docs.append(np.full(len(keys), doc, np.int64))
            self.held += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs in order; none are held then."""
        out = _distinct(self.keys, self.docs) if self.held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.keys, self.docs, self.held = [], [], 0
        return out


def _distinct(keys: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, d = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((d, k))
    k, d = k[order], d[order]
    fresh = np.ones(len(k), dtype=bool)
    fresh[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return k[fresh], d[fresh]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal keys begin, and how many there are."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(keys)))


def _packed(keys: np.ndarray, docs: np.ndarray, to: np.ndarray, n_shards: int) -> list[tuple[int, bytes, bytes]]:
    """A row for each shard."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(n_shards + 1))
    keys, docs = keys[order], docs[order]
    return [(i, keys[a:b].tobytes(), docs[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _rows(rows: list[tuple], schema: pa.Schema = _SENT) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)


def _by_key(keys: np.ndarray, n_shards: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(n_shards)).astype(np.int64)


def _by_doc(docs: np.ndarray, n_shards: int) -> np.ndarray:
    return (mix(docs.view(np.uint64)) % np.uint64(n_shards)).astype(np.int64)


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, doc) in order, and for each the smallest document of its key."""
    keys, docs = _distinct([np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")], [np.frombuffer(x.as_py(), np.int64) for x in table.column("docs")])
    at, size = _runs(keys)
    return keys, docs, np.repeat(docs[at], size)


def _anchors_of(words: np.ndarray, window: int, phrase: int) -> np.ndarray:
    return sliding_least(spans(words, phrase), window - phrase + 1)


@tidy
def _anchors(batches: Iterator[pa.RecordBatch], window: int, phrase: int, n_shards: int) -> Iterator[pa.RecordBatch]:
    """Documents' anchors to the shards of the anchors; a row aside for each hot anchor, with all its documents."""
    pairs = Pairs()

    def flush() -> pa.RecordBatch:
        keys, docs = pairs.take()
        at, size = _runs(keys)
        hot = size > max(HOT, len(keys) >> 10)
        aside = [(_ASIDE, None, docs[a : a + n].tobytes(), int(keys[a].view(np.int64))) for a, n in zip(at[hot], size[hot], strict=True)]
        send = np.repeat(~hot, size) | (np.arange(len(keys)) - np.repeat(at, size) < 2)
        keys, docs = keys[send], docs[send]
        return _rows([(*r, None) for r in _packed(keys, docs, _by_key(keys, n_shards), n_shards)] + aside, _ANCHORS)

    for batch in small_batches(batches, "text"):
        words = Words(batch.column("text"), lower=False)
        for doc, lo, hi in zip(batch.column("doc_id").to_pylist(), words.first[:-1], words.first[1:], strict=True):
            if hi - lo >= window:
                pairs.add(np.unique(_anchors_of(words.hash[lo:hi], window, phrase)), doc)
        if pairs.held >= _FLUSH:
            yield flush()
    if pairs.held:
        yield flush()


@tidy
def _recurring(table: pa.Table) -> pa.Table:
    """(anchor, doc, owner) of anchors that more than one document has."""
    keys, docs, least = _received(table)
    _, size = _runs(keys)
    keep = np.repeat(size > 1, size)
    return pa.table({"anchor": keys[keep].view(np.int64), "doc": docs[keep], "owner": least[keep]})


def _with_hot_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, owner) of the documents that were written down with a hot anchor."""
    for batch in batches:
        for owner, docs in zip(batch.column("owner").to_pylist(), batch.column("docs").to_pylist(), strict=True):
            docs = np.frombuffer(docs, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(np.full(len(docs), owner, np.int64))], names=["doc", "owner"])


@tidy
def _route(batches: Iterator[pa.RecordBatch], window: int, phrase: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A document's phrases to its own shard if it owns anchors, itself to the shards it shares anchors with."""
    for batch, texts in unpacked_batches(batches, "text"):
        small = batch.column("text").to_pylist()
        words = Words(pa.array(texts, pa.binary()), lower=False)
        rows: list[tuple] = []
        cols = (batch.column(c).to_pylist() for c in ("doc_id", "home", "owned", "to"))
        for i, (doc, home, owned, to) in enumerate(zip(*cols, strict=True)):
            own = words.hash[words.first[i] : words.first[i + 1]]
            if owned and len(own) >= window:
                grams = spans(own, phrase)
                wanted, place = np.unique(grams, return_index=True)
                place = place[np.isin(wanted, np.array(owned, np.int64).view(np.uint64))]
                low = (own & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                body = low[place[:, None] + np.arange(phrase)].tobytes()
                rows += [(home["shard"], part, home["parts"], 0, None, None, body) for part in range(home["parts"])]
            rows += [(x["shard"], doc % x["parts"], x["parts"], 1, doc, small[i], None) for x in to or ()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)


@tidy
def _locate(batches: Iterator[pa.RecordBatch], window: int, phrase: int, n_shards: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (shard, part, kind): an automaton of the phrases first, then the documents that
    go through it. Says which windows whose anchor is located have a smaller document in this part, and
    writes down the smallest documents where another part, or a later flush, may have a smaller one."""
    pairs = Pairs()
    now, parts, ready, whole = None, 1, False, True
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)

    def settle(over: bool) -> Iterator[pa.RecordBatch]:
        if pairs.held:
            keys, docs = pairs.take()
            at, size = _runs(keys)
            later = docs > np.repeat(docs[at], size)
            rows = _packed(keys[later], docs[later], _by_doc(docs[later], n_shards), n_shards)
            if parts > 1 or not whole or not over:
                rows.append((_ASIDE, keys[at].tobytes(), docs[at].tobytes()))
            if rows:
                yield _rows(rows)

    for batch, texts in unpacked_batches(batches, "body"):
        for shard, part, of, kind, doc, body, more in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "parts", "kind", "doc")), texts, batch.column("more").to_pylist(), strict=True):
            if (shard, part) != now:
                yield from settle(True)
                now, parts, ready, whole = (shard, part), of, False, True
                auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            if kind == 0:
                for key in np.frombuffer(more, np.uint32).reshape(-1, phrase).tolist():
                    auto.add_word(tuple(key), 1)
                continue
            if not len(auto):
                continue
            if not ready:
                auto.make_automaton()
                ready = True
            own = Words(pa.array([body], pa.binary()), lower=False).hash
            ends = [end for end, _ in auto.iter(tuple((own & np.uint64(0xFFFFFFFF)).tolist()))]
            if ends:
                grams = spans(own, phrase)
                located = np.unique(grams[np.array(ends) - phrase + 1])
                # the windows that these phrases anchor
                least = sliding_least(grams, window - phrase + 1)
                pairs.add(np.unique(spans(own, window)[np.isin(least, located)]), doc)
            if pairs.held >= _FLUSH:
                yield from settle(False)
                whole = False
    yield from settle(True)


@tidy
def _smallest_to_shards(batches: Iterator[pa.RecordBatch], n_shards: int) -> Iterator[pa.RecordBatch]:
    """What was written down about windows, to the shards of the windows."""
    for batch in batches:
        for keys, docs in zip(batch.column("keys").to_pylist(), batch.column("docs").to_pylist(), strict=True):
            keys, docs = np.frombuffer(keys, np.uint64), np.frombuffer(docs, np.int64)
            yield _rows(_packed(keys, docs, _by_key(keys, n_shards), n_shards))


@tidy
def _given_up(table: pa.Table, n_shards: int) -> pa.Table:
    """Windows that a smaller document has too, packed for the shard of the document that gives them up."""
    keys, docs, least = _received(table)
    keep = docs > least
    return pa.Table.from_batches([_rows(_packed(keys[keep], docs[keep], _by_doc(docs[keep], n_shards), n_shards))])


@tidy
def _by_document(table: pa.Table) -> pa.Table:
    """(doc, windows) from what the shards of windows sent: a row for each document."""
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")])
    docs = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("docs")])
    order = np.argsort(docs, kind="stable")
    keys, docs = keys[order], docs[order]
    at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    ends = np.append(at[1:], len(docs))
    return pa.table({"doc": pa.array(docs[at], pa.int64()), "windows": pa.array([keys[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())})


@tidy
def _cut(batches: Iterator[pa.RecordBatch], window: int, at: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """The text at this place without the words given up; then n_words, n_removed and, instead of
    the text, the SHA-256 of the kept words if ``digest``."""
    for batch, raw in unpacked_batches(batches, at):
        given = batch.column(batch.num_columns - 1).to_pylist()
        words = Words(pa.array([t or b"" for t in raw], pa.binary()), lower=False)
        counts, removed, out = words.counts(), [], []
        for i, (text, gone) in enumerate(zip(raw, given, strict=True)):
            a, b = words.first[i], words.first[i + 1]
            keep = np.ones(b - a, dtype=bool)
            if gone:
                hit = np.isin(spans(words.hash[a:b], window), np.frombuffer(gone, np.uint64))
                edge = np.zeros(b - a + 1, np.int64)
                edge[:-window] += hit
                edge[window:] -= hit
                keep = np.cumsum(edge[:-1]) == 0
            removed.append(int((~keep).sum()))
            if digest:
                parts = (text or b"").split()
                if removed[-1]:
                    parts = [p for p, k in zip(parts, keep.tolist(), strict=True) if k]
                out.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            elif not removed[-1]:
                out.append(None if text is None else text.decode())
            else:
                # runs of kept words with the white space between them, a line each
                place = np.flatnonzero(keep)
                runs = np.split(place, np.flatnonzero(np.diff(place) > 1) + 1) if len(place) else []
                out.append("\n".join(words.data[words.start[a + r[0]] : words.end[a + r[-1]]].tobytes().decode() for r in runs))
        cols = [batch.column(c) for c in range(batch.num_columns - 1)]
        cols[at] = pa.array(out, pa.string())
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_words", "n_removed"])


def windows_to_remove(docs: DataFrame, window: int = 50, phrase: int = PHRASE) -> DataFrame:
    """(doc, windows): for each document that has any, an array of hashes of its windows whose word
    sequence also starts in a document with a smaller doc_id."""
    spark = docs.sparkSession
    n = shards(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    sent = written(docs.mapInArrow(partial(_anchors, window=window, phrase=phrase, n_shards=n), SENT + ", anchor long"), "repeats-sent")
    found = written(sent.where(F.col("shard") != _ASIDE).groupBy("shard").applyInArrow(_recurring, "anchor long, doc long, owner long"), "repeats-anchors")
    # documents with a hot anchor learn its owner by a join, whose large keys Spark can split
    aside = sent.where(F.col("shard") == _ASIDE).select("anchor", "docs")
    owners = found.join(aside.select("anchor").distinct(), "anchor", "left_semi").groupBy("anchor").agg(F.min("owner").alias("owner"))
    hot = aside.join(owners, "anchor").select("owner", "docs").mapInArrow(_with_hot_anchor, "doc long, owner long")
    known = found.select("doc", "owner", F.when(F.col("doc") == F.col("owner"), F.col("anchor")).alias("anchor"))
    links = written(known.unionByName(hot.withColumn("anchor", F.lit(None).cast("long"))).groupBy("doc", "owner").agg(F.collect_list("anchor").alias("owned")), "repeats-links")
    # a shard for each hot owner, the others by hash; only hot owners are joined, so that their links can be split
    hot_owners = written(links.groupBy("owner").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT), "repeats-hot-owners")
    shard = F.when(F.col("n").isNotNull(), n + F.pmod(F.xxhash64("owner"), F.lit(1 << 60))).otherwise(F.pmod(F.xxhash64("owner"), F.lit(n)))
    parts = F.when(F.col("n").isNotNull(), F.ceil(F.col("n") / SPLIT)).otherwise(1).cast("int")
    at_home = links.join(hot_owners, "owner", "left").withColumn("at", F.struct(shard.alias("shard"), parts.alias("parts")))
    wanted = at_home.groupBy("doc").agg(
        F.max(F.when(F.col("doc") == F.col("owner"), F.col("at"))).alias("home"), F.flatten(F.collect_list("owned")).alias("owned"), F.collect_set("at").alias("to"),
    )
    packed = packed_text(docs)
    joined = packed.join(wanted, packed.doc_id == wanted.doc).select("doc_id", "text", "home", "owned", "to")
    schema = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("kind", pa.int32()), ("doc", pa.int64()), ("body", pa.binary()), ("more", pa.binary())])
    routed = joined.mapInArrow(partial(_route, window=window, phrase=phrase, schema=schema), "shard long, part int, parts int, kind int, doc long, body binary, more binary")
    streams = routed.repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "kind")
    windows = written(streams.mapInArrow(partial(_locate, window=window, phrase=phrase, n_shards=n), SENT), "repeats-windows")
    discard(sent, found, links, hot_owners)

    def given_up(table: pa.Table) -> pa.Table:
        return _given_up(table, n)

    between = windows.where(F.col("shard") == _ASIDE).mapInArrow(partial(_smallest_to_shards, n_shards=n), SENT).groupBy("shard").applyInArrow(given_up, SENT)
    return windows.where(F.col("shard") != _ASIDE).unionByName(between).groupBy("shard").applyInArrow(_by_document, "doc long, windows binary")


def remove_repeats(docs: DataFrame, window: int = 50, phrase: int = PHRASE, digest: bool = False) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and n_words, n_removed.

    Where nothing goes, the text stays as it is; else the kept runs of words follow each
    other line by line with their own white space. With ``digest`` the text becomes the
    SHA-256 of the kept words joined by one space.

    Null texts stay null (their digest is that of the empty text) and have no words. Rows
    without doc_id are left whole and take nothing from others. Rows that share a doc_id
    give up the same windows and nothing to each other. Columns n_words, n_removed of ``docs``
    are replaced; others are kept, whatever their names. Equality of windows is that of 64-bit hashes.
    """
    docs, put_back = set_aside(docs.drop("n_words", "n_removed"), "doc_id", "text")
    gone = windows_to_remove(docs, window, phrase).select(F.col("doc").alias("_doc"), F.col("windows").alias("_gone"))
    at = docs.columns.index("text")
    kinds = [(f.name, "binary" if f.name == "text" else f.dataType.simpleString()) for f in docs.schema]
    quoted = lambda pairs: ", ".join(f"`{n}` {t}" for n, t in pairs)
    packed = packed_text(docs)
    joined = packed.join(gone, packed["doc_id"].cast("long") == gone["_doc"], "left").drop("_doc")
    final = [(n, "string" if n == "text" else t) for n, t in kinds] + [("n_words", "bigint"), ("n_removed", "bigint")]
    return put_back(joined.mapInArrow(partial(_cut, window=window, at=at, digest=digest), quoted(final)), "n_words", "n_removed")
