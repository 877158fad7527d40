"""Benchmark decontamination by pigeonhole edit matching.

A test item that may differ in k bytes is cut into k + 1 pieces: wherever it occurs, one piece
occurs exactly. Documents are searched for all pieces at once; each hit says where the
item would begin, and Myers' bit-parallel algorithm measures the edit distance there.

Both sides are compared in a plain form: A-Z lower-cased, ASCII other than letters and
digits to single spaces. Distances count bytes of that form in UTF-8.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from string import ascii_lowercase, ascii_uppercase

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, tidy, written

#: Items are searched for in rounds of about so many bytes of text, so that what a round sends to the tasks is bounded.
ROUND_BYTES = 8 << 20
_PLAIN = np.full(256, 32, dtype=np.uint8)
for _lo, _hi, _to in ((48, 58, 48), (97, 123, 97), (65, 91, 97), (128, 256, 128)):
    _PLAIN[_lo:_hi] = np.arange(_to, _to + _hi - _lo)


def plain(text: str | None) -> str:
    """The plain form, a character for each byte."""
    raw = _PLAIN[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]
    space = raw == 32
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return raw[keep].tobytes().decode("latin-1").strip(" ")


def error_budget(size: int, rate: float, shortest: int) -> int:
    """How many edits an item of this size may have: ``rate`` of it, with pieces of ``shortest`` at least."""
    return max(0, min(int(size * rate), size // shortest - 1))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of an item cut into budget + 1 nearly equal parts."""
    cuts = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers_best(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the place in ``text`` where ``pattern`` fits best; the first such end."""
    m = len(pattern)
    eq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        eq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        x = eq.get(c, 0)
        across = (((x & plus) + plus) ^ plus) | x | minus
        up = minus | (~(across | plus) & full)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (~(x | minus | up) & full)
        minus = up & (x | minus)
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Items:
    """Items under their own numbers, with their ids and edits, and an automaton of their pieces."""

    texts: list[str]
    ids: list[int | None]
    rate: float
    shortest: int

    def built(self) -> Items:
        self.budgets = [error_budget(len(t), self.rate, self.shortest) for t in self.texts]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(self.texts):
            for at, piece in pieces(t, self.budgets[i]):
                found[piece].append((i, at))
        self.auto = ahocorasick.Automaton()
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton()
        return self

    def hits(self, raw: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(number, distance, hits, end) of each item that occurs in a text."""
        text = plain(raw)
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (size, where) in self.auto.iter(text):
            for i, at in where:
                starts[i].append(end + 1 - size - at)
        for i, begins in starts.items():
            hit = _verify(self.texts[i], self.budgets[i], sorted(begins), text)
            if hit:
                yield i, *hit


@tidy
def _search(batches: Iterator[pa.RecordBatch], items: Items, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    items.built()
    for batch in small_batches(batches, "text"):
        rows = []
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            rows += [(doc, items.ids[i], *hit) for i, *hit in items.hits(raw)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)


@tidy
def _clean(batches: Iterator[pa.RecordBatch], items: Items, at: int) -> Iterator[pa.RecordBatch]:
    """The rows whose text, the column at this place, has none of the items."""
    items.built()
    for batch in small_batches(batches, at):
        keep = [next(items.hits(raw), None) is None for raw in batch.column(at).to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _verify(item: str, budget: int, begins: list[int], text: str) -> tuple[int, int, int] | None:
    """(distance, hits, end) of the best place, if it is within budget; hits: places within budget. An
    item that may have no edit counts where it stands as whole words."""
    if not budget:
        ends = [b + len(item) for b in begins if text[b - 1 : b] in ("", " ") and text[b + len(item) : b + len(item) + 1] in ("", " ")]
        return (0, len(ends), ends[0]) if ends else None
    best, hits, lo = None, 0, 0
    while lo < len(begins):
        hi = lo + 1
        while hi < len(begins) and begins[hi] - begins[hi - 1] <= budget:
            hi += 1
        first, last = max(0, begins[lo] - budget), begins[hi - 1] + len(item) + budget
        exact = text.find(item, first, last)
        distance, end = (0, exact + len(item) - first) if exact >= 0 else myers_best(item, text[first:last])
        if distance <= budget:
            hits += 1
            if best is None or (distance, first + end) < best:
                best = (distance, first + end)
        lo = hi
    return None if best is None else (best[0], hits, best[1])


def _rounds(items: DataFrame, rate: float, shortest: int) -> Iterator[Items]:
    """Each distinct (item_id, plain text) that isn't blank, in rounds of bounded size."""
    form = F.trim(F.regexp_replace(F.translate("text", ascii_uppercase, ascii_lowercase), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), form.alias("text")).where("text <> ''").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = total // ROUND_BYTES + 1
    for i in range(rounds):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == i).collect()
        if own:
            yield Items([plain(r.text) for r in own], [r.item_id for r in own], rate, shortest)


def benchmark_hits(docs: DataFrame, items: DataFrame, rate: float = 0.05, shortest: int = 8) -> DataFrame:
    """(doc_id, item_id, distance, hits, end) for each document and each item that occurs in it.

    ``docs`` has doc_id and text, ``items`` item_id and text; an item occurs where a stretch of
    the document is within ``rate`` of the item's length in edits, in the plain form; items so short that
    this allows none must stand there as whole words. ``hits``
    counts the places, ``distance`` is the least, ``end`` where that ends in the plain form.

    Null and blank texts match nothing; empty tables give no row; other columns of either table are
    not looked at, whatever their names. An item is a distinct (item_id, plain form): different
    texts under one item_id are items of their own and come back in a row each, those without
    item_id too. Repeated documents come back each. The test set is read in rounds of bounded
    size, each of which goes through all documents; documents aren't shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("hits", pa.int32()), ("end", pa.int64())])
    ddl = "doc_id long, item_id long, distance int, hits int, end long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for held in _rounds(items, rate, shortest):
        # what an earlier round found is written, so that its items leave the driver
        done = None if out is None else written(out, "hits-of-round")
        found = docs.mapInArrow(partial(_search, items=held, schema=schema), ddl)
        out = found if done is None else done.unionByName(found)
    return docs.sparkSession.createDataFrame([], ddl) if out is None else out


def without_items(docs: DataFrame, items: DataFrame, rate: float = 0.05, shortest: int = 8) -> DataFrame:
    """The rows of ``docs`` in whose text no item occurs, by the text of each row alone: doc_id is not looked at."""
    before = None
    for i, held in enumerate(_rounds(items, rate, shortest)):
        # a task holds the items of one round
        if i:
            docs = written(docs, "clean-of-round")
            if before is not None:
                discard(before)
            before = docs
        docs = docs.mapInArrow(partial(_clean, items=held, at=docs.columns.index("text")), docs.schema)
    return docs
