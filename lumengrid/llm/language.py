"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties
from a bounded sample of labelled texts, then a temperature is fitted on a part of the sample
that FTRL hasn't seen. Document frequencies are counted over all labelled training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, small_batches, tidy

#: n-grams of 1 to ORDERS characters fall into so many buckets.
BUCKETS = 1 << 15
ORDERS = 3
_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
_SCALE = 30.0


def ngram_buckets(text: str) -> np.ndarray:
    """The bucket of each n-gram of the whole text, lower-cased, non-letters as single spaces."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[code]
    code = np.where(letter, code, np.uint32(32))
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    code = code[keep]
    if not letter.any():
        return np.zeros(0, np.int64)
    one = code * np.uint32(2654435761)
    two = one[1:] + code[:-1] * np.uint32(2246822519)
    three = two[1:] + code[:-2] * np.uint32(3266489917)
    return np.concatenate([(x ^ (x >> np.uint32(13))) * np.uint32(668265263) + np.uint32(i) >> np.uint32(17) for i, x in enumerate((one, two, three))]).astype(np.int64)


@dataclass
class LanguageModel:
    """``weights`` has a row for each bucket, IDF already multiplied in; ``temperature`` divides logits."""

    langs: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); ("und", 0.0) for a text that is null or has no letter."""
        at = ngram_buckets(text) if text and self.langs else np.zeros(0, np.int64)
        if not len(at):
            return "und", 0.0
        held = np.bincount(at, minlength=BUCKETS)
        some = np.flatnonzero(held)
        logits = held[some] @ self.weights[some] * (_SCALE / len(at)) + self.bias
        p = softmax(logits / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a multinomial logistic regression: FTRL-proximal, one pass at a time."""
    size = BUCKETS + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weight(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) > l1, w, 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at = np.append(at, BUCKETS)
            x = np.append(x, 1.0)
            w = weight(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            was = n[at]
            now = was + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(was)) / alpha * w
            n[at] = now
    every = weight(np.arange(size))
    return every[:-1], every[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that gives these logits the least log loss, by golden section on its logarithm.
    A share of 1 / (n + 2) of each label goes to all classes, so that n right answers
    don't make the model certain."""
    if not len(labels):
        return 1.0
    spare = 1 / (len(labels) + 2)

    def loss(log_t: float) -> float:
        p = np.log(np.maximum(softmax(logits / np.exp(log_t)), 1e-300))
        return float(-((1 - spare) * p[np.arange(len(labels)), labels] + spare * p.mean(axis=1)).mean())

    lo, hi, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@tidy
def _frequencies(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    total, texts = np.zeros(BUCKETS, np.int64), 0
    for batch in small_batches(batches, "text"):
        for text in batch.column("text").to_pylist():
            mark = np.zeros(BUCKETS, dtype=bool)
            mark[ngram_buckets(text)] = True
            total += mark
            texts += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], texts), pa.int64())], schema=schema)


@tidy
def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, buckets, counts) of the texts that have a letter: at most one entry for each bucket."""
    for batch in small_batches(batches, "text"):
        rows = []
        for doc, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
            at = ngram_buckets(text)
            if len(at):
                held = np.bincount(at, minlength=BUCKETS)
                some = np.flatnonzero(held)
                rows.append((doc, lang, some.astype("<i4").tobytes(), held[some].astype("<i4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)


def fit_language(docs: DataFrame, per_language: int = 800, languages: int = 200) -> LanguageModel:
    """Learn from ``docs`` with text, lang and doc_id. Rows with null text, lang or doc_id teach nothing,
    nor do texts without a letter; an empty table gives a model that answers "und". Repeated rows
    count each.

    FTRL sees about ``per_language`` texts of each language, whole, chosen by a hash of
    doc_id, or row by row where a language's chosen ids stand for more than twice as many rows: a bounded
    sample, of which the driver holds counts of buckets. Of a lang column with more
    than ``languages`` values the most frequent ones are learned. IDF counts all rows.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
    counted = rows.select("text").mapInArrow(partial(_frequencies, schema=schema), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(BUCKETS)
    texts = 0
    for bucket, n in zip(counted["bucket"], counted["n"], strict=True):
        if bucket < 0:
            texts = n
        else:
            frequency[bucket] = n
    if not texts:
        return LanguageModel()
    idf = np.log((1 + texts) / (1 + frequency)) + 1
    chance = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # a row for each language that is learned; texts aren't moved for it
    many = rows.groupBy("lang").agg(F.count("*").alias("_all")).orderBy(F.desc("_all"), "lang").limit(languages)
    chosen = rows.withColumn("_n", F.monotonically_increasing_id()).join(F.broadcast(many), "lang").where(chance < per_language / F.col("_all"))
    found = chosen.groupBy("lang").agg(F.count("*").alias("_found"))
    again = F.pmod(F.xxhash64(F.lit("thin"), "_n"), F.lit(1 << 30)) / float(1 << 30)
    few = (F.col("_found") <= 2 * per_language) | (again < per_language / F.col("_found"))
    chosen = chosen.join(F.broadcast(found), "lang").where(few).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    kinds = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("buckets", pa.binary()), ("counts", pa.binary())])
    sample = chosen.mapInArrow(partial(_counted, schema=kinds), "doc_id long, lang string, buckets binary, counts binary").collect()
    sample.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.buckets), bytes(r.counts)))
    if not sample:
        return LanguageModel()
    langs = sorted({r.lang for r in sample})
    feats = []
    for r in sample:
        some, held = np.frombuffer(r.buckets, "<i4").astype(np.int64), np.frombuffer(r.counts, "<i4").astype(np.float64)
        feats.append((some, held * idf[some] * (_SCALE / held.sum())))
    y = np.array([langs.index(r.lang) for r in sample], dtype=np.int64)
    check = np.arange(len(y)) % 5 == 4
    w, b = ftrl([f for f, c in zip(feats, check, strict=True) if not c], y[~check], len(langs))
    logits = np.array([x @ w[at] + b for (at, x), c in zip(feats, check, strict=True) if c]).reshape(-1, len(langs))
    return LanguageModel(langs, (w * idf[:, None]).astype(np.float32), b, calibrate(logits, y[check]))


@tidy
def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel, at: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, at):
        got = [model.predict(t) for t in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
            names=[*batch.schema.names, "lang_pred", "score"],
        )


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), read from ``text`` alone and from all of it.

    A letter is what Unicode calls one (categories L), beyond U+FFFF too. "und" and 0.0 for null texts, texts without a letter, and where nothing was learned. Columns
    lang_pred and score that ``docs`` has are replaced. Equal texts get equal answers.
    """
    docs = docs.drop("lang_pred", "score")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(partial(_predict, model=model, at=docs.columns.index("text")), f"{ddl}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(crc_remainder(F.col("doc_id"), 4) != 2)
