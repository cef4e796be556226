"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

The model is fitted by one task on a bounded sample of labelled rows (``sample``); its weights have a
fixed size and are broadcast. Scoring reads every whole text once: a sparse dot product per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rosterline.llm.common import column, long_id, mix64, remainder, slices

BITS = 18
HELD_WORDS = 100_000
SAMPLE = 8_000
_SHAPE = bytes(
    ord("0") if chr(b).isdigit() and b < 128 else ord("A") if b < 128 and chr(b).isupper()
    else ord("a") if b >= 128 or chr(b).isalpha() else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


class Words(dict):
    """Places of words in two arrays: hashes of the words and of their shapes (``Aa``, ``a#``)."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(HELD_WORDS + 1, np.uint64)
        self.shapes = np.zeros(HELD_WORDS + 1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        place = len(self)
        if place >= len(self.hashes):
            self.hashes, self.shapes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.hashes, self.shapes))
        self.hashes[place] = xxhash.xxh64_intdigest(word)
        self.shapes[place] = xxhash.xxh64_intdigest(_RUNS.sub(rb"\1", word.translate(_SHAPE)), seed=1)
        self[word] = place
        return place

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self) >= HELD_WORDS:
            self.clear()
        places = np.fromiter(map(self.__getitem__, text.encode().split()), np.int64)
        return self.hashes[places], self.shapes[places]


def features(words: Words, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of a text's 1- and 2-grams of words and 1- to 3-grams of word shapes."""
    h, s = words.of(text)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    pairs = s[:-1] * odd + s[1:]
    grams = [h, s, (h[:-1] * odd + h[1:]) ^ np.uint64(11), pairs ^ np.uint64(12), (pairs[:-1] * odd + s[2:]) ^ np.uint64(13),
             # Whether a word repeats the one before, or the one before that.
             (h[1:] == h[:-1]).astype(np.uint64) + np.uint64(21), (h[2:] == h[:-2]).astype(np.uint64) + np.uint64(31)]
    slots = (mix64(np.concatenate(grams)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.unique(slots, return_counts=True)


def values(counts: np.ndarray) -> np.ndarray:
    """Feature values of unit length: square roots of counts, scaled."""
    return np.sqrt(counts / max(1, counts.sum()))


def ftrl(
    examples: list[tuple[np.ndarray, np.ndarray, float]], slots: int, alpha: float = 1.0, beta: float = 1.0,
    l1: float = 0.0, l2: float = 0.01, epochs: int = 3,
) -> np.ndarray:
    """Weights after FTRL-proximal updates over (slots, values, label) in order; the last is the bias."""
    z, n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weight(i):
        zi = z[i]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(np.asarray(i) == slots, 0.0, l1), 0.0)
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for index, x, y in examples:
            i, v = np.append(index, slots), np.append(x, 1.0)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weight(np.arange(slots + 1))


def labelled(labels: DataFrame, label: str, folds: int, sample: int) -> DataFrame:
    """``doc_id, y`` of at most ``sample`` documents outside the held-out fold, in hash order.

    Several labels of a document count as their rounded mean; null ids and labels are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in slices(batches, 500):
        made = [features(words, t or "") for t in column(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            column(batch, "doc_id"), column(batch, "y"),
            pa.array([i.astype("<u4").tobytes() for i, _ in made], pa.binary()),
            pa.array([np.minimum(c, 65535).astype("<u2").tobytes() for _, c in made], pa.binary()),
        ], names=["doc_id", "y", "slots", "counts"])


def _train(table: pa.Table) -> pa.Table:
    order = np.argsort([xxhash.xxh64_intdigest(str(i)) for i in table["doc_id"].to_pylist()], kind="stable")
    rows = list(zip(table["slots"].to_pylist(), table["counts"].to_pylist(), table["y"].to_pylist()))
    examples = [
        (np.frombuffer(rows[k][0], "<u4").astype(np.int64), values(np.frombuffer(rows[k][1], "<u2").astype(float)), rows[k][2])
        for k in order]
    return pa.table({"weights": pa.array([ftrl(examples, 1 << BITS).astype("<f4").tobytes()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, sample: int = SAMPLE) -> np.ndarray:
    """Weights of a classifier for ``label``, from at most ``sample`` labelled documents.

    With no labelled document the weights are zero and every score is 0.5.
    """
    chosen = labelled(labels, label, folds, sample)
    # The chosen ids are at most ``sample`` rows of two numbers.
    rows = docs.select(long_id(), "text").join(F.broadcast(chosen), "doc_id")
    made = rows.mapInArrow(_extract, "doc_id long, y double, slots binary, counts binary")
    one = made.groupBy("doc_id").agg(F.min(F.struct("slots", "counts", "y")).alias("e")).select("doc_id", "e.*")
    got = one.groupBy().applyInArrow(_train, "weights binary").collect()
    return np.frombuffer(got[0]["weights"], "<f4") if got else np.zeros((1 << BITS) + 1, np.float32)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, words = model.value, Words()
        for batch in slices(batches, 500):
            scores = []
            for text in column(batch, "text").to_pylist():
                slots, counts = features(words, text or "")
                z = float(weights[slots] @ values(counts) + weights[-1])
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -35, 35)))))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "score"])

    return run


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, folds: int = 5, sample: int = SAMPLE,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``).

    Documents whose id's CRC32 is 0 modulo ``folds`` are held out; so are null ids. Null text is empty
    and scores by the bias alone. Repeated rows score alike; other columns are ignored; an empty
    table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, folds, sample))
    rows = docs.select(
        long_id(),
        F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(True)).alias("held_out"), "text")
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
