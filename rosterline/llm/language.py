"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram is the product (binding) of its letters'
vectors, each permuted by its place; a text is the sum (bundle) of its n-grams; a language is the sum
over its training documents. A text gets the language whose prototype has the greatest cosine with it.
Prototypes are centred: what all languages share says nothing about any of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rosterline.llm.common import column, long_id, mix64, remainder, trimmed

DIMENSIONS = 512
# Symbols: 0 between words, 1 to 26 for a to z, and further letters dealt to the rest by code point.
ALPHABET = 48
N = 3
# Rejection: a text of up to FEW distinct n-grams is too short to judge; from ENOUGH on the whole limit holds.
FEW, ENOUGH = 20, 200


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Code point to symbol, for lower-cased text."""
    table = np.zeros(0x110000, np.uint8)
    points = np.array([p for p in range(0x80, 0x110000) if chr(p).isalpha()], np.uint64)
    table[points.astype(np.int64)] = (27 + mix64(points + np.uint64(5)) % np.uint64(ALPHABET - 27)).astype(np.uint8)
    table[ord("a"):ord("z") + 1] = range(1, 27)
    table[ord("A"):ord("Z") + 1] = range(1, 27)
    return table


@lru_cache(maxsize=1)
def _halves() -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all beginnings of n-grams without their last letter, and those of the last letter."""
    letters = np.random.default_rng(20240229).integers(0, 2, (ALPHABET, DIMENSIONS), np.int8) * 2 - 1
    out = np.ones((1, DIMENSIONS), np.int8)
    for place in range(N - 1):
        out = (out[:, None, :] * np.roll(letters, N - 1 - place, axis=1)[None, :, :]).reshape(-1, DIMENSIONS)
    return out, letters


def grams(numbers: np.ndarray | None = None) -> np.ndarray:
    """The vectors of n-grams, of all by default: the product of letter vectors rolled by their place.

    Those of a text are multiplied when needed; a table of all would fill 54 MB of every worker for good.
    """
    begin, last = _halves()
    first, letter = np.divmod(np.arange(ALPHABET**N) if numbers is None else numbers, ALPHABET)
    out = begin.take(first, axis=0)
    return np.multiply(out, last.take(letter, axis=0), out=out)


def codes(text: str) -> np.ndarray:
    """The n-gram numbers of a whole text; runs of other characters count as one gap."""
    letters = symbols()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    if not letters.any():
        return np.zeros(0, np.int64)
    padded = np.concatenate([[0], letters, [0]])
    padded = padded[1:][(padded[1:] != 0) | (padded[:-1] != 0)].astype(np.int64)
    padded = np.concatenate([[0], padded])
    if len(padded) < N:
        padded = np.concatenate([padded, np.zeros(N - len(padded), np.int64)])
    out = np.zeros(len(padded) - N + 1, np.int64)
    for place in range(N):
        out = out * ALPHABET + padded[place:len(padded) - N + 1 + place]
    return out


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summed bundle of letter n-gram vectors per language and task."""
    counts: dict[str, np.ndarray] = {}
    for batch in trimmed(batches, 500):
        for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist()):
            mine = counts.setdefault(lang, np.zeros(ALPHABET**N, np.int64))
            found, times = np.unique(codes(text or ""), return_counts=True)
            mine[found] += times
    for lang, mine in counts.items():
        used = np.flatnonzero(mine)
        bundle = np.zeros(DIMENSIONS, np.int64)
        for part in np.array_split(used, len(used) // 1_000 + 1):
            bundle += mine[part] @ grams(part).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([bundle.tolist()], pa.list_(pa.int64()))], names=["lang", "bundle"])


def _units(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def profiles(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the unit vectors of their bundles, from ``lang`` and ``text`` of all rows.

    What reaches the driver is one vector per language. Rows without a language teach nothing.
    """
    known = docs.filter(F.col("lang").isNotNull()).select("lang", "text")
    sums = (
        known.mapInArrow(_bundles, "lang string, bundle array<long>")
        .select("lang", F.posexplode("bundle").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("b")).orderBy("lang").collect())
    vectors = np.array([[x["v"] for x in r["b"]] for r in sums], float).reshape(len(sums), DIMENSIONS)
    return [r["lang"] for r in sums], _units(vectors)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their centred unit prototypes (see ``profiles``)."""
    names, vectors = profiles(docs)
    return names, _units(vectors - vectors.mean(axis=0)) if len(names) > 1 else vectors


def predict(text: str | None, names: list[str], prototypes: np.ndarray) -> tuple[str, float]:
    """The language of a whole text and (1 + cosine) / 2; ``und`` and 0 without a letter or prototypes."""
    found, times = np.unique(codes(text or ""), return_counts=True)
    if not len(found) or not names:
        return "und", 0.0
    bundle = times.astype(np.float32) @ grams(found).astype(np.float32)
    cosines = prototypes @ bundle / max(float(np.linalg.norm(bundle)), 1e-9)
    best = int(np.argmax(cosines))
    return names[best], float(np.clip((1 + cosines[best]) / 2, 0, 1))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches, 500):
            made = [predict(text, *model.value) for text in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), column(batch, "held_out"), pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1] for m in made], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def resembles(text: str | None, vectors: np.ndarray, least: float) -> bool:
    """Whether a text has a letter and is near enough to one of the languages' ``profiles``.

    The cosine is that of the square roots of the text's n-gram counts with the uncentred profile, so a
    text of no learned language falls short of all of them. A short text resembles its own language
    less, so the limit grows with the number of distinct n-grams.
    """
    found, times = np.unique(codes(text or ""), return_counts=True)
    if len(found) <= FEW or not len(vectors):
        return bool(len(found))
    bundle = np.sqrt(times.astype(np.float32)) @ grams(found).astype(np.float32)
    best = float(np.max(vectors @ bundle)) / max(float(np.linalg.norm(bundle)), 1e-9)
    return best >= least * min(1.0, (len(found) - FEW) / (ENOUGH - FEW))


def _reject(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches, 500):
            keep = [resembles(text, model.value, least) for text in column(batch, "text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def identify(docs: DataFrame, folds: int = 3) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text, lang``).

    Documents whose id's CRC32 is 1 modulo ``folds`` are held out, so are null ids: they teach nothing.
    ``lang_pred`` is a learned language, or ``und`` with score 0 for null text, text without a letter,
    or when nothing was learned; ``score`` is (1 + cosine) / 2. Ties go to the first language in code
    point order. Repeated rows are predicted alike; other columns are ignored; an empty table gives an
    empty result.
    """
    held = F.coalesce(remainder(F.col("doc_id"), folds) == 1, F.lit(True))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(~held)))
    rows = docs.select(long_id(), held.alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def drop_unknown(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """``docs`` with all its columns, without texts of no language.

    Rejected are texts without a letter and texts that resemble no language of the table (see
    ``resembles``); ``least`` is the limit for texts of ``ENOUGH`` distinct n-grams or more. Texts of up to
    ``FEW`` distinct n-grams stay if they have a letter. Where no row has a language to learn from,
    texts with a letter stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles(docs)[1])
    return docs.mapInArrow(_reject(model, least), docs.schema)
