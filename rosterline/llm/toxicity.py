"""Toxicity behind disguises: a noisy-channel decoder restores words, a linear model scores them.

Writers hide words by look-alike characters (``1d10t``), by separators and spaces (``i d.i o-t``) and by
repetition (``idiooot``). Each disguised word becomes a lattice of what its characters may stand for,
and Viterbi search under a character trigram model, counted over all documents, picks the reading.
Words that allow one reading only skip the search: it would return them unchanged. The restored words
are scored by a sparse logistic model fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rosterline.llm.common import column, long_id, remainder, slices
from rosterline.llm.language import symbols
from rosterline.llm.quality import ftrl, labelled

SAMPLE = 5_000
HELD_WORDS = 300_000
OTHER = 27
SIZE = 28

# What a character may stand for besides itself.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
}
# Costs (negative log weights) of the channel. Leaving a letter out also spares its price under the
# character model, about three, so what could be a letter is dear to leave out.
SUBSTITUTE, DELETE, DROP, BOUNDARY = 1.0, 0.5, 12.0, 6.0
# For leaving out the second letter of a pair, and of a longer run. A writer who doubles letters and a
# word that has a double letter look alike, so both prices are tried and both readings kept.
REPEATS = ((0.5, 0.5), (6.0, 3.5))
# Words split by spaces: pieces of so many characters, joined to so many.
PIECE, JOINED = 3, 16

_EDGE = "".join(c for c in string.punctuation if c not in "@$+|") + "«»“”„‘’…–—"
_DOUBLE, _RUN = re.compile(r"(.)\1+", re.DOTALL), re.compile(r"(.)\1*", re.DOTALL)
_hash = xxhash.xxh32_intdigest
_LETTERS = "\0" + string.ascii_lowercase


def letter_codes(text: str) -> np.ndarray:
    """Trigram numbers of a text over boundary, a to z and one symbol for other letters."""
    found = np.minimum(symbols()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")], OTHER).astype(np.int32)
    padded = np.concatenate([[0], found, [0]])
    padded = np.concatenate([[0, 0], padded[1:][(padded[1:] != 0) | (padded[:-1] != 0)]])
    return (padded[:-2] * SIZE + padded[1:-1]) * SIZE + padded[2:]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SIZE**3, np.int64)
    for batch in slices(batches, 200):
        text = " ".join(t for t in column(batch, "text").to_pylist() if t)
        counts += np.bincount(letter_codes(text), minlength=SIZE**3)
    yield pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([counts.astype("<i8").tobytes()], pa.binary())],
        names=["part", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for blob in column(batch, "counts").to_pylist():
            counts += np.frombuffer(blob, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["counts"])


def character_model(docs: DataFrame, smooth: float = 5.0) -> np.ndarray:
    """Log P(c | a, b) over all texts, interpolated with shorter contexts.

    Tasks count their own trigrams; 16 tasks add the counts up, so the driver gets 16 small tables.
    """
    per_task = docs.select("text").mapInArrow(_counts, "part int, counts binary")
    sums = per_task.repartition(16, "part").mapInArrow(_add, "counts binary").collect()
    three = sum((np.frombuffer(r["counts"], "<i8") for r in sums), np.zeros(SIZE**3, np.int64)).reshape((SIZE,) * 3).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + smooth * p1) / (two.sum(axis=1, keepdims=True) + smooth)
    p3 = (three + smooth * p2[None]) / (three.sum(axis=2, keepdims=True) + smooth)
    return np.log(p3)


@cache
def _options(char: str) -> list[tuple[int | None, float]]:
    """Readings of one character inside a disguised word: a letter, nothing, or a word boundary."""
    if "a" <= char <= "z":
        return [(ord(char) - 96, 0.0)]
    if char in LOOKALIKES:
        return [*((ord(c) - 96, SUBSTITUTE) for c in LOOKALIKES[char]), (None, DROP)]
    base = unicodedata.normalize("NFKD", char)[0].lower()
    if "a" <= base <= "z":
        return [(ord(base) - 96, 0.0)]
    if char.isalpha():
        return [(OTHER, 0.0)]
    return [(None, DELETE), (0, BOUNDARY)]


def lattice(chars: str, repeats: tuple[float, float], spaced: bool = False) -> list[list[tuple[int | None, float]]]:
    """Slots of readings. A run of equal characters may be one or two of them."""
    if not spaced:
        slots = [_options(c) for c in chars]
        for run in reversed(list(_DOUBLE.finditer(chars))):
            options = slots[run.start()]
            slots[run.start():run.end()] = [options, [*options, (None, repeats[run.end() - run.start() > 2])]]
        return slots
    slots = []
    for run in _RUN.finditer(chars):
        options, n = _options(run[1]), len(run[0])
        for k in range(min(n, 2)):
            if slots:
                slots.append([(None, 0.0), (0, BOUNDARY)])
            slots.append([*options, (None, repeats[n > 2])] if k else options)
    return slots


def viterbi(slots: list[list[tuple[int | None, float]]], model: list) -> str:
    """The likeliest string of letters and boundaries (as spaces) through a lattice."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in slots:
        if len(options) == len(states) == 1:
            # One way on: nothing to compare.
            (((a, b), (score, path)),), ((symbol, cost),) = states.items(), options
            if symbol is None or symbol == b == 0:
                states = {(a, b): (score - cost, path)}
            else:
                states = {(b, symbol): (score - cost + model[a][b][symbol], (path, symbol))}
            continue
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            row = model[a][b]
            for symbol, cost in options:
                if symbol is None or symbol == b == 0:
                    key, value, way = (a, b), score - cost, path
                else:
                    key, value, way = (b, symbol), score - cost + row[symbol], (path, symbol)
                if key not in after or after[key][0] < value:
                    after[key] = (value, way)
        states = after
    (a, b), (_, path) = max(states.items(), key=lambda s: (s[1][0] + (model[s[0][0]][s[0][1]][0] if s[0][1] else 0.0), s[0]))
    out = []
    while path:
        path, symbol = path
        out.append(" " if symbol == 0 else "?" if symbol == OTHER else _LETTERS[symbol])
    return "".join(reversed(out))


class Restorer(dict):
    """Lower-cased white-space separated tokens to the words they stand for."""

    def __init__(self, model: np.ndarray):
        super().__init__()
        self.model = model.tolist()

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= HELD_WORDS:
            self.clear()
        found = self[token] = self.read(token)
        return found

    def read(self, token: str) -> tuple[str, ...]:
        core = token.rstrip(_EDGE)
        # A leading exclamation mark may be a letter.
        core = core.lstrip(_EDGE) if not (core[:1] == "!" and core[1:2].isalnum()) else core
        if core.endswith("$$$"):
            core = core.rstrip("$").rstrip(_EDGE)
        if core.isalpha() and (core.isascii() or not any(c in LOOKALIKES for c in core)):
            if not _DOUBLE.search(core):
                return (core,)
            if [len(m[0]) for m in _DOUBLE.finditer(core)] == [2]:
                return tuple(sorted({core, *self.readings(core)}))
        if not any(c.isalpha() for c in core):
            return ()
        return tuple(sorted(self.readings(core)))

    def readings(self, chars: str, spaced: bool = False) -> set[str]:
        # Without a run of equal characters both prices give the same lattice.
        prices = REPEATS if _DOUBLE.search(chars) else REPEATS[:1]
        return {w for costs in prices for w in viterbi(lattice(chars, costs, spaced), self.model).split()}

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a whole text."""
        return self.taught(text) | self.joined(text.lower().split())

    def taught(self, text: str) -> set[str]:
        """Those that a training text teaches: all but joined pieces."""
        tokens = text.lower().split()
        return {w for t in set(tokens) for w in self[t]} | self.spelled(tokens)

    def spelled(self, tokens: list[str]) -> set[str]:
        """What runs of three or more tokens of one character, besides separators, spell."""
        found: set[str] = set()
        # Most tokens of more characters are letters and digits only, so nothing can be stripped from them.
        tokens = [t if len(t) == 1 or t.isalnum() else t.strip(_EDGE) for t in tokens]
        single = [i for i, t in enumerate(tokens) if len(t) == 1]
        start = 0
        while start < len(single):
            end = start
            while end + 1 < len(single) and single[end + 1] == single[end] + 1:
                end += 1
            if end - start >= 2:
                letters = "".join(tokens[single[start]:single[end] + 1])
                found |= self.readings(letters, spaced=True)
            start = end + 1
        return found

    def joined(self, tokens: list[str]) -> set[str]:
        """What two or more neighbouring tokens of up to ``PIECE`` characters give in one.

        Most are no words, so only whole ones count, not their beginnings.
        """
        found: set[str] = set()
        run: list[str] = []
        for token in tokens:
            piece = token if token.isalnum() else token.strip(_EDGE)
            if not 0 < len(piece) <= PIECE:
                run = []
                continue
            run = [r + piece for r in run if len(r) + len(piece) <= JOINED]
            found.update(run)
            run.append(piece)
        plain = {w for w in found if w.isascii() and w.isalpha()}
        return plain | {w for t in found - plain if any(map(str.isalpha, t)) for w in self[t]}


def stems_of(word: str) -> list[int]:
    """What is scored of a word, as 32-bit hashes: itself, and its beginnings of three to seven letters."""
    return [_hash(word), *[_hash(word[:k] + "*") for k in range(3, min(8, len(word)))]]


def stems(words: set[str]) -> np.ndarray:
    """The sorted distinct stems of some words."""
    return np.array(sorted({h for w in words for h in stems_of(w)}), np.uint32)


def _restore(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for batch in slices(batches, 500):
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), column(batch, "y"),
                pa.array([stems(restorer.taught(t or "")).tobytes() for t in column(batch, "text").to_pylist()], pa.binary()),
            ], names=["doc_id", "y", "stems"])

    return run


def lexicon(examples: list[tuple[np.ndarray, float]], least: int = 3, l1: float = 4.0) -> tuple[dict[int, float], float]:
    """Weights of stems that are not zero, and the bias. Stems in under ``least`` examples are left out."""
    if not examples:
        return {}, 0.0
    seen, counts = np.unique(np.concatenate([own for own, _ in examples]), return_counts=True)
    seen = seen[counts >= least]
    rows = []
    for own, y in examples:
        place = np.searchsorted(seen, own)
        place = place[place < len(seen)] if len(seen) else place[:0]
        own = own[:len(place)]
        rows.append((place[seen[place] == own], y))
    weights = ftrl([(i, np.ones(len(i)), y) for i, y in rows], len(seen), alpha=0.5, l1=l1, l2=0.001, epochs=4)
    return {int(h): float(w) for h, w in zip(seen, weights) if w}, float(weights[-1])


def _train(table: pa.Table) -> pa.Table:
    # Equal stems are copies of one document, which should not teach twice.
    unique = {}
    for doc_id, own, y in sorted(zip(table["doc_id"].to_pylist(), table["stems"].to_pylist(), table["y"].to_pylist())):
        unique.setdefault(own, (doc_id, y))
    ordered = sorted(unique.items(), key=lambda x: (x[1][0] * 2654435761) % 2**32)
    weights, bias = lexicon([(np.frombuffer(own, "<u4"), y) for own, (_, y) in ordered])
    return pa.table({"stem": pa.array([*weights, -1], pa.int64()), "weight": pa.array([*weights.values(), bias], pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, model, label: str, folds: int, sample: int) -> tuple[dict[int, float], float]:
    """The lexicon, whose size is bounded by the words of ``sample`` documents, and the bias."""
    chosen = labelled(labels, label, folds, sample)
    rows = docs.select(long_id(), "text").join(F.broadcast(chosen), "doc_id")
    restored = rows.mapInArrow(_restore(model), "doc_id long, y double, stems binary")
    one = restored.groupBy("doc_id").agg(F.min(F.struct("stems", "y")).alias("e")).select("doc_id", "e.*")
    got = {r["stem"]: r["weight"] for r in one.groupBy().applyInArrow(_train, "stem long, weight double").collect()}
    bias = got.pop(-1, 0.0)
    return got, bias


class Weights(dict):
    """Tokens to the stems in the lexicon of the words they stand for; None for most."""

    def __init__(self, restorer: Restorer, weights: dict[int, float]):
        super().__init__()
        self.restorer, self.weights = restorer, weights

    def known(self, words) -> set[int]:
        return {h for w in words for h in stems_of(w) if h in self.weights}

    def __missing__(self, token: str):
        if len(self) >= HELD_WORDS:
            self.clear()
        found = self[token] = tuple(sorted(self.known(self.restorer.read(token)))) or None
        return found


def _score(model, learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = learned.value
        restorer = Restorer(model.value)
        known = Weights(restorer, weights)
        for batch in slices(batches, 500):
            scores = []
            for text in column(batch, "text").to_pylist():
                tokens = (text or "").lower().split()
                words = {w for found in set(map(known.__getitem__, tokens)) if found for w in found}
                words |= known.known(restorer.spelled(tokens))
                words |= {h for h in map(_hash, restorer.joined(tokens)) if h in weights}
                z = bias + sum(weights[w] for w in sorted(words))
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -35, 35)))))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "score"])

    return run


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, folds: int = 5, sample: int = SAMPLE,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``).

    Documents whose id's CRC32 is 0 modulo ``folds`` are held out; so are null ids. Null and empty texts
    score by the bias alone. Repeated rows score alike; other columns are ignored; an empty table
    gives an empty result.
    """
    context = docs.sparkSession.sparkContext
    model = context.broadcast(character_model(docs))
    learned = context.broadcast(fit(docs, labels, model, label, folds, sample))
    rows = docs.select(
        long_id(),
        F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(True)).alias("held_out"), "text")
    scored = rows.mapInArrow(_score(model, learned), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
