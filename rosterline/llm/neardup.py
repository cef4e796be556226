"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, stars.

1. A text's word shingles are hashed once; the hash's leading bits choose one of 128 bins and each
   bin keeps its least hash. Empty bins borrow from filled ones along a fixed random sequence
   (optimal densification). Texts with equal shingle sets become one class.
2. Bands of the signature are bucket keys. A bucket proposes a star: its centre against each other
   member. Of the centres of all its buckets a text is held against one in each round, so a round has no
   more pairs than texts.
3. Proposed pairs whose signatures do not rule it out are confirmed on full shingle sets; confirmed pairs
   give components. Buckets whose members are still in different components propose again, around other
   centres, in up to ``TURNS`` rounds.
4. A star leaves pairs of its outer members untested. All texts of buckets that still hold several components
   therefore go to an exact join on their rarest shingles (``prefix_pairs``), whose pairs are confirmed
   too. It sees every pair that shares a band, whatever the stars and the signatures said.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from rosterline.llm.common import column, keep_rows, long_id, mix64, rows_of, trimmed, written
from rosterline.llm.graph import components

BIN_BITS = 7
BANDS, ROWS = 25, 5
HELD_WORDS = 100_000
# Rounds of stars before the rest is settled by rare shingles.
TURNS = 3
# Pairs of one centre that share a copy of its text.
PART = 500
# How many standard deviations a signature may fall short of the limit in a star.
SLACK = 6.0
# Bits of the filter that texts pass before they are shuffled, in pieces of 4 KB: 4 MB in all, whatever the input.
FILTER_BITS, PIECE_BITS = 25, 15
# 64-bit words of a set's parities, which rule pairs out where more than ``FEW`` texts meet in a shingle.
WORDS, FEW = 16, 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class Shingler(dict):
    """Word hashes by word, emptied when full, and shingle sets of texts."""

    def __init__(self, width: int = 5):
        super().__init__()
        self.width = width
        self.hashes = np.zeros(HELD_WORDS + 1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        if place >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[place] = xxhash.xxh64_intdigest(word)
        return place

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles; of all words as one, if they are few."""
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self) >= HELD_WORDS:
            self.clear()

        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        h = self.hashes[places]
        width = min(self.width, len(h))
        sums = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            sums = mix64(sums * _ODD[k % len(_ODD)] + h[k:len(h) - width + 1 + k])
        return np.unique(sums)


@lru_cache(maxsize=1)
def _probes(tries: int = 4096) -> np.ndarray:
    """For each bin the random sequence of bins it borrows from."""
    bins = 1 << BIN_BITS
    seeds = np.arange(bins * tries, dtype=np.uint64).reshape(bins, tries) + np.uint64(1 << 40)
    return (mix64(seeds) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """One value per bin from a non-empty sorted hash set."""
    bins = 1 << BIN_BITS
    bounds = np.arange(bins, dtype=np.uint64) << np.uint64(64 - BIN_BITS)
    first = np.searchsorted(hashes, bounds)
    filled = first < np.append(first[1:], len(hashes))
    out = hashes[np.minimum(first, len(hashes) - 1)]
    empty = np.flatnonzero(~filled)
    for tries in (32, 4096):
        if not len(empty):
            break
        reach = filled[_probes()[empty, :tries]]
        found = reach.any(axis=1)
        at = reach.argmax(axis=1)
        out[empty[found]] = hashes[first[_probes()[empty[found], at[found]]]]
        empty = empty[~found]
    if len(empty):
        out[empty] = hashes[0]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    used = values[:BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64) + np.uint64(101)
    for k in range(ROWS):
        keys = mix64(keys * _ODD[k % len(_ODD)] + used[:, k])
    return keys


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in trimmed(batches, 500):
        sizes, digests, bands, short = [], [], [], []
        for text in column(batch, "text").to_pylist():
            hashes = shingler.of(text)
            sizes.append(len(hashes))
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
            values = signature(hashes) if len(hashes) else None
            bands.append(None if values is None else band_keys(values).view(np.int64))
            short.append(None if values is None else mix64(values).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([
            column(batch, "doc_id"), column(batch, "_row"), pa.array(sizes, pa.int64()),
            pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary()),
        ], names=["doc_id", "_row", "n", "digest", "bands", "short"])


def _compare(percent: int):
    """Walk rows sorted by group: the text of a centre, then the texts it is held against."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, centre = Shingler(), None
        for batch in trimmed(batches, 200):
            out = []
            for a, b, text in zip(*(column(batch, c).to_pylist() for c in ("a", "b", "text"))):
                own = shingler.of(text)
                if b is None:
                    centre = own
                else:
                    both = len(np.intersect1d(centre, own, assume_unique=True))
                    out.append((a, b, 100 * both >= percent * (len(centre) + len(own) - both)))
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out])],
                    names=["a", "b", "linked"])

    return run


def _likely(percent: int):
    """Pairs whose signatures do not rule the limit out; a signature of few shingles says less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = percent / 100
        for batch in trimmed(batches, 5_000):
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(column(batch, c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("short_a", "short_b"))
            drawn = np.minimum(column(batch, "n_min").to_numpy(), 1 << BIN_BITS)
            keep = (x == y).mean(axis=1) >= limit - SLACK * np.sqrt(limit * (1 - limit) / drawn)
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(keep)], names=["a", "b", "likely"])

    return run


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``_row`` is among ``ids``, and a few others: one bit per hash says whether an id has it.

    The bitmap has a fixed size, so it is sent to every task and the rows stay where they are. With more ids
    than ``2 ** FILTER_BITS`` most rows pass, which costs a later exact join time, never rows.
    """
    place = F.pmod(F.xxhash64("_row"), F.lit(1 << FILTER_BITS))
    piece, at = F.shiftright(place, PIECE_BITS), F.pmod(place, F.lit(1 << PIECE_BITS))
    # Dealt by piece first, so that no task sends pieces of its own.
    bits = ids.select(piece.alias("piece"), at.alias("at")).repartition("piece").groupBy("piece").agg(
        F.bitmap_construct_agg("at").alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), (piece == F.col("piece")) & (F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1), "left_semi")


def _texts_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``_row, text`` of the rows whose ``_row`` is among the distinct ``ids``; few other texts are shuffled."""
    return _marked(rows.select("_row", "text"), ids).join(ids, "_row", "left_semi")


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures come near enough to the limit. ``a`` may repeat without bound."""
    short = classes.select("class", "short", "n")
    b = short.select(F.col("class").alias("b"), F.col("short").alias("short_b"), F.col("n").alias("n_b"))
    a = short.select(F.col("class").alias("a"), F.col("short").alias("short_a"), F.col("n").alias("n_a"))
    signed = pairs.join(b, "b").join(a, "a").select("a", "b", "short_a", "short_b", F.least("n_a", "n_b").alias("n_min"))
    return signed.mapInArrow(_likely(percent), "a long, b long, likely boolean").filter("likely").select("a", "b")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` of pairs, by their full shingle sets.

    A text goes to its centre ``a`` once; the centre's own text goes once to each part of ``PART`` or so of
    its pairs, so a centre may have any number of them.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    text = lambda name: texts.select(F.col("_row").alias(name), "text")
    members = dealt.join(text("b"), "b").select("a", "part", "b", "text")
    centres = dealt.select("a", "part").distinct().join(text("a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = members.unionByName(centres).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return written(rows.mapInArrow(_compare(percent), "a long, b long, linked boolean"))


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each place of ``64 * WORDS`` whether an odd number of the set's hashes fall on it, as ``WORDS`` integers.

    A hash that is in one of two sets only turns one place, so two sets differ in at least as many hashes as
    their parities differ in places.
    """
    counts = np.bincount((hashes % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in trimmed(batches, 200):
        sets = [shingler.of(text) for text in column(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            column(batch, "class"), column(batch, "root"), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
            pa.array([parities(x) for x in sets], pa.list_(pa.int64()))], names=["class", "root", "tokens", "parity"])


def _like(n: str, other: str, percent: int):
    return F.expr(f"100 * least({n}, {other}) >= {percent} * greatest({n}, {other})")


def prefix_pairs(mixed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``a, b``: every pair of ``mixed`` (``class, root``) of different roots that may be linked.

    Shingles are ordered from rare to common among these texts. Two linked sets share a shingle among the
    first ``n - ceil(limit * n) + 1`` of each, and from their first shared one on both must have enough
    left. So texts meet in their rare shingles only; what a whole family has in common comes last.
    Where more than ``FEW`` texts meet, as in a family somewhat below the limit, a pair must also have parities
    that differ in no more places than linked sets may differ in shingles, so few pairs that are not linked are left.
    Sets of many more shingles than ``64 * WORDS`` fill the places and pass; none that is linked is ever lost.
    """
    read = written(texts.join(mixed, texts["_row"] == mixed["class"]).select("class", "root", "text").mapInArrow(
        _tokens, "class long, root long, tokens array<long>, parity array<long>"))
    flat = read.select("class", F.explode("tokens").alias("token"))
    common = flat.groupBy("token").agg(F.count("*").alias("count"))
    # One cell holds the shingles of one text.
    sorted_ = flat.join(common, "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("order"))
    sets = written(read.select("class", "root", "parity", F.size("tokens").cast("long").alias("n")).join(sorted_, "class").select(
        "class", "root", "n", "parity", F.transform("order", lambda x: x["token"]).alias("order")))
    first = F.expr(f"cast(n - ceil({percent} * n / 100) + 1 as int)")
    rows = sets.select("class", "root", "n", F.posexplode(F.slice("order", 1, first)).alias("at", "token"))
    met = rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("members")).filter("x != y").select("token", "members")
    # Parities come last, when few rows are left to carry them.
    rows = written(rows.join(met, "token").join(sets.select("class", "parity"), "class").select(
        "token", "class", "root", "n", "at", F.when(F.col("members") > FEW, F.col("parity")).alias("parity")))
    other = rows.select(
        "token", F.col("class").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"),
        F.col("parity").alias("parity_b"))
    # At the first shared shingle, what follows in both sets must suffice.
    room = F.expr(f"least(n - at, n_b - at_b) * {100 + percent} >= {percent} * (n + n_b)")
    apart = " + ".join(f"bit_count(parity[{k}] ^ parity_b[{k}])" for k in range(WORDS))
    near = F.expr(f"parity is null or ({apart}) * {100 + percent} <= {100 - percent} * (n + n_b)")
    return rows.join(other, "token").filter(
        (F.col("class") < F.col("b")) & (F.col("root") != F.col("root_b")) & _like("n", "n_b", percent) & room & near
    ).select(F.col("class").alias("a"), "b").distinct()


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their ``class`` so far."""
    if roots is None:
        return rows.withColumn("root", F.col("class"))
    return rows.join(roots, rows["class"] == roots["node"], "left").withColumn("root", F.coalesce("root", "class")).drop("node")


def group_near(docs: DataFrame, percent: int = 85, row: str | None = None) -> DataFrame:
    """Groups of documents linked by shingle sets of at least ``percent`` % Jaccard similarity.

    ``docs`` needs ``doc_id`` and ``text`` (``row``: see ``rows_of``); other columns are ignored. Returns one row per input row: ``doc_id, _row, n_shingles, component_id, kept, first``.
    ``component_id`` is the least id in reach (a null id counts only where there is no other), ``kept``
    says whether the row has that id, and ``first`` is true for exactly one row of each component, also
    where ids repeat. Null text, and text without words, has no shingles and links with nothing.
    An empty table gives an empty result.
    """
    rows = rows_of(docs, long_id(), "text", row=row)
    signed = written(rows.mapInArrow(_sign, "doc_id long, _row long, n long, digest binary, bands array<long>, short binary"))
    classes = written(
        signed.filter("n > 0").groupBy("digest").agg(F.min(F.struct("_row", "bands", "n", "short")).alias("c"))
        .select("digest", F.col("c._row").alias("class"), "c.bands", "c.n", "c.short"))
    exploded = classes.select("class", "n", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    members = written(exploded.join(shared, "bucket").select("bucket", "class", "n", "members"))
    texts = written(_texts_of(rows, members.select(F.col("class").alias("_row")).distinct()))

    links = tested = roots = None
    for turn in range(TURNS):
        # The texts that meet most others come first; then another order each time, so that buckets get other centres.
        order = F.lit(0 if turn == 0 else int(mix64(np.array([turn], np.uint64))[0] >> np.uint64(1)))
        if turn == 0:
            # A text that meets many others is likely to be the one they are copies of. A text is in 25 buckets at most.
            ranked = members.withColumn("first", -F.sum("members").over(Window.partitionBy("class"))).drop("members")
        else:
            ranked = members.withColumn("first", F.lit(0).cast("long"))
        placed = _rooted(ranked, roots)
        # The centre's root and size ride along, so that texts need no join with their centres.
        rank = F.struct("first", F.col("class").bitwiseXOR(order).alias("order"), "root", "n")
        stars = placed.groupBy("bucket").agg(
            F.min(rank).alias("rank"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("bucket", "rank")
        # One centre per class and round, the first of all its buckets: no more pairs than classes.
        pairs = placed.join(stars, "bucket").filter(
            (F.col("root") != F.col("rank.root")) & _like("n", "rank.n", percent)).groupBy(F.col("class").alias("b")).agg(
            F.min("rank")["order"].bitwiseXOR(order).alias("a"))
        found = _confirm(written(_promising(pairs, classes, percent)), texts, percent)
        tested = found if tested is None else tested.union(found)
        if found.filter("linked").isEmpty():
            break
        links = tested.filter("linked").select("a", "b")
        roots = written(components(links))
    placed = _rooted(members, roots)
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("bucket")
    mixed = written(placed.join(open_, "bucket").select("class", "root").distinct())
    if not mixed.isEmpty():
        done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = prefix_pairs(mixed, texts, percent).join(done, ["a", "b"], "left_anti")
        found = _confirm(written(left), texts, percent)
        if not found.filter("linked").isEmpty():
            roots = written(components(tested.union(found).filter("linked").select("a", "b")))

    own = signed.join(classes.select("digest", "class"), "digest", "left").select("doc_id", "_row", "n", F.coalesce("class", "_row").alias("class"))
    if roots is not None:
        own = own.join(roots, own["class"] == roots["node"], "left").select("doc_id", "_row", "n", F.coalesce("root", "class").alias("root"))
    else:
        own = own.withColumnRenamed("class", "root")
    own = written(own)
    least = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least"))
    return own.join(least, "root").select(
        "doc_id", "_row", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("least.doc_id")).alias("kept"), (F.col("_row") == F.col("least._row")).alias("first"))


def drop_near(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with all its columns and one row of each group of near-duplicates."""
    return keep_rows(docs, lambda rows, row: group_near(rows, percent, row).filter("first"))
