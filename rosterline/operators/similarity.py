"""Names that are nearly the same: the measure, exact candidate search, greedy clusters.

The measure is the indel ratio ``200 * LCS / (len a + len b)`` of the names with their words
sorted. Clusters follow the row order: the first free name is an anchor and takes every later free
name that is similar to it. That is not the transitive closure of similarity.

Small blocks are settled inside one task each; their size is checked first. Larger blocks are dealt into
tiles of names against names. There lengths and letter counts, as bits, leave few pairs in a thousand; then the
names must share one of the rarest grams without a common letter, as many as similar names must share one of
(the argument of pivotal prefixes, Deng et al., SIGMOD 2014), at matching places. Grams are counted and chosen
once. Anchors of earlier slices remove rows before the next slice is paired.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rosterline.session import cut_lineage

# Python workers get the few functions below with the task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sorted_words(value: Column) -> Column:
    """Words in code point order with single spaces."""
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    return F.array_join(F.sort_array(words), " ")


class Matcher:
    """Longest common subsequence against one fixed text, one big-integer step per character."""

    def __init__(self, text: str):
        self.length = len(text)
        self.full = (1 << self.length) - 1
        self.places: dict[str, int] = {}
        for i, ch in enumerate(text):
            self.places[ch] = self.places.get(ch, 0) | (1 << i)

    def common(self, other: str) -> int:
        row = self.full
        for ch in other:
            hit = row & self.places.get(ch, 0)
            row = ((row + hit) | (row - hit)) & self.full
        return self.length - row.bit_count()

    def similar(self, other: str, threshold: Fraction | float) -> bool:
        """Whether 200 x LCS reaches the threshold times both lengths, in whole numbers."""
        threshold = threshold if isinstance(threshold, Fraction) else exact(threshold)
        need = threshold.numerator * (self.length + len(other))
        if 200 * min(self.length, len(other)) * threshold.denominator < need:
            return False
        return 200 * self.common(other) * threshold.denominator >= need


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * Matcher(a).common(b) / total


def exact(threshold: float) -> Fraction:
    """The threshold as the fraction that was meant: 0.1 is one tenth."""
    return Fraction(str(threshold))


def _similar_batch(threshold: float):
    limit = exact(threshold)

    @F.pandas_udf(T.BooleanType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([Matcher(x).similar(y, limit) for x, y in zip(a, b)], dtype="bool")

    return similar


@F.pandas_udf(T.DoubleType())
def _ratio_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Indel ratio of two names after sorting their words, 0 to 100."""
    return _ratio_batch(sorted_words(a), sorted_words(b))


def _greedy_block(threshold: float):
    limit = exact(threshold)

    def settle(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("ord")
        free = list(zip(block["ord"], block["name"]))
        taken: list[tuple[int, int]] = []
        while free:
            (anchor, text), rest = free[0], free[1:]
            matcher = Matcher(text)
            free = []
            for row in rest:
                if matcher.similar(row[1], limit):
                    taken.append((row[0], anchor))
                else:
                    free.append(row)
        return pd.DataFrame(taken, columns=["ord", "anchor"]).astype("int64")

    return settle


def _allowance(total_length: str, threshold: float) -> str:
    """Letters two similar names may differ by (added and removed), from the sum of their lengths."""
    return f"cast(floor({100 - threshold} * ({total_length}) / 100 + 1e-9) as int)"


# Grams have up to so many letters; their counts are kept in so many buckets.
LONGEST_GRAM = 4
BUCKETS = 1 << 16
# Names of a block meet in tiles of so many against so many; a tile looks at so many pairs at a time.
TILE, AT_ONCE = 65_536, 1 << 18
# Slices with fewer pairs to look at per name are not halved: the pairs are no burden beside the names.
SPARSE = 16
# Names beyond this length choose their grams stretch by stretch.
STRETCH = 48


def picks_needed(length: int, threshold: float) -> int:
    """One more than the letters a name may differ by from a similar name that is not shorter."""
    longest = int(length * (200 - threshold) / threshold + 1e-9)
    return int((100 - threshold) * (length + longest) / 100 + 1e-9) + 1


def _bag(name: str) -> tuple[int, bytes]:
    """One bit per occurrence of a letter: up to 4 in 16 groups of letters, and up to 8 in 32 groups."""
    few, many = [0] * 16, [0] * 32
    for ch in name:
        few[ord(ch) % 16] += 1
        many[ord(ch) % 32] += 1
    fold = sum(((1 << min(4, n)) - 1) << 4 * i for i, n in enumerate(few))
    return fold - (fold >> 63 << 64), bytes((1 << min(8, n)) - 1 for n in many)


def _grams(names: DataFrame, threshold: float) -> DataFrame:
    """``block_id, ord, n`` and each gram of a name with its place ``at``.

    Single letters are left out where no similar name is short enough to need them.
    """
    shortest = f"cast(ceil(n * {threshold} / {200 - threshold} - 1e-9) as int)"
    needed = _allowance(f"a + cast(floor(a * {200 - threshold} / {threshold} + 1e-9) as int)", threshold)
    return (
        names.withColumn("n", F.length("name")).filter("n > 0")
        .withColumn("least", F.expr(f"if(exists(sequence({shortest}, n), a -> a < 2 * ({needed} + 1)), 1, 2)"))
        .withColumn("z", F.explode(F.expr(f"sequence(least, {LONGEST_GRAM})"))).filter("z <= n")
        .withColumn("at", F.explode(F.expr("sequence(0, n - z)")))
        .withColumn("gram", F.expr("substring(name, at + 1, z)")).drop("name", "least", "z")
    )


def gram_counts(names: DataFrame, threshold: float) -> np.ndarray:
    """How often grams occur, by hash: the order from rare to common. Its size does not depend on the names.

    Grams that share a bucket look more common than they are, which costs speed and changes no result.
    """
    bucket = F.crc32(F.col("gram").cast("binary")) % BUCKETS
    found = _grams(_spread(names), threshold).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).toPandas()
    counts = np.ones(BUCKETS)
    counts[found["bucket"].to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    return counts


def rare_grams(name: str, picks: int, cost) -> list[tuple[int, int]]:
    """``(place, length)`` of ``picks`` grams without a common letter, rarest first, of the least total count.

    ``cost(gram)`` is the count. Single letters are used only where longer grams leave no room.
    """
    found: list[tuple[float, int, int]] = []
    pieces = range(0, len(name), STRETCH) if len(name) > 64 else [0]
    size = STRETCH if len(name) > 64 else len(name)
    for start in pieces:
        part = name[start:start + size]
        end = min(start + size, len(name))
        want = picks * end // len(name) - picks * start // len(name)
        shortest = 1 if len(part) < 2 * want else 2
        # best[j]: least total for j grams among the letters so far; ways[i][j]: length of the gram that ends at i.
        rows, ways = [[0.0] + [math.inf] * want], [[0] * (want + 1)]
        costs = [[cost(part[i:i + z]) if z >= shortest else math.inf for z in range(1, LONGEST_GRAM + 1)] for i in range(len(part))]
        for i in range(1, len(part) + 1):
            best, way = list(rows[-1]), [0] * (want + 1)
            for z in range(shortest, min(LONGEST_GRAM, i) + 1):
                own, before = costs[i - z][z - 1], rows[i - z]
                for j in range(1, want + 1):
                    if before[j - 1] + own < best[j]:
                        best[j], way[j] = before[j - 1] + own, z
            rows.append(best)
            ways.append(way)
        i, j = len(part), want
        while j:
            z = ways[i][j]
            if z:
                found.append((costs[i - z][z - 1], start + i - z, z))
                i, j = i - z, j - 1
            else:
                i -= 1
    return [(at, z) for _, at, z in sorted(found)]


def _spread(names: DataFrame) -> DataFrame:
    """Names in all tasks: their files are small, but each name is much work."""
    return names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _prepared(threshold: float, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}

        def cost(gram: str) -> float:
            if gram not in known:
                if len(known) > 1_000_000:
                    known.clear()
                known[gram] = float(counts[zlib.crc32(gram.encode()) % BUCKETS])
            return known[gram]

        for batch in batches:
            names = batch.column(2).to_pylist()
            bags = [_bag(name) for name in names]
            picks = [[at * 8 + z for at, z in rare_grams(name, picks_needed(len(name), threshold), cost)] if name else [] for name in names]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([len(name) for name in names], pa.int32()), pa.array([fold for fold, _ in bags], pa.int64()),
                pa.array([bag for _, bag in bags], pa.binary()), pa.array(picks, pa.list_(pa.int32()))],
                names=["block_id", "ord", "name", "n", "fold", "bag", "picks"])

    return run


def prepared(names: DataFrame, threshold: float, counts: np.ndarray) -> DataFrame:
    """The names with their length, their letters as bits, and the places and lengths of their rare grams."""
    if "picks" in names.columns:
        return names
    return _spread(names.select("block_id", "ord", "name")).mapInArrow(
        _prepared(threshold, counts), "block_id long, ord long, name string, n int, fold long, bag binary, picks array<int>")


def _tiles(index: DataFrame, probe: DataFrame) -> DataFrame:
    """Each name once per tile ``(block_id, x, y)`` it belongs to; ``side`` is 0 for the index."""
    parts = F.ceil(F.count(F.lit(1)) / TILE).cast("int")
    sizes = index.groupBy("block_id").agg(parts.alias("xs")).join(probe.groupBy("block_id").agg(parts.alias("ys")), "block_id")
    columns = ("block_id", "x", "y", "side", "ord", "name", "n", "fold", "bag", "picks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, "block_id").withColumn("x", F.pmod(F.hash("ord"), "xs")).withColumn("y", every("ys"))
    right = probe.withColumn("picks", F.lit(None).cast("array<int>")).join(sizes, "block_id").withColumn(
        "y", F.pmod(F.hash("ord"), "ys")).withColumn("x", every("xs"))
    return left.withColumn("side", F.lit(0)).select(*columns).unionByName(right.withColumn("side", F.lit(1)).select(*columns))


def allowance(total, threshold: float):
    """Letters two similar names may differ by, as whole numbers; the same as ``_allowance``."""
    return np.floor((100 - threshold) * total / 100 + 1e-9).astype(np.int64)


def _close_letters(index: pa.Table, probe: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs that lengths and letters allow, both tables in order of length, the probe's name not the shorter."""
    a, b = index["n"].to_numpy(), probe["n"].to_numpy()
    fold = [t["fold"].to_numpy().view(np.uint64) for t in (index, probe)]
    bags = [np.frombuffer(b"".join(t["bag"].to_pylist()), np.uint64).reshape(-1, 4) for t in (index, probe)]
    order = [t["ord"].to_numpy() for t in (index, probe)]
    for n in np.unique(a[a > 0]):
        first, last = np.searchsorted(a, [n, n + 1])
        low, high = np.searchsorted(b, [n, int(n * (200 - threshold) / threshold + 1e-9) + 1])
        for there in range(low, high, 1 << 13):
            other = slice(there, min(there + (1 << 13), high))
            allowed = np.minimum(allowance(b[other].astype(np.int64) + n, threshold), 255).astype(np.uint8)
            step = max(1, AT_ONCE // (other.stop - there))
            for here in range(first, last, step):
                differ = np.bitwise_count(fold[0][here:min(here + step, last), None] ^ fold[1][None, other])
                i, j = np.nonzero(differ <= allowed)
                i, j = i + here, j + there
                longer = b[j].astype(np.int64) - n
                most = allowance(b[j].astype(np.int64) + n, threshold)
                mine, theirs = bags[0][i], bags[1][j]
                good = (np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64) * 2 <= most - longer) & (
                    np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64) * 2 <= most + longer) & (
                    (longer > 0) | (order[0][i] < order[1][j]))
                if good.any():
                    yield i[good], j[good]


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
    rows = pa.Table.from_batches(list(batches))
    side = rows["side"].to_numpy()
    return tuple(rows.take(np.flatnonzero(side == k)).sort_by("n") for k in (0, 1))


def _counted(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, probe = _sides(batches)
        met = sum(len(i) for i, _ in _close_letters(index, probe, threshold))
        yield pa.RecordBatch.from_arrays([pa.array([met], pa.int64())], names=["met"])

    return run


def _share_a_gram(s: str, picks: list[int], r: str, allowed: int) -> bool:
    """Whether one of the first ``allowed + 1`` grams of ``s`` is in ``r``, no further off than letters may be added or removed."""
    longer = len(r) - len(s)
    left, right = (allowed - longer) // 2, (allowed + longer) // 2
    return any(r.find(s[p >> 3:(p >> 3) + (p & 7)], max(0, (p >> 3) - left), (p >> 3) + right + (p & 7)) >= 0 for p in picks[:allowed + 1])


def _met(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, probe = _sides(batches)
        names, others = index["name"].to_pylist(), probe["name"].to_pylist()
        picks, s, r = index["picks"].to_pylist(), index["ord"].to_numpy(), probe["ord"].to_numpy()
        for i, j in _close_letters(index, probe, threshold):
            allowed = allowance(np.array([len(names[x]) + len(others[y]) for x, y in zip(i, j)]), threshold).tolist()
            near = [k for k, (x, y) in enumerate(zip(i, j)) if _share_a_gram(names[x], picks[x], others[y], allowed[k])]
            if near:
                i, j = i[near], j[near]
                yield pa.RecordBatch.from_arrays([
                    pa.array(s[i], pa.int64()), pa.array(r[j], pa.int64()), pa.array([names[x] for x in i], pa.string()),
                    pa.array([others[y] for y in j], pa.string())], names=["s", "r", "s_name", "r_name"])

    return run


def _candidates(index: DataFrame, probe: DataFrame, threshold: float, counts: np.ndarray | None) -> DataFrame:
    if counts is None:
        counts = gram_counts(index.select("block_id", "ord", "name").unionByName(probe.select("block_id", "ord", "name")), threshold)
    tiles = _tiles(prepared(index, threshold, counts), prepared(probe, threshold, counts))
    return tiles.groupBy("block_id", "x", "y").applyInArrow(_met(threshold), "s long, r long, s_name string, r_name string")


def candidates(index: DataFrame, probe: DataFrame, threshold: float, counts: np.ndarray | None = None) -> DataFrame:
    """Distinct ``(s, r)`` that may be similar: row numbers only, ``s`` not the longer name.

    Two similar names differ by at most k letters, added or removed, and each of these spoils at most one of
    the grams of ``s`` that have no letter in common. So of any k + 1 such grams one is whole in ``r``,
    and no further from its old place than the letters added or removed before it. The k + 1 rarest
    are looked up, for names of which neither lacks more of the other's letters, wherever they stand, than may
    be removed from ``s`` or added to it. A pair belongs to one tile, so it comes once.
    """
    return _candidates(index, probe, threshold, counts).select("s", "r")


def similar_pairs(index: DataFrame, probe: DataFrame, threshold: float, counts: np.ndarray | None = None) -> DataFrame:
    """Pairs ``(i, j)``, i before j, whose index name is not longer than the probe name.

    Inputs have ``block_id, ord, name``, and what ``prepared`` adds where that is done. Edit distance
    bounds the measure from below, so it discards most candidates inside the JVM; only the
    rest goes through Arrow.
    """
    if threshold <= 67:
        raise ValueError("grams would be empty at thresholds of two thirds and less")
    limit = _allowance("length(s_name) + length(r_name)", threshold)
    near = _candidates(index, probe, threshold, counts).filter(F.expr(f"levenshtein(s_name, r_name, {limit}) >= 0"))
    return near.filter(_similar_batch(threshold)("s_name", "r_name")).select(
        F.least("s", "r").alias("i"), F.greatest("s", "r").alias("j"))


def dominated_rows(edges: DataFrame, finish_below: int = 200_000) -> DataFrame:
    """``ord`` of the rows that are no anchors, from the similar pairs ``(i, j)`` with i before j.

    A row without a free earlier neighbour is an anchor and takes its neighbours. Rounds of this
    run on the whole pair table until few pairs are left, which one task then settles in order.
    """
    edges = cut_lineage(edges)
    taken = None
    while edges.count() > finish_below:
        blocked = edges.select(F.col("j").alias("i")).distinct()
        now = cut_lineage(edges.join(blocked, "i", "left_anti").select(F.col("j").alias("ord")).distinct())
        taken = now if taken is None else taken.unionByName(now)
        edges = cut_lineage(
            edges.join(now.select(F.col("ord").alias("j")), "j", "left_anti")
            .join(now.select(F.col("ord").alias("i")), "i", "left_anti")
            .select("i", "j")
        )
    last = edges.groupBy(F.lit(1).alias("g")).applyInPandas(_settle_edges, "ord long")
    return cut_lineage(last if taken is None else taken.unionByName(last))


def _settle_edges(edges: pd.DataFrame) -> pd.DataFrame:
    taken: set[int] = set()
    for i, j in edges.sort_values(["i", "j"])[["i", "j"]].itertuples(index=False):
        if i not in taken:
            taken.add(j)
    return pd.DataFrame({"ord": sorted(taken)}, dtype="int64")


def candidate_count(index: DataFrame, probe: DataFrame, threshold: float, counts: np.ndarray) -> float:
    """How many pairs lengths and letters allow, without making them."""
    tiles = _tiles(prepared(index, threshold, counts), prepared(probe, threshold, counts))
    return float(tiles.groupBy("block_id", "x", "y").applyInArrow(_counted(threshold), "met long").agg(F.sum("met")).first()[0] or 0)


def _cuts(names: DataFrame, shares: list[float]) -> list[int]:
    if not shares:
        return []
    return sorted(set(names.agg(F.percentile_approx("ord", shares, 100_000)).first()[0]))


def _between(names: DataFrame, low: int | None, high: int | None) -> DataFrame:
    if low is not None:
        names = names.filter(F.col("ord") > low)
    return names if high is None else names.filter(F.col("ord") <= high)


def _too_dense(part: DataFrame, others: DataFrame, threshold: float, max_candidates: float, counts: np.ndarray) -> bool:
    """Whether pairing a slice with others goes beyond the budget; few names and few pairs a name never do.

    A pair counts as ten, for the grams it may meet in.
    """
    rows, beside = part.count(), others.count()
    if rows < 2 or 10.0 * rows * beside <= max_candidates:
        return False
    most = max(max_candidates / 10.0, SPARSE * float(rows + beside))
    met = candidate_count(part, others, threshold, counts)
    return met > most or (others is not part and met + candidate_count(others, part, threshold, counts) > most)


def cluster_large(
    names: DataFrame, threshold: float, slice_rows: int, max_candidates: float, finish_below: int
) -> DataFrame:
    """``(ord, anchor)`` of every name an earlier anchor takes, for blocks of any size.

    The rows are settled in slices of their order, the first of about ``slice_rows`` rows and each
    four times the one before. Anchors found so far take their rows out of a slice before the rest
    is paired, and a slice that would meet the anchors or itself in too many pairs is halved. So many
    names that are all alike cost a few anchors, not all their pairs.
    """
    names = cut_lineage(names)
    counts = gram_counts(names, threshold)
    names = cut_lineage(prepared(names, threshold, counts))
    total = names.count()
    shares, reach = [], slice_rows
    while reach < total:
        shares.append(reach / total)
        reach *= 4
    cuts = _cuts(names, shares)
    # A slice, and how many sets of anchors it has met.
    waiting = [(_between(names, a, b), 0) for a, b in zip([None, *cuts], [*cuts, None])][::-1]
    anchors: list[DataFrame] = []
    result: list[DataFrame] = []

    def halve(part: DataFrame, seen: int) -> bool:
        middle = _cuts(part, [0.5])[0]
        halves = [_between(part, None, middle), _between(part, middle, None)]
        if halves[1].isEmpty():
            return False
        waiting.extend((half, seen) for half in halves[::-1])
        return True

    while waiting:
        part, seen = waiting.pop()
        if seen < len(anchors):
            earlier = reduce(DataFrame.unionByName, anchors[seen:])
            # Halving bounds what one job holds, not the work; small slices are not worth more jobs.
            if part.count() > slice_rows and _too_dense(part, earlier, threshold, max_candidates, counts) and halve(part, seen):
                continue
            hits = similar_pairs(earlier, part, threshold, counts).unionByName(similar_pairs(part, earlier, threshold, counts))
            early = cut_lineage(hits.groupBy(F.col("j").alias("ord")).agg(F.min("i").alias("anchor")))
            result.append(early)
            part = cut_lineage(part.join(early.select("ord"), "ord", "left_anti"))
        if _too_dense(part, part, threshold, max_candidates, counts) and halve(part, len(anchors)):
            continue
        edges = cut_lineage(similar_pairs(part, part, threshold, counts))
        taken = dominated_rows(edges, finish_below)
        result.append(cut_lineage(
            edges.join(taken.select(F.col("ord").alias("i")), "i", "left_anti")
            .groupBy(F.col("j").alias("ord")).agg(F.min("i").alias("anchor"))
        ))
        anchors.append(cut_lineage(part.join(taken, "ord", "left_anti")))
    return reduce(DataFrame.unionByName, result)


def cluster_names(
    names: DataFrame,
    threshold: float = 85.0,
    small_block: int = 1_000,
    slice_rows: int = 20_000,
    max_candidates: float = 2e9,
    finish_below: int = 200_000,
) -> DataFrame:
    """``(ord, anchor)`` for names taken by an earlier one; input has ``block, name, ord``.

    Names are distinct within a block. Blocks of up to ``small_block`` names go to one task each. The
    limits choose how the work is done, never the result. Thresholds up to two thirds are refused for
    blocks of every size: similar names would not need to share a gram.
    """
    if not 67 < threshold <= 100:
        raise ValueError("thresholds must be above 67 and at most 100")
    sizes = names.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("block_id"))
    sized = names.join(sizes.filter("size > 1"), "block")
    small = (
        sized.filter(F.col("size") <= small_block).select("block_id", "ord", "name")
        .groupBy("block_id").applyInPandas(_greedy_block(threshold), "ord long, anchor long")
    )
    large = sized.filter(F.col("size") > small_block).select("block_id", "ord", "name")
    if sizes.filter(F.col("size") > small_block).isEmpty():
        return small
    return small.unionByName(cluster_large(large, threshold, slice_rows, max_candidates, finish_below))
