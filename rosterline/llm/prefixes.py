"""Prefix trie of conversations, by digests of fixed-length blocks of turns.

1. Turns shrink to a digest and a word count, get their place in their conversation, and conversations
   are rebuilt from a shared head and their own tail.
2. ``BLOCK`` turns make a block with one digest. The identity of a prefix of whole blocks is a
   polynomial over its block digests modulo 2^127 - 1, so that it can be composed from parts.
3. Conversations are grouped by (prefix before a block, prefix after it). Where a prefix goes on with
   one block only, all turns of that block have the same members and are written out as they are. Only
   where several different blocks follow are turn boundaries looked at: the distinct blocks (not their
   members) are cut into turns and those grouped by the turns up to there.
4. Sums over subtrees are gathered by pointer doubling among nodes with two members or more: a round
   joins every node to an ancestor twice as far up, so the rounds grow with the logarithm of the depth.
   Below them each node has one leaf and saves nothing.

Sorting is by ranges of (conversation, place), so a conversation with any share of the rows is spread
over tasks; what a task cannot know about the part of a conversation in earlier ranges is carried over
in one row per range. Hashes of the members that end at a node are taken in a stream over sorted ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from rosterline.llm.common import WORD, column, slices, written

BLOCK = 4
ROOT = "root"
NOBODY = hashlib.sha256(b"").hexdigest()
_PRIME = 2**127 - 1
# An arbitrary fixed base of the polynomial.
_BASE = int(hashlib.sha256(b"blocks of turns").hexdigest()[:31], 16)


def _digest(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _digest(F.length(role).cast("string"), F.lit(":"), role, text).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).filter("conv_id is not null")


def _in_order(rows: DataFrame, *order: Column | str) -> DataFrame:
    # Written first: the bounds of the ranges are sampled from it without computing it twice.
    return written(rows).repartitionByRange(*order).sortWithinPartitions(*order)


def _fold(keep: list[str], fold_hash: bool):
    """Number the rows of each conversation within the task, and fold their digests if asked to.

    Rows of the task's first and last conversation, which other tasks may share, are summed up in rows
    with ``part_n``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, n, folded = TaskContext.get().partitionId(), None, 0, 0
        ends: list[tuple] = []
        for batch in batches:
            ids, places, before, after = column(batch, "conv_id").to_pylist(), [], [], []
            digests = column(batch, "digest").to_pylist() if fold_hash else ids
            for conv_id, digest in zip(ids, digests):
                if conv_id != conv:
                    if conv is not None and not ends:
                        ends.append((conv, n, folded))
                    conv, n, folded = conv_id, 0, 0
                n += 1
                places.append(n)
                if fold_hash:
                    before.append(f"{folded:032x}")
                    folded = (folded * _BASE + int(digest, 16) + 1) % _PRIME
                    after.append(f"{folded:032x}")
            size, none = len(ids), [None] * len(ids)
            yield pa.RecordBatch.from_arrays([
                *(column(batch, c) for c in keep), pa.array([part] * size, pa.int32()), pa.array(places, pa.int64()),
                pa.array(before or none, pa.string()), pa.array(after or none, pa.string()), pa.nulls(size, pa.int64())],
                names=[*keep, "part", "place", "before", "after", "part_n"])
            kinds = [column(batch, c).type for c in keep]
        if conv is not None:
            ends.append((conv, n, folded))
            size = len(ends)
            yield pa.RecordBatch.from_arrays([
                *(pa.array([e[0] for e in ends], pa.int64()) if c == "conv_id" else pa.nulls(size, t) for c, t in zip(keep, kinds)),
                pa.array([part] * size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.string()),
                pa.array([f"{e[2]:032x}" for e in ends]), pa.array([e[1] for e in ends], pa.int64())],
                names=[*keep, "part", "place", "before", "after", "part_n"])

    return run


def _folded(rows: DataFrame, keep: str, fold_hash: bool) -> tuple[DataFrame, DataFrame]:
    """The rows with their place in the task, and per conversation in several tasks what came before."""
    names = [c.split(" ")[0] for c in keep.split(", ")]
    both = written(rows.select(*names).mapInArrow(
        _fold(names, fold_hash), f"{keep}, part int, place long, before string, after string, part_n long"))

    def carried(table: pa.Table) -> pa.Table:
        found = sorted(zip(*(table[c].to_pylist() for c in ("part", "conv_id", "part_n", "after"))))
        out, n, folded = [], 0, 0
        for part, conv, more, after in found:
            if n:
                out.append((conv, part, n, f"{folded:032x}"))
            n, folded = n + more, (folded * pow(_BASE, more, _PRIME) + int(after, 16)) % _PRIME
        return pa.table({
            "conv_id": pa.array([o[0] for o in out], pa.int64()), "part": pa.array([o[1] for o in out], pa.int32()),
            "carry_n": pa.array([o[2] for o in out], pa.int64()), "carry": pa.array([o[3] for o in out], pa.string())})

    # At most two rows per task, one per task of a conversation that fills whole tasks.
    ends = both.filter("part_n is not null").select("conv_id", "part", "part_n", "after")
    carry = ends.groupBy("conv_id").applyInArrow(carried, "conv_id long, part int, carry_n long, carry string")
    return both.filter("part_n is null").drop("part_n"), written(carry)


def _placed(conversations: DataFrame) -> DataFrame:
    """Turns with their place (from 1) in their conversation."""
    ordered = _in_order(_turns(conversations), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    rows, carry = _folded(ordered, "conv_id long, digest string, words long", False)
    return rows.join(carry.drop("carry"), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("carry_n", F.lit(0))).alias("place"), "digest", "words")


def _rebuilt(turns: DataFrame, family: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Members (``conv_id, total``) and their turns (``conv_id, total, depth, digest, words``)."""
    base = F.col("conv_id") - F.col("conv_id") % family
    own_head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    is_head = (F.col("conv_id") % family == 0) & (F.col("place") < heads)
    convs = written(turns.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(is_head, F.struct("place", "digest", "words")))).alias("head")))
    joined = convs.select("conv_id", "n", base.alias("base"), own_head.alias("h")).join(
        convs.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), "head"), "base", "left")
    own = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    members = written(joined.select(
        "conv_id", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,digest:string,words:bigint>>")), 1, F.col("h").cast("int")).alias("head"),
        own.alias("own")).select("*", F.size("head").cast("long").alias("m"), (F.size("head") + F.col("own")).alias("total")))
    taken = members.select("conv_id", "total", F.explode("head").alias("t")).select(
        "conv_id", "total", F.col("t.place").alias("depth"), "t.digest", "t.words")
    tails = turns.filter(F.col("place") > own_head).join(members.select("conv_id", "h", "m", "total"), "conv_id").select(
        "conv_id", "total", (F.col("place") - F.col("h") + F.col("m")).alias("depth"), "digest", "words")
    return members.select("conv_id", "total"), taken.unionByName(tails)


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of blocks whose conversation began in an earlier task: compose with what came before."""
    for batch in batches:
        fixed = []
        rows = zip(*(column(batch, c).to_pylist() for c in ("carry", "place", "before", "after")))
        for carry, place, before, after in rows:
            if carry is not None:
                c, power = int(carry, 16), pow(_BASE, place - 1, _PRIME)
                before = f"{(c * power + int(before, 16)) % _PRIME:032x}"
                after = f"{(c * power * _BASE + int(after, 16)) % _PRIME:032x}"
            fixed.append((before, after))
        keep = ["conv_id", "k", "total", "turns"]
        yield pa.RecordBatch.from_arrays(
            [*(column(batch, c) for c in keep), pa.array([f[0] for f in fixed], pa.string()), pa.array([f[1] for f in fixed], pa.string())],
            names=[*keep, "before", "after"])


_KIND = "array<struct<depth:bigint,digest:string,words:bigint>>"


def _chained(rows: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: its turns, and the prefixes before and after it."""
    blocks = rows.groupBy("conv_id", "total", F.floor((F.col("depth") - 1) / block).cast("long").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))).alias("turns"))
    # A sorted block has at most ``block`` turns; its digest covers all of them.
    digests = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    ordered = _in_order(blocks.withColumn("digest", _digest(digests)), "conv_id", "k")
    chained, carry = _folded(ordered, f"conv_id long, k long, total long, turns {_KIND}, digest string", True)
    if not carry.isEmpty():
        chained = chained.join(carry, ["conv_id", "part"], "left").mapInArrow(
            _corrected, f"conv_id long, k long, total long, turns {_KIND}, before string, after string")
    start = F.when(F.col("k") == 0, F.lit(ROOT)).otherwise(F.col("before"))
    return written(chained.select("conv_id", "k", "total", "turns", start.alias("before"), "after"))


def _node_at(j: Column, block: int) -> Column:
    """Identity of the node after ``j`` turns of a block: whole blocks have the prefix itself."""
    said = F.array_join(F.transform(F.slice("turns", 1, j), lambda t: t["digest"]), "")
    return F.when(j == block, F.col("after")).otherwise(_digest("before", F.lit(":"), said))


def _nodes(chained: DataFrame, block: int) -> DataFrame:
    """``node, parent, depth, words, n_convs, conv_id`` of all nodes but the root."""
    # Written, so that the join below gets its rows from an exchange of its own, which can split a prefix that
    # very many blocks follow.
    blocks = written(chained.groupBy("before", "after").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.any_value("turns").alias("turns")))
    siblings = chained.groupBy("before").agg((F.min("after") < F.max("after")).alias("forked"))
    seen = blocks.join(siblings, "before")
    steps = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda j: F.struct(
        _node_at(j, block).alias("node"),
        F.when(j == 1, F.col("before")).otherwise(_node_at(j - 1, block)).alias("parent"),
        F.element_at("turns", j)["depth"].alias("depth"), F.element_at("turns", j)["words"].alias("words")))
    out = written(seen.select("forked", "n_convs", "conv_id", F.explode(steps).alias("s")).select(
        "forked", "s.node", "s.parent", "s.depth", "s.words", "n_convs", "conv_id"))
    refined = out.filter("forked").groupBy("node", "parent", "depth", "words").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return out.filter("not forked").drop("forked").unionByName(refined)


def _ends(members: DataFrame, chained: DataFrame, block: int) -> DataFrame:
    """``node, ends_sha256``: the members whose last turn a node is."""
    last = chained.filter(F.col("k") == F.floor((F.col("total") - 1) / block)).select(
        _node_at(F.size("turns"), block).alias("node"), "conv_id")
    none = members.filter("total = 0").select(F.lit(ROOT).alias("node"), "conv_id")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in slices(batches, 5000):
            for own, conv_id in zip(column(batch, "node").to_pylist(), column(batch, "conv_id").to_pylist()):
                if own == node:
                    state.update(b",%d" % conv_id)
                else:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = own, hashlib.sha256(b"%d" % conv_id)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*out)], names=["node", "ends_sha256"])
                out = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    return last.unionByName(none).repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(
        stream, "node string, ends_sha256 string")


def _subtrees(shared: DataFrame) -> DataFrame:
    """``node, n_leaves, saved_tokens`` over subtrees, from each node's own ``leaves`` and ``saved``."""
    now = written(shared.select("node", F.col("parent").alias("above"), "leaves", "saved"))
    while not now.filter("above is not null").isEmpty():
        gained = now.filter("above is not null").groupBy("above").agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnRenamed("above", "node")
        next_ = now.select(F.col("node").alias("above"), F.col("above").alias("higher"))
        now = written(now.join(gained, "node", "left").join(next_, "above", "left").select(
            "node", F.col("higher").alias("above"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
    return now.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(conversations: DataFrame, family: int = 20, heads: int = 4, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    ``conversations`` needs ``conv_id, turn, role, text``; other columns are ignored. Turns follow
    ``turn`` (null first); equal turns follow the SHA-256 of role and text, and repeated rows are turns of
    their own. Null role or text is empty. Rows without ``conv_id`` belong to no conversation and are left
    out. Conversation c starts with the first h turns of conversation ``c - c % family`` and goes on with
    its own turns after the h-th; h is ``crc32(c) % heads``. Returns ``conv_id`` (smallest member),
    ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``. A table without
    conversations gives an empty result.
    """
    turns = written(_placed(conversations))
    members, rows = _rebuilt(turns, family, heads)
    chained = _chained(rows, block)
    root = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("words"), "n_convs", "conv_id")
    nodes = written(_nodes(chained, block).unionByName(root))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    families = written(nodes.join(children, "node", "left").select(
        "node", "parent", "depth", "words", "n_convs", "conv_id",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("single", F.lit(0)).alias("single")))
    sums = _subtrees(families.filter("n_convs > 1").withColumns({
        "leaves": F.col("single") + F.when(F.col("n_children") == 0, 1).otherwise(0),
        "saved": (F.col("n_convs") - 1) * F.col("words")}))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return families.join(above, "parent", "left").join(sums, "node", "left").join(_ends(members, chained, block), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"))
