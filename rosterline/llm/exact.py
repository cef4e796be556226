"""Exact deduplication with an extendible-hash index on shared files.

1. Each task reads its texts once, deletes white space, and combines equal bytes in a table of its
   own. What leaves the task is one narrow row per document and one *entry* per distinct text, so a
   text that fills a third of the corpus leaves a task as one entry.
2. The directory grows by doubling: the bits of the key that name a bucket are extended by one,
   for overfull buckets only, until every bucket fits or holds a single key. It is computed from
   byte counts per key prefix. Buckets grow with the input beyond ``MOST`` of them, so the directory and
   the counts behind it stay below ``8 * MOST`` rows whatever the input; owners stream their buckets.
3. Owner tasks get whole key ranges (buckets), sorted by key. Entries of one key form a chain and
   are compared byte by byte, so a key collision never joins different texts. Only the chain of the
   current key is in memory. The settled index is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rosterline.llm.common import SPACES, column, keep_rows, long_id, rows_of, trimmed, written

ENTRY = (
    "kind int, doc_id long, row long, entry long, key long, body binary, sha string, "
    "n long, chars long, keep_id long, keep_row long"
)
_ENTRY = pa.schema([
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("entry", pa.int64()),
    ("key", pa.int64()), ("body", pa.binary()), ("sha", pa.string()), ("n", pa.int64()),
    ("chars", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()),
])
_SETTLED = pa.schema([
    ("entry", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()),
    ("group_size", pa.int64()), ("sha", pa.string()),
])
# Keys that agree in so many bits stay in one bucket; its chains are told apart by key anyway.
DEEPEST = 62
MOST = 1 << 14


def _better(a: tuple, b: tuple) -> bool:
    """Whether (chars, id, row) ``a`` stays rather than ``b``: longest, smallest id (null last), row."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


def _combine(held_bytes: int, key_bits: int):
    space = SPACES.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 33) - 1
        table: dict[int, list[list]] = {}
        held = 0

        def entries():
            found = [e for chain in table.values() for e in chain]
            for i in range(0, len(found), 2000):
                part = found[i:i + 2000]
                best = [e[4] for e in part]
                yield pa.RecordBatch.from_arrays([
                    pa.array([1] * len(part), pa.int32()), pa.nulls(len(part), pa.int64()),
                    pa.nulls(len(part), pa.int64()), pa.array([e[0] for e in part], pa.int64()),
                    pa.array([e[1] for e in part], pa.int64()), pa.array([e[2] for e in part], pa.binary()),
                    pa.array([hashlib.sha256(e[2]).hexdigest() for e in part]),
                    pa.array([e[3] for e in part], pa.int64()), pa.array([b[0] for b in best], pa.int64()),
                    pa.array([b[1] for b in best], pa.int64()), pa.array([b[2] for b in best], pa.int64()),
                ], schema=_ENTRY)

        for batch in trimmed(batches, 500):
            texts = column(batch, "text")
            chars = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            ids, rows = column(batch, "doc_id"), column(batch, "_row")
            mine = []
            for text, n, doc_id, row in zip(texts.cast(pa.binary()).to_pylist(), chars, ids.to_pylist(), rows.to_pylist()):
                body = (text or b"").translate(None, space)
                key = xxhash.xxh64_intdigest(body) >> (64 - key_bits) << (64 - key_bits)
                chain = table.setdefault(key, [])
                best = (n, doc_id, row)
                for entry in chain:
                    if entry[2] == body:
                        entry[3] += 1
                        if _better(best, entry[4]):
                            entry[4] = best
                        break
                else:
                    number += 1
                    entry = [number, key - 2**63, body, 1, best]
                    chain.append(entry)
                    held += len(body) + 200
                mine.append(entry[0])
            none = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * none, pa.int32()), ids.cast(pa.int64()), rows, pa.array(mine, pa.int64()),
                *(pa.nulls(none, f.type) for f in list(_ENTRY)[4:]),
            ], schema=_ENTRY)
            if held > held_bytes:
                yield from entries()
                table, held = {}, 0
        yield from entries()

    return run


def directory(entries: DataFrame, bucket_bytes: int, most: int = MOST) -> list[tuple[int, int]]:
    """The buckets as (depth, prefix), found by doubling while a bucket is overfull.

    A bucket that holds one key only is not split: its chain is walked in a stream. ``bucket_bytes`` is
    raised to the ``most``-th part of all bytes, so that at most ``8 * most`` counts come to the driver at once.
    """
    size = F.length("body") + 64

    def prefixes(rows: DataFrame, depth: int):
        # Keys are stored as key - 2^63, which sorts signed as the key sorts unsigned.
        prefix = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), 64 - depth)
        return rows.groupBy(prefix.alias("prefix")).agg(
            F.sum(size).alias("bytes"), (F.min("key") == F.max("key")).alias("one"))

    whole = entries.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    bucket_bytes = max(bucket_bytes, -(-whole // most))
    if whole <= bucket_bytes:
        return [(0, 0)]
    depth = min(40, int(np.ceil(np.log2(whole / bucket_bytes))) + 2)
    leaves: list[tuple[int, int]] = []
    top, rows, above = 0, entries, [0]
    while True:
        counts = {r["prefix"]: (r["bytes"], r["one"]) for r in prefixes(rows, depth).collect()}
        levels = [counts]
        for _ in range(depth - top):
            up: dict[int, tuple[int, bool]] = {}
            for prefix, (n, one) in levels[-1].items():
                was = up.get(prefix >> 1)
                up[prefix >> 1] = (n + was[0], False) if was else (n, one)
            levels.append(up)
        levels.reverse()
        open_ = above
        for d, level in enumerate(levels, start=top):
            split = []
            for prefix in open_:
                n, one = level.get(prefix, (0, True))
                if n <= bucket_bytes or one or d == DEEPEST:
                    leaves.append((d, prefix))
                else:
                    split.append(prefix)
            if d == depth:
                break
            open_ = [p * 2 + bit for p in split for bit in (0, 1)]
        if not split:
            return sorted(leaves, key=lambda x: x[1] << (64 - x[0]))
        prefix = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), 64 - depth)
        rows = rows.filter(prefix.isin(split))
        # Fewer than ``most`` prefixes are overfull; the fewer, the more bits are looked at in one pass.
        step = max(1, min(8, (8 * most // len(split)).bit_length() - 1))
        top, above, depth = depth, split, min(DEEPEST, depth + step)


def _with_bucket(buckets: list[tuple[int, int]]):
    lower = np.array([(p << (64 - d)) if d else 0 for d, p in buckets], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = column(batch, "key").to_numpy().view(np.uint64) ^ np.uint64(2**63)
            bucket = np.searchsorted(lower, keys, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bucket.astype(np.int64))], names=[*batch.schema.names, "bucket"])

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk rows sorted by key; chain and compare the bodies of each key."""
    key, chain, out = None, [], []

    def settled():
        for _, members, n, best, sha in chain:
            out.extend((entry, best[1], best[2], n, sha) for entry in members)

    def flush():
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _SETTLED)], schema=_SETTLED)

    for batch in trimmed(batches, 500):
        for r in zip(*(column(batch, c).to_pylist() for c in ("key", "entry", "body", "n", "chars", "keep_id", "keep_row", "sha"))):
            if r[0] != key:
                settled()
                key, chain = r[0], []
                if len(out) > 20_000:
                    yield from flush()
                    out = []
            best = (r[4], r[5], r[6])
            for link in chain:
                if link[0] == r[2]:
                    link[1].append(r[1])
                    link[2] += r[3]
                    if _better(best, link[3]):
                        link[3] = best
                    break
            else:
                chain.append([r[2], [r[1]], r[3], best, r[7]])
    settled()
    if out:
        yield from flush()


def group_equal(
    docs: DataFrame, bucket_bytes: int = 16 << 20, held_bytes: int = 16 << 20, key_bits: int = 64,
    row: str | None = None,
) -> DataFrame:
    """Groups of documents whose texts are equal once white space is deleted.

    ``docs`` needs ``doc_id`` and ``text`` (``row``: see ``rows_of``); other columns are ignored. Returns one row per input row: ``doc_id, _row, keep_id, group_size, kept,
    text_sha256``. Of equal texts the one with the most code points stays, then the smallest id (null
    last), then the first row, so repeated rows leave exactly one. Null text counts as empty, and all
    empty texts are one group. An empty table gives an empty result. ``key_bits`` shortens the key
    (tests use it to force collisions).
    """
    rows = rows_of(docs, long_id(), "text", row=row)
    both = written(rows.mapInArrow(_combine(held_bytes, key_bits), ENTRY))
    members = both.filter("kind = 0").select("doc_id", F.col("row").alias("_row"), "entry")
    entries = both.filter("kind = 1").select("key", "entry", "body", "n", "chars", "keep_id", "keep_row", "sha")
    buckets = directory(entries, bucket_bytes)
    placed = entries.mapInArrow(
        _with_bucket(buckets),
        "key long, entry long, body binary, n long, chars long, keep_id long, keep_row long, sha string, bucket long")
    index = written(
        placed.repartition("bucket").sortWithinPartitions("key")
        .mapInArrow(_settle, "entry long, keep_id long, keep_row long, group_size long, sha string"))
    return members.join(index, "entry").select(
        "doc_id", "_row", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_equal(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all its columns and one row of each group of equal texts."""
    return keep_rows(docs, lambda rows, row: group_equal(rows, row=row, **options).filter("kept"))
