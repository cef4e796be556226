"""Removal of repeated byte strings by sorting suffixes: shallow multikey passes, then blind tries.

Sorting every suffix of a corpus would move each byte a hundred times. Only suffixes that can have a
partner are sorted, and each is sent once:

1. Every 100-byte window chooses an anchor: the position in it whose 32-byte gram has the least hash.
   Equal windows choose anchors with equal grams at equal places, so a window can only equal windows
   of the same gram. Neighbouring windows mostly share an anchor; one in 35 positions is one.
2. Grams are counted in buckets of their hash. Windows whose gram occurs once are settled: unique.
3. For every other anchor its segment (the bytes of all its windows) goes to the owner of the gram's
   bucket, equal segments of a block once. The owner sorts segments, keeps the first of equal
   ones, and sorts the windows (suffixes cut at 100 bytes) of segments that share a gram but differ.
   Within equal windows all but the first are repeats.
4. A bucket with more segments than one owner should hold is not given to one: its windows are
   counted by hash, and those that may occur twice are grouped by their bytes over all tasks, each task
   combining its own first. So a passage that any number of documents share, each with other
   neighbours, is no task's alone.
5. Repeats go back to their documents, where the covered bytes are removed.

Sorting is deep-shallow: the first words are sorted by multikey passes over groups of equal prefixes;
groups that stay equal beyond that are ordered by blind tries, which skip the common prefix and branch
at the first word in which the members differ.

Positions go by document id, row and offset. Hashes only choose who meets whom; equality is always
decided on bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from rosterline.llm.common import column, long_id, mix64, rows_of, total, whole_text, written

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
LONGEST = WINDOW - 1 + LENGTH  # of a segment
BLOCK = 1 << 18
# Rows of bytes are gathered so many at a time.
SLICE = 2_000
_PLACE_BITS = 21
CHUNK_ROWS = 256
# A longer text is a chunk of its own, so that a chunk has 64 MB or one text.
CHUNK_TEXT = 1 << 18
# A document without an id comes after all others.
NO_ID = 2**63 - 1

RECORD = np.dtype([
    ("doc", "<i8"), ("row", "<i8"), ("pos", "<i8"), ("tag", "<u4"), ("at", "u1"), ("length", "u1"), ("bytes", "u1", (LONGEST,))])
SPAN = np.dtype([("row", "<i8"), ("start", "<i8"), ("end", "<i8")])

_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def packed(records: np.ndarray) -> bytes:
    return _PACK.compress(np.ascontiguousarray(records).tobytes())


def unpacked(blobs, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(_UNPACK.decompress(b) for b in blobs), dtype)


# --- deep-shallow sorting ---------------------------------------------------------------------------

def _refine(keys: np.ndarray, order: np.ndarray, starts: np.ndarray, at: np.ndarray, group: np.ndarray) -> None:
    """Sort the positions ``at`` (whole groups) by ``keys`` within their groups and split the groups."""
    by = np.lexsort((keys, group))
    order[at] = order[at][by]
    keys = keys[by]
    starts[at[1:]] |= (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])


def _open(starts: np.ndarray, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in groups of two and more that are not settled, their groups, and all groups."""
    groups = np.cumsum(starts) - 1
    sizes = np.bincount(groups, minlength=1)
    at = np.flatnonzero((sizes[groups] > 1) & ~settled)
    return at, groups[at], groups


def deep_shallow(words: np.ndarray, shallow: int = 2) -> np.ndarray:
    """Group numbers of the rows of ``words``, rising in their order; equal rows share a number."""
    n, width = words.shape
    order, starts, settled = np.arange(n), np.zeros(n, bool), np.zeros(n, bool)
    if not n:
        return order
    starts[0] = True
    for depth in range(min(shallow, width)):
        at, group, _ = _open(starts, settled)
        if not len(at):
            break
        _refine(words[order[at], depth], order, starts, at, group)
    while shallow < width:
        at, group, _ = _open(starts, settled)
        if not len(at):
            break
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(first, len(at)))
        branch = np.full(len(first), width)
        for depth in range(width - 1, shallow - 1, -1):
            keys = words[order[at], depth]
            differ = np.logical_or.reduceat(keys != np.repeat(keys[first], sizes), first)
            branch[differ] = depth
        whole = branch == width
        settled[at[np.repeat(whole, sizes)]] = True
        rest = ~np.repeat(whole, sizes)
        if not rest.any():
            break
        at, group = at[rest], group[rest]
        _refine(words[order[at], np.repeat(branch, sizes)[rest]], order, starts, at, group)
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(starts) - 1
    return out


def as_words(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Byte rows as big-endian words, after one word that keeps different groups apart."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    return np.concatenate([first.astype(np.uint64)[:, None], padded.view(">u8").astype(np.uint64)], axis=1)


def not_first(groups: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether another member of the group starts earlier."""
    by = np.lexsort((pos, row, doc, groups))
    later = np.zeros(len(groups), bool)
    later[by[1:]] = groups[by[1:]] == groups[by[:-1]]
    return later


# --- anchors ------------------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, and a word for each byte."""
    base = 0x9E3779B97F4A7C15
    n = 2 * BLOCK + LONGEST + 2
    powers = np.full(n, base, np.uint64)
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    return np.cumprod(powers), np.cumprod(inverse), mix64(np.arange(1, 257, dtype=np.uint64))


class Block:
    """The anchors of some pieces of text: window ranges ``low..high`` of the anchors ``at``."""

    def __init__(self, data: np.ndarray, pieces: list[tuple[int, int]]):
        """``pieces`` are (start, end) in ``data``; windows do not cross them."""
        powers, inverse, words = _powers()
        self.data = data
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words[data] * powers[:len(data)])])
        empty = np.zeros(0, np.int64)
        self.at = self.low = self.high = empty
        self.hash = np.zeros(0, np.uint64)
        if len(data) < LENGTH:
            return
        valid = np.ones(len(data) - LENGTH + 1, bool)
        for _, end in pieces:
            valid[max(0, end - LENGTH + 1):end] = False
        windows = np.flatnonzero(valid)
        if not len(windows):
            return
        grams = len(data) - GRAM + 1
        hashes = mix64((self.sums[GRAM:] - self.sums[:grams]) * inverse[:grams])
        # Among equal hashes (as far as compared) the leftmost is the anchor.
        least = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(grams, dtype=np.uint64)
        span = 1
        while span * 2 <= WINDOW:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < WINDOW:
            least = np.minimum(least[:len(least) - (WINDOW - span)], least[WINDOW - span:])
        chosen = (least[windows] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        self.at = chosen[first]
        self.low = windows[first]
        self.high = windows[np.append(first[1:], len(windows)) - 1]
        # Anchors have small hashes, so buckets go by another one.
        self.hash = mix64(hashes[self.at] ^ np.uint64(0x5851F42D4C957F2D))

    def digest(self, low: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes ``low..end``."""
        return mix64((self.sums[end] - self.sums[low]) * _powers()[1][low])

    def segments(self, low: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Their bytes as rows, zero after the end."""
        place = np.arange(LONGEST, dtype=np.int32)
        out = np.empty((len(low), LONGEST), np.uint8)
        for a in range(0, len(low), SLICE):
            part = slice(a, a + SLICE)
            out[part] = self.data[np.minimum(low[part, None].astype(np.int32) + place, len(self.data) - 1)]
            out[part][place >= length[part, None]] = 0
        return out


def blocks(docs: Iterator[tuple]) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about ``BLOCK`` bytes from (doc, row, bytes), with the pieces' start, doc, row and offset.

    A long document is cut into pieces that overlap by a window less a byte, so no window is lost.
    """
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def made():
        data = np.frombuffer(b"".join(p[3] for p in held), np.uint8)
        ends = np.cumsum([len(p[3]) for p in held])
        starts = ends - np.array([len(p[3]) for p in held])
        return (Block(data, list(zip(starts.tolist(), ends.tolist()))), starts,
                *(np.array([p[k] for p in held], np.int64) for k in range(3)))

    for doc, row, text in docs:
        for offset in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
            piece = text[offset:offset + BLOCK + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            held.append((doc, row, offset, piece))
            size += len(piece)
            if size >= BLOCK:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def _docs(table) -> Iterator[tuple]:
    """(doc, row, bytes) of an Arrow table or batch."""
    texts = table["text"].cast(pa.binary()).to_pylist()
    for doc, row, text in zip(table["doc_id"].to_pylist(), table["_row"].to_pylist(), texts):
        yield NO_ID if doc is None else doc, row, text


# --- the steps ----------------------------------------------------------------------------------------

def _offer(bits: int):
    """Step 2, at the texts: the gram tags of each chunk of rows by bucket, each once."""

    def offers(chunk: int, found: list[np.ndarray]):
        ids, counts = np.unique(np.concatenate(found), return_counts=True)
        bucket = (ids >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        tags = ids.astype(np.uint32)
        parts = list(zip(first, np.append(first[1:], len(ids))))
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[first]), pa.array([chunk] * len(first), pa.int64()),
            pa.array([tags[a:b].tobytes() for a, b in parts], pa.binary()),
            pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in parts], pa.binary()),
        ], names=["bucket", "chunk", "tags", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, []

        def by_chunk():
            for batch in batches:
                chunks = column(batch, "chunk").to_numpy()
                cuts = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])) if len(chunks) else []
                for a, b in zip(cuts, [*cuts[1:], len(chunks)]):
                    yield int(chunks[a]), batch.slice(a, b - a)

        for chunk, part in by_chunk():
            if chunk != at:
                if found:
                    yield offers(at, found)
                at, found = chunk, []
            found += [block.hash >> np.uint64(32 - bits) for block, *_ in blocks(_docs(part)) if len(block.hash)]
        if found:
            yield offers(at, found)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Step 2, at a bucket's owner: to each chunk its tags that occur twice or more."""
    chunks = table["chunk"].to_pylist()
    tags = [np.frombuffer(t, "<u4") for t in table["tags"].to_pylist()]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(own)).astype(bool) for t, own in zip(table["twice"].to_pylist(), tags)]
    _, at, counts = np.unique(np.concatenate(tags), return_inverse=True, return_counts=True)
    many = counts > 1
    many[at[np.concatenate(twice)]] = True
    ends = np.cumsum([len(t) for t in tags])
    kept = [own[many[at[end - len(own):end]]] for own, end in zip(tags, ends)]
    rows = [(c, k.tobytes()) for c, k in zip(chunks, kept) if len(k)]
    bucket = table["bucket"][0].as_py()
    return pa.table({
        "chunk": pa.array([c for c, _ in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()),
        "tags": pa.array([k for _, k in rows], pa.binary())})


def _spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), SPAN)
    out["row"], out["start"], out["end"] = row, start, end
    return out


def _segments(bits: int):
    """Step 3, at the texts: segments for the owners (bucket 0 and up), repeats in a block (bucket -1)."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(
            np.frombuffer(t, "<u4").astype(np.uint64) | np.uint64(b << 32)
            for b, t in zip(replies["bucket"].to_pylist(), replies["tags"].to_pylist()))]))
        chunk = docs["chunk"][0].as_py() if docs.num_rows else -1
        out: list[tuple[int, int, bytes]] = []
        made: list[tuple[np.ndarray, np.ndarray]] = []
        for block, starts, docs_, rows, offsets in blocks(_docs(docs.sort_by("_row"))) if len(known) else ():
            ids = block.hash >> np.uint64(32 - bits)
            place = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            take = np.flatnonzero(known[place] == ids)
            if not len(take):
                continue
            ids, low, high, at = ids[take], block.low[take], block.high[take], block.at[take]
            length = high - low + LENGTH
            piece = np.searchsorted(starts, low, "right") - 1
            doc, row, pos = docs_[piece], rows[piece], low - starts[piece] + offsets[piece]
            # Equal segments of the block: all but the first are repeats, whatever the owner finds.
            key = mix64(block.digest(low, low + length) ^ ids * np.uint64(3) ^ (length * 1000 + at - low).astype(np.uint64))
            by = np.lexsort((pos, row, doc, key))
            new = np.append(True, key[by][1:] != key[by][:-1])
            leader = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
            same = np.zeros(len(by), bool)
            for a in range(0, len(by), SLICE):
                i, j = by[a:a + SLICE], leader[a:a + SLICE]
                same[a:a + SLICE] = (
                    ~new[a:a + SLICE] & (ids[i] == ids[j]) & (length[i] == length[j]) & (at[i] - low[i] == at[j] - low[j])
                    & (block.segments(low[i], length[i]) == block.segments(low[j], length[j])).all(axis=1))
            repeat, send = by[same], np.sort(by[~same])
            if len(repeat):
                out.append((-1, 0, packed(_spans(row[repeat], pos[repeat], pos[repeat] + length[repeat]))))
            records = np.empty(len(send), RECORD)
            records["doc"], records["row"], records["pos"] = doc[send], row[send], pos[send]
            records["tag"], records["at"], records["length"] = ids[send].astype(np.uint32), at[send] - low[send], length[send]
            records["bytes"] = block.segments(low[send], length[send])
            made.append(((ids[send] >> np.uint64(32)).astype(np.int64), records))
        if made:
            bucket, records = (np.concatenate([m[k] for m in made]) for k in (0, 1))
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(by))):
                out.append((int(bucket[by[a]]), int(b - a), packed(records[by[a:b]])))
        return pa.table({
            "chunk": pa.array([chunk] * len(out), pa.int64()), "bucket": pa.array([b for b, _, _ in out], pa.int64()),
            "n": pa.array([n for _, n, _ in out], pa.int64()), "blob": pa.array([x for _, _, x in out], pa.binary())})

    return run


def repeats(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step 3, at an owner: (record number, span) of the repeated bytes among segments of its grams."""
    place = (records["tag"].astype(np.uint64) << np.uint64(16)) | (records["at"].astype(np.uint64) << np.uint64(8)) | records["length"]
    later = not_first(deep_shallow(as_words(records["bytes"], place)), records["doc"], records["row"], records["pos"])
    numbers, spans = [np.flatnonzero(later)], []
    own = records[later]
    spans.append(_spans(own["row"], own["pos"], own["pos"] + own["length"]))
    # Segments that differ but share a gram: their windows are compared at each distance to the anchor.
    first = np.flatnonzero(~later)
    _, tag, counts = np.unique(records["tag"][first], return_inverse=True, return_counts=True)
    first = first[counts[tag] > 1]
    tags, at, length = records["tag"][first], records["at"][first].astype(np.int64), records["length"][first].astype(np.int64)
    found = np.zeros((len(first), WINDOW + 1), bool)
    for distance in range(WINDOW):
        offset = at - distance
        has = np.flatnonzero((offset >= 0) & (offset <= length - LENGTH))
        if len(has) < 2:
            continue
        number = first[has]
        windows = np.empty((len(has), LENGTH), np.uint8)
        for a in range(0, len(has), SLICE):
            part = slice(a, a + SLICE)
            rows = records["bytes"][number[part]]
            windows[part] = np.take_along_axis(rows, offset[has][part, None] + np.arange(LENGTH), axis=1)
        later = not_first(
            deep_shallow(as_words(windows, tags[has])), records["doc"][number], records["row"][number], records["pos"][number])
        found[has[later], offset[has[later]]] = True
    edges = np.diff(np.concatenate([np.zeros((len(first), 1), np.int8), found.astype(np.int8)], axis=1), axis=1)
    r0, start = np.nonzero(edges == 1)
    _, stop = np.nonzero(edges == -1)
    pos = records["pos"][first[r0]]
    numbers.append(first[r0])
    spans.append(_spans(records["row"][first[r0]], pos + start, pos + stop - 1 + LENGTH))
    return np.concatenate(numbers), np.concatenate(spans)


def _own(table: pa.Table) -> pa.Table:
    blobs = [_UNPACK.decompress(b) for b in table["blob"].to_pylist()]
    chunk = np.repeat(table["chunk"].to_numpy(), [len(b) // RECORD.itemsize for b in blobs])
    numbers, spans = repeats(np.frombuffer(b"".join(blobs), RECORD))
    chunk = chunk[numbers]
    by = np.lexsort((spans["start"], spans["row"], chunk))
    chunk, spans = chunk[by], spans[by]
    first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else []
    return pa.table({
        "chunk": pa.array([int(chunk[a]) for a in first], pa.int64()),
        "blob": pa.array([packed(spans[a:b]) for a, b in zip(first, [*first[1:], len(chunk)])], pa.binary())})


def _windows(records: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every window of the segments, in parts: record numbers, places in the records, bytes as rows."""
    at, length = records["at"].astype(np.int64), records["length"].astype(np.int64)
    for distance in range(WINDOW):
        offset = at - distance
        has = np.flatnonzero((offset >= 0) & (offset <= length - LENGTH))
        for a in range(0, len(has), SLICE):
            number = has[a:a + SLICE]
            yield number, offset[number], np.take_along_axis(records["bytes"][number], offset[number, None] + np.arange(LENGTH), axis=1)


def _window_keys(rows: np.ndarray) -> np.ndarray:
    """A hash of each byte row."""
    keys = np.full(len(rows), LENGTH, np.uint64)
    for word in as_words(rows, np.zeros(len(rows))).T:
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + word)
    return keys


def _offer_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: the window hashes of each blob, each once, with its count there."""
    for batch in batches:
        for chunk, bucket, blob in zip(*(column(batch, c).to_pylist() for c in ("chunk", "bucket", "blob"))):
            keys, counts = np.unique(
                np.concatenate([_window_keys(rows) for *_, rows in _windows(unpacked([blob], RECORD))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(keys), chunk)), pa.array(np.full(len(keys), bucket)), pa.array(keys.view(np.int64)), pa.array(counts),
            ], names=["chunk", "bucket", "key", "n"])


def _shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: the windows of each blob whose hashes are among its ``keys``, with their bytes."""
    for batch in batches:
        for chunk, blob, keys in zip(*(column(batch, c).to_pylist() for c in ("chunk", "blob", "keys"))):
            records, known = unpacked([blob], RECORD), np.array(keys, np.int64)
            for number, offset, rows in _windows(records):
                take = np.isin(_window_keys(rows).view(np.int64), known)
                own = records[number[take]]
                if len(own):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(own), chunk)), pa.array(own["doc"]), pa.array(own["row"]),
                        pa.array(own["pos"] + offset[take]), pa.array([r.tobytes() for r in rows[take]], pa.binary()),
                    ], names=["chunk", "doc", "row", "pos", "bytes"])


def _gathered(table: pa.Table) -> pa.Table:
    """The repeated windows of a chunk as spans."""
    pos = table["pos"].to_numpy()
    return pa.table({
        "chunk": table["chunk"].slice(0, 1), "blob": pa.array([packed(_spans(table["row"].to_numpy(), pos, pos + LENGTH))], pa.binary())})


def spread_repeats(segments: DataFrame) -> DataFrame:
    """Step 4: ``chunk, blob`` of the repeats among the windows of ``segments``, which are whole buckets."""
    offers = written(segments.mapInArrow(_offer_windows, "chunk long, bucket long, key long, n long"))
    met = offers.groupBy("key").agg(F.sum("n").alias("times")).filter("times > 1").select("key")
    # A cell holds windows of one chunk.
    keys = offers.join(met, "key").groupBy("chunk", "bucket").agg(F.collect_list("key").alias("keys"))
    found = written(segments.join(keys, ["chunk", "bucket"]).select("chunk", "blob", "keys").mapInArrow(
        _shared_windows, "chunk long, doc long, row long, pos long, bytes binary"))
    place = F.struct("doc", "row", "pos")
    first = found.groupBy("bytes").agg(F.min(place).alias("first"))
    late = found.join(first, "bytes").filter(place != F.col("first"))
    return late.select("chunk", "row", "pos").groupBy("chunk").applyInArrow(_gathered, "chunk long, blob binary")


def cut(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """The text without the covered bytes, how many they are, and in how many runs."""
    if not len(start):
        return text, 0, 0
    steps = np.zeros(len(text) + 1, np.int32)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    covered = np.cumsum(steps[:-1]) > 0
    runs = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~covered].tobytes(), int(covered.sum()), runs


def _remove(with_text: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        all_ = unpacked(spans["blob"].to_pylist(), SPAN)
        all_ = all_[np.argsort(all_["row"], kind="stable")]
        out = []
        for doc, row, text in _docs(docs):
            a, b = np.searchsorted(all_["row"], [row, row + 1])
            kept, removed, runs = cut(text, all_["start"][a:b], all_["end"][a:b])
            out.append((row, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = list(zip(*out)) if out else [()] * 6
        return pa.table({
            "doc_id": docs["doc_id"], "_row": pa.array(columns[0], pa.int64()), "n_bytes": pa.array(columns[1], pa.int64()),
            "n_removed": pa.array(columns[2], pa.int64()), "n_spans": pa.array(columns[3], pa.int64()),
            "kept_sha256": pa.array(columns[4], pa.string()), "kept": pa.array(columns[5], pa.binary())})

    return run


def remove_repeats(
    docs: DataFrame, bucket_anchors: int = 100_000, with_text: bool = True, owner_segments: int = 200_000,
) -> DataFrame:
    """Texts as UTF-8 bytes without each byte of a 100-byte string that also starts earlier.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Earlier means a smaller id (null
    last), then a smaller row number, then a smaller offset. Returns one row per input row: ``doc_id,
    _row, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (the bytes). Null text is
    empty; texts under 100 bytes stay whole. Repeated rows: the first stays, the others lose what is
    100 bytes or longer. An empty table gives an empty result. Buckets of more than ``owner_segments``
    segments are spread over tasks by window; the result is the same.
    """
    rows = rows_of(docs, long_id(), whole_text().alias("text"))
    rows = rows.withColumn("chunk", F.expr(f"if(octet_length(text) > {CHUNK_TEXT}, -2 - _row, _row div {CHUNK_ROWS})"))
    anchors = total(rows, F.octet_length("text")) * 2 / (WINDOW + 1)
    bits = min(24, max(0, math.ceil(math.log2(max(1, anchors / bucket_anchors)))))
    offers = rows.mapInArrow(_offer(bits), "bucket long, chunk long, tags binary, twice binary")
    replies = offers.groupBy("bucket").applyInArrow(_repeated, "chunk long, bucket long, tags binary")
    segments = written(
        rows.groupBy("chunk").cogroup(replies.groupBy("chunk"))
        .applyInArrow(_segments(bits), "chunk long, bucket long, n long, blob binary"))
    hot = written(segments.groupBy("bucket").agg(F.sum("n").alias("n")).filter(f"n > {owner_segments}").select("bucket"))
    owned, spans = segments.filter("bucket >= 0"), segments.filter("bucket < 0").select("chunk", "blob")
    if not hot.isEmpty():
        spans = spans.union(spread_repeats(owned.join(hot, "bucket", "left_semi")))
        owned = owned.join(hot, "bucket", "left_anti")
    spans = spans.union(owned.select("chunk", "bucket", "blob").groupBy("bucket").applyInArrow(_own, "chunk long, blob binary"))
    out = rows.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(
        _remove(with_text),
        "doc_id long, _row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
