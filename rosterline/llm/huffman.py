"""Token ids in files: canonical Huffman codes of limited length, blocks that decode on their own.

Writing: texts become ids once (written to the shared folder with each task's counts per id), the counts
of all ids give code lengths of at most ``limit`` bits by package-merge, and documents are range-sorted
by id and written as blocks of whole documents. A block has its bit string, the bit offset of every
``STEP``-th id, and its documents' ids and lengths. Reading needs the code lengths and a block, nothing
else: a table over all ``limit``-bit windows gives the next id and its length, and all checkpoints of a
batch of blocks advance together, one id a step.

A folder of files has ``lengths`` (id, code length: the canonical codebook), ``blocks`` (one row per block)
and ``parts`` (ids in all earlier range parts). All three are Parquet, so that Spark's committed writers
and readers move them on any store.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rosterline.llm.common import column, long_id, rows_of, slices, written
from rosterline.session import shared_folder

END = 0
STEP = 512
BLOCK = 1 << 16
LIMIT = 18

# Runs of white space that overflow the merging engine's stack; each holds two neighbours of every 200th character.
_LONG_SPACE, _PROBE = re.compile(r"\s{400}"), re.compile(r"\s\s")
# Fixed value: the vocabulary's splitting rule.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ROWS = "doc_id long, row long, ids binary, id int, n long"
_ROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("ids", pa.binary()), ("id", pa.int32()), ("n", pa.int64())])
_BLOCKS = (
    "part int, block int, first long, n_ids long, payload binary, checkpoints array<int>, "
    "doc_ids array<long>, rows array<long>, lengths array<int>")
_BLOCK = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()),
    ("checkpoints", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int32())),
])
_DOCUMENT = pa.schema([
    ("doc_id", pa.int64()), ("_row", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()),
    ("ids_crc32", pa.int64()), ("ids", pa.binary()),
])


class TextIds:
    """Ids of a text by the vocabulary file.

    The file's own byte pairs are merged by ``tiktoken``, which is four times faster than ``tokenizers`` and
    agrees with it on every code point (tested); texts that spell special tokens or hold very long white
    space go through ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        # Byte-level vocabularies write bytes that do not print as characters from U+0100 on.
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = self.tokenizer.get_added_tokens_decoder()
        ranks = {
            bytes(byte[c] for c in token): number
            for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items() if number not in special}
        self.merge = tiktoken.Encoding("bytes", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = self.tokenizer.get_vocab_size()

    def encode(self, text: str) -> np.ndarray:
        # Special tokens are spelled with the same two characters.
        if "<|" in text or _PROBE.search(text[::200]) and _LONG_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.merge(text), np.uint32)


@lru_cache(maxsize=2)
def text_ids(tokenizer: str) -> TextIds:
    import public_tokenizers

    return TextIds(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))


def _to_ids(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = text_ids(tokenizer), np.uint32(end)
        counts = np.zeros(max(encoder.size, end + 1), np.int64)
        for batch in slices(batches, 200):
            texts = [encoder.encode(text or "") for text in column(batch, "text").to_pylist()]
            ids = [np.append(found, last) for found in texts]
            seen = np.concatenate(ids)
            counts += np.bincount(seen, minlength=len(counts))
            # Two bytes an id where they do; the number of ids tells the width.
            kind = "<u2" if seen.max() < 1 << 16 else "<u4"
            out, sizes = [own.astype(kind).tobytes() for own in ids], [len(own) for own in ids]
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), column(batch, "_row"), pa.array(out, pa.binary()),
                pa.nulls(size, pa.int32()), pa.array(sizes, pa.int64())], schema=_ROW)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            *(pa.nulls(len(used), f.type) for f in list(_ROW)[:3]), pa.array(used, pa.int32()), pa.array(counts[used])],
            schema=_ROW)

    return run


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for symbols with ``counts`` (all above 0).

    Package-merge: at every level the items are the symbols and the pairs of the level below, by weight;
    the ``2n - 2`` lightest items of the top level are taken, with what they contain. Items of a level
    are taken from the front, so a level is told by how many of its symbols are.
    """
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels, items = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(limit):
        levels.append(is_leaf)
        even = items[:len(items) // 2 * 2]
        both = np.concatenate([leaves, even[::2] + even[1::2]])
        place = np.argsort(both, kind="stable")
        items, is_leaf = both[place], place < n
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        mine = int(is_leaf[:take].sum())
        lengths[:mine] += 1
        take = 2 * (take - mine)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: shorter first, equal lengths by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, lens = ids[order].astype(np.uint32), lengths[order].astype(np.int64)
        self.limit = int(lens.max(initial=1))
        spans = np.int64(1) << (self.limit - lens)
        starts = np.cumsum(spans) - spans
        size = int(self.ids.max(initial=0)) + 1
        self.length, self.code = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.length[self.ids] = lens
        self.code[self.ids] = (starts >> (self.limit - lens)).astype(np.uint64)
        # Every window of ``limit`` bits: the id it begins with, and its length.
        whole = 1 << self.limit
        self.window_id, self.window_length = np.zeros(whole, np.uint32), np.ones(whole, np.int64)
        end = int(spans.sum())
        self.window_id[:end], self.window_length[:end] = np.repeat(self.ids, spans), np.repeat(lens, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string, padded to 32-bit words, and the bit offset of every ``STEP``-th id."""
        lens = self.length[ids]
        at = np.cumsum(lens) - lens
        words = (int(lens.sum()) + 31) // 32
        shift = (64 - lens - (at & 31)).astype(np.uint64)
        value = self.code[ids] << shift
        word = at >> 5
        # Codes do not overlap, so adding their halves sets bits; a sum of one word is exact in a double.
        bits = np.bincount(word, (value >> np.uint64(32)).astype(float), words + 1)
        bits += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), words + 1)[:words + 1]
        return bits[:words].astype(">u4").tobytes(), at[::STEP].astype(np.int32)

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """The ids of some blocks. Every checkpoint of every block is a lane; lanes advance together."""
        base, words, at, todo = 0, [], [], []
        for payload, points, n in zip(payloads, checkpoints, counts):
            own = np.frombuffer(payload, ">u4").astype(np.uint64)
            words += [own, np.zeros(2, np.uint64)]
            at.append(np.asarray(points, np.int64) + 32 * base)
            todo.append(np.minimum(STEP, n - STEP * np.arange(len(points))))
            base += len(own) + 2
        bits, at, todo = np.concatenate(words), np.concatenate(at), np.concatenate(todo)
        out = np.zeros((len(at), STEP), np.uint32)
        drop, mask = np.uint64(64 - self.limit), np.uint64((1 << self.limit) - 1)
        # Longest lanes first, so that those still running are always a front part.
        order = np.argsort(-todo, kind="stable")
        at, todo = at[order], todo[order]
        for step in range(int(todo.max(initial=0))):
            live = int(np.searchsorted(-todo, -step, "left"))
            here = at[:live]
            word = here >> 5
            window = ((bits[word] << np.uint64(32) | bits[word + 1]) >> (drop - (here & 31).astype(np.uint64))) & mask
            out[order[:live], step] = self.window_id[window]
            at[:live] = here + self.window_length[window]
        found, lane = [], 0
        for points, n in zip(checkpoints, counts):
            found.append(out[lane:lane + len(points)].reshape(-1)[:n])
            lane += len(points)
        return found


def _encode(ids: np.ndarray, lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, part = Codebook(ids, lengths), TaskContext.get().partitionId()
        held: list[tuple] = []
        size = first = block = 0

        def close():
            nonlocal size, first, block
            payload, points = book.encode(np.concatenate([np.frombuffer(h[2], f"<u{len(h[2]) // h[3]}") for h in held]))
            row = [part, block, first, size, payload, points, [h[0] for h in held], [h[1] for h in held], [h[3] for h in held]]
            first, block, size = first + size, block + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

        for batch in slices(batches, 500):
            for row in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "row", "ids", "n"))):
                held.append(row)
                size += row[3]
                if size >= BLOCK:
                    yield close()
        if held:
            yield close()

    return run


def _decode(ids: np.ndarray, lengths: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(ids, lengths)
        for batch in slices(batches, 8):
            payloads, points, counts = (column(batch, c).to_pylist() for c in ("payload", "checkpoints", "n_ids"))
            blocks = book.decode(payloads, points, counts)
            out: list[tuple] = []
            meta = (column(batch, c).to_pylist() for c in ("part", "first", "doc_ids", "rows", "lengths"))
            for own, part, first, doc_ids, rows, sizes in zip(blocks, *meta):
                data, at = memoryview(own.astype("<u4").tobytes()), 0
                for doc_id, row, n in zip(doc_ids, rows, sizes):
                    piece = data[4 * at:4 * (at + n)]
                    out.append((doc_id, row, part, first + at, n, zlib.crc32(piece), bytes(piece) if with_ids else None))
                    at += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _DOCUMENT)], schema=_DOCUMENT)

    return run


def write_ids(
    docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end: int = END, limit: int = LIMIT,
) -> None:
    """Write the ids of every document, in ascending order of ``doc_id``, to a new folder ``path``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``end`` closes each document; null
    text is empty and has that id only. Null ids come last, and rows with equal ids follow each other by
    their place in the scan. An empty table gives an empty folder that reads as no documents.
    ``tokenizer`` is the name or path of a vocabulary file that every worker has. What the driver holds
    is one count per id of the vocabulary.
    """
    read = written(rows_of(docs, long_id(), "text").mapInArrow(_to_ids(tokenizer, end), _ROWS))
    counted = read.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    ids, counts = counted["id"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    lengths = code_lengths(counts, limit)
    spark = docs.sparkSession
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id int, length int").coalesce(1).write.parquet(f"{path}/lengths")
    # The row's number keeps a hot or missing id from being one range.
    placed = read.filter("id is null").select("doc_id", "row", "ids", "n").repartitionByRange(
        F.col("doc_id").asc_nulls_last(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "row")
    placed.mapInArrow(_encode(ids, lengths), _BLOCKS).write.parquet(f"{path}/blocks")
    per_part = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per_part.select("part", F.coalesce(before, F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{path}/parts")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a folder made by ``write_ids``, decoded block by block.

    Returns ``doc_id, _row, start`` (ids of all documents before), ``n_tokens, ids_crc32`` and, if asked
    for, ``ids`` (little-endian 32-bit).
    """
    book = spark.read.parquet(f"{path}/lengths").toPandas()
    ids, lengths = book["id"].to_numpy(np.int64), book["length"].to_numpy(np.int64)
    found = spark.read.parquet(f"{path}/blocks").mapInArrow(
        _decode(ids, lengths, with_ids),
        "doc_id long, _row long, part int, first long, n_tokens long, ids_crc32 long, ids binary")
    out = found.join(spark.read.parquet(f"{path}/parts"), "part").select(
        "doc_id", "_row", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def through_files(docs: DataFrame, with_ids: bool = False, **options) -> DataFrame:
    """Every document as it comes back from files in the shared folder; see ``write_ids``, ``read_ids``."""
    path = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, **options)
    return read_ids(docs.sparkSession, path, with_ids)
