"""Harmonic packing: tokens in sequences of fixed capacity, filled class by class.

Harmonic packing sorts lengths into the classes capacity/k and fills a class's bins with k pieces each,
so a bin needs no knowledge of any other. Documents may be cut freely here, which allows the pieces to
be made exactly as long as their class: whole capacities first, then the powers of two that sum to the
rest. k pieces of capacity/k fill a bin without padding. Every task fills the bins of each class on its
own while it reads, so nothing is shuffled and ids are moved once. What is left of a class at the end
of a task goes to sequences of power-of-two counts of pieces, whose lengths are powers of two and need no
padding either.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rosterline.llm.common import column, long_id, rows_of, trimmed

END = 1
HELD_WORDS = 100_000

# Letters and numbers below U+0250 after lower-casing, as the vocabulary's own splitting rule sees them.
_LETTER, _NUMBER = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
_PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
# Texts with any of these go through the tokenizer whole: characters whose lower case, composition or
# white-space class needs its own tables, and the spelling of special tokens.
_RARE = re.compile("[\x1c-\x1fİɐ-\U0010ffff]|<\\|")
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("_row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()),
    ("offset", pa.int64()), ("sequence_length", pa.int64()),
])


class WordIds(dict):
    """The ids of a white-space separated, lower-cased word, as little-endian bytes.

    Words of one text do not influence each other's ids, so a word is encoded once and then looked up;
    the table is emptied when it is full. Merging follows the ranks of the vocabulary file: byte pairs
    are merged lowest id first, with 0xFF (which no UTF-8 text holds) as the end of a word.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        # Byte-level vocabularies write bytes that do not print as characters from U+0100 on.
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = self.tokenizer.get_added_tokens_decoder()
        ranks = {}
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if number not in special:
                stem = token.removesuffix("</w>")
                ranks[bytes(byte[c] for c in stem) + (b"\xff" if stem != token else b"")] = number
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.parts[part] = array("I", self.merge(part.encode() + b"\xff")).tobytes()
        return found

    def __missing__(self, word: str) -> bytes:
        if len(self) >= HELD_WORDS:
            self.clear()
        if len(self.parts) >= HELD_WORDS:
            self.parts.clear()
        if word.isalpha():
            found = self[word] = array("I", self.merge(word.encode() + b"\xff")).tobytes()
        else:
            found = self[word] = b"".join(map(self.part, _PART.findall(word)))
        return found

    def encode(self, text: str) -> bytes:
        if not _RARE.search(text):
            return b"".join(map(self.__getitem__, text.lower().split()))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def _words(tokenizer: str) -> WordIds:
    import public_tokenizers

    return WordIds(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))


def cuts(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids: whole capacities, then falling powers of two."""
    full, rest = divmod(n, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packed(tokenizer: str, capacity: int, with_ids: bool):
    end = array("I", [END]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        sequence = TaskContext.get().partitionId() << 33
        # Per class the pieces of its open bin: fewer than capacity / length of them.
        bins: dict[int, list[tuple]] = {}
        out: list[tuple] = []

        def close(pieces: list[tuple], length: int):
            nonlocal sequence
            whole = length * len(pieces)
            out.extend((*piece, sequence, i * length, whole) for i, piece in enumerate(pieces))
            sequence += 1

        def rows():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)
            out.clear()

        for batch in trimmed(batches, 500):
            for doc_id, row, text in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "_row", "text"))):
                ids = memoryview(words.encode(text or "") + end)
                start, n = 0, len(ids) // 4
                for length in cuts(n, capacity):
                    own = ids[4 * start:4 * (start + length)]
                    bin_ = bins.setdefault(length, [])
                    bin_.append((doc_id, row, start, length, zlib.crc32(own), n, bytes(own) if with_ids else None))
                    if len(bin_) * length == capacity:
                        close(bin_, length)
                        bin_.clear()
                    start += length
            if out:
                yield from rows()
        for length, bin_ in sorted(bins.items()):
            while bin_:
                count = 1 << (len(bin_).bit_length() - 1)
                close(bin_[:count], length)
                del bin_[:count]
        if out:
            yield from rows()

    return run


def pack(
    docs: DataFrame, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", with_ids: bool = True,
) -> DataFrame:
    """Every id of every document at its place in a sequence.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``capacity`` is a power of two,
    ``tokenizer`` the name or path of a vocabulary file that every worker has. Returns one row per
    piece: ``doc_id, _row, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length`` and, if asked for, ``ids`` (little-endian 32-bit). A document's ids end with id
    1; null text is empty and has that id only. Rows with equal or null ids are packed each on its own,
    told apart by ``_row``. An empty table gives an empty result.
    """
    pieces = rows_of(docs, long_id(), "text").mapInArrow(
        _packed(tokenizer, capacity, with_ids),
        "doc_id long, _row long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, "
        "sequence_id long, offset long, sequence_length long")
    return pieces if with_ids else pieces.drop("ids")
