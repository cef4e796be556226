"""What several operators of this folder share: words, folds, row numbers, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rosterline.session import cut_lineage

# The six white-space characters that separate words, as a pattern and as bytes.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

written = cut_lineage


def remainder(doc_id: Column, parts: int) -> Column:
    """CRC32 of the id's decimal digits, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def long_id() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


def whole_text(text: Column | str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def rows_of(docs: DataFrame, *columns: str | Column, row: str | None = None) -> DataFrame:
    """The columns an operator reads, and ``_row``: a number that tells all rows apart.

    ``row`` names a column that has such numbers. Otherwise it is the row's place in its partition,
    which is the same in every evaluation when ``docs`` is a scan of written files, as all operators
    here expect (``written`` makes one of any other table).
    """
    number = F.col(f"`{row}`") if row else F.monotonically_increasing_id()
    return docs.select(*columns, number.alias("_row"))


def keep_rows(docs: DataFrame, choose: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of ``docs`` whose number is among the ``_row`` of what ``choose(docs, row)`` returns."""
    row = "row"
    while row in map(str.lower, docs.columns):
        row += "_"
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    keep = choose(rows, row).select(F.col("_row").alias(row))
    return rows.join(keep, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def trimmed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """``slices``; before and after, a worker gives back what its pools hold of earlier batches and stages."""
    pools = pa.default_memory_pool(), pa.system_memory_pool()
    for pool in pools:
        pool.release_unused()
    yield from slices(batches, rows)
    for pool in pools:
        pool.release_unused()


def total(docs: DataFrame, value: Column) -> int:
    """One number over all rows; 0 for an empty table."""
    return docs.agg(F.sum(value).alias("total")).first()["total"] or 0


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose output bits all depend on all input bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))
