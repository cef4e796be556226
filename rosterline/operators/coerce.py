"""The canonical record: one fixed schema, in one column order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rosterline import fixed
from rosterline.functions.blanks import NUMBER, to_number

SCHEMA = T.StructType(
    [T.StructField(n, T.DoubleType() if t == "double" else T.StringType()) for n, t in fixed.COLUMNS]
)


# A scan's row numbers stay below 2**PLACE_BITS with up to 2**(PLACE_BITS - 33) splits (16 million).
PLACE_BITS = 57
PLACES = 1 << (63 - PLACE_BITS)
# Stacked sources come after the base, whose files share one place.
AFTER_BASE = 1


def placed(number: Column, place: int) -> Column:
    """Row numbers of the scan at ``place``, behind those of all earlier places.

    Too many scans, or too many splits in one, fail rather than mix up rows.
    """
    if not 0 <= place < PLACES:
        raise ValueError(f"{PLACES} scans can follow each other; {place} is beyond that")
    fits = F.when(number < F.lit(1 << PLACE_BITS), number)
    return F.lit(place << PLACE_BITS) + F.coalesce(fits, F.raise_error(F.lit("too many splits for one scan")).cast("long"))


def row_order(place: int = 0) -> Column:
    """Numbers for the rows of a scan, in order; ``place`` sets scans apart."""
    return placed(F.monotonically_increasing_id(), place)


def with_room(docs: DataFrame, room: Column) -> DataFrame:
    """``docs`` with ``_start``: the room of all documents before it by ``_ord``.

    An element's place in its document plus ``_start`` numbers the elements of all documents in order,
    however the rows lie in partitions, when no document has more elements than ``room``. Sums run
    within a split of the scan that numbered the documents (a range of 2**33 numbers) and over the splits,
    on two narrow columns. ``_ord`` must be the same in every evaluation, as it is for scans of written
    files; a document whose number has changed fails.
    """
    narrow = docs.select("_ord", F.coalesce(room, F.lit(0)).cast("long").alias("_room")).withColumn(
        "_split", F.shiftright("_ord", 33))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = narrow.groupBy("_split").agg(F.sum("_room").alias("_sum")).select(
        "_split", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_split").orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    starts = narrow.withColumn("_inner", F.coalesce(F.sum("_room").over(within), F.lit(0))).join(splits, "_split").select(
        "_ord", (F.col("_base") + F.col("_inner")).alias("_start"))
    lost = F.raise_error(F.lit("documents were numbered anew between two readings; write them first")).cast("long")
    # Compressed files look smaller than their rows, so Spark would broadcast starts of any number.
    return docs.join(starts.hint("merge"), "_ord", "left").withColumn("_start", F.coalesce("_start", lost))


def empty_records(spark: SparkSession, schema: T.StructType = SCHEMA) -> DataFrame:
    """A source that delivered nothing, still typed."""
    return spark.createDataFrame([], schema)


ORDERED_SCHEMA = T.StructType([T.StructField("_ord", T.LongType()), *SCHEMA.fields])


def coerce_schema(
    df: DataFrame, columns: Sequence[tuple[str, str]] = fixed.COLUMNS, keep: Iterable[str] = ()
) -> DataFrame:
    """Project to the canonical columns: missing ones become typed nulls, extras go.

    Text that is no number and NaN become null in numeric columns. ``keep`` names helper columns
    (the row order, for one) to carry along in front.
    """
    present = dict(df.dtypes)

    def one(name: str, kind: str) -> str:
        value = f"`{name}`"
        if name not in present:
            return f"cast(null as {kind}) as {value}"
        if kind != "double":
            return value if present[name] == kind else f"cast({value} as {kind}) as {value}"
        if present[name] == "string":
            return f"case when {value} rlike r'{NUMBER}' then try_cast({value} as double) end as {value}"
        return f"nullif(cast({value} as double), double('NaN')) as {value}"

    return df.selectExpr(*keep, *[one(n, t) for n, t in columns])


def rename_first_alias(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Target columns from the first alias the table has; targets without one are left out."""
    picked = {
        target: next((a for a in names if a in df.columns), None) for target, names in aliases.items()
    }
    return df.select(*[F.col(a).alias(t) for t, a in picked.items() if a is not None])


def pick_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in columns if c in df.columns])


def numbers_from_text(df: DataFrame, columns: Sequence[str] = fixed.DIRECTORY_NUMERIC) -> DataFrame:
    """Listed text columns to double, bad text to null."""
    return df.withColumns({c: to_number(F.col(c)) for c in columns if c in df.columns})


def tag_source(df: DataFrame, source: str, run_date: str) -> DataFrame:
    """Add the source to each row's lineage once and stamp the collection date.

    A source whose name already occurs in the lineage text is not added again.
    """
    lineage = F.coalesce(F.col("data_sources"), F.lit(""))
    tagged = (
        F.when(F.contains(lineage, F.lit(source)), lineage)
        .when(lineage == "", F.lit(source))
        .otherwise(F.concat(lineage, F.lit(";" + source)))
    )
    return df.withColumns({"data_sources": tagged, "data_freshness_date": F.lit(run_date)})
