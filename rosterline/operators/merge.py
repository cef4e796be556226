"""Joins that enrich: blank-filling merges, lookups, update-backs and work queues."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from rosterline.functions.blanks import is_blank, none_if_empty
from rosterline.operators.coerce import SCHEMA, coerce_schema

SALTS = 256


def digits(value: Column) -> Column:
    """A key without hyphens, blanks and all else that is no digit; null when nothing is left."""
    return none_if_empty(F.regexp_replace(value.cast("string"), "[^0-9]", ""))


def first_rows(df: DataFrame, key: str | Sequence[str], order: str = "_ord") -> DataFrame:
    """The first row of each key in ``order``; null is a key of its own.

    ``order`` tells the rows of a key apart. The least order per key is found on those columns alone, in a
    hash aggregate that combines before its shuffle; rows then meet it by key and order together, so
    a hot key is spread by its orders.
    """
    keys = [key] if isinstance(key, str) else list(key)
    first = df.groupBy(*keys).agg(F.min(order).alias("_least")).select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_least")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)], F.col(order) == F.col("_least"))
    return df.join(first, same, "left_semi")


def lineage_union(*lists: Column) -> Column:
    """Sorted set of the ``;``-entries of all lists, without empty ones."""
    parts = [F.split(F.coalesce(x, F.lit("")), ";") for x in lists]
    return F.array_join(F.array_remove(F.sort_array(F.array_distinct(F.concat(*parts))), ""), ";")


def filled_columns(source: DataFrame, columns: Iterable[str]) -> list[str]:
    """Columns with at least one value. One small aggregate, run right away."""
    columns = list(columns)
    if not columns:
        return []
    row = source.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def spread_null_key(key: Column, *row: Column | str) -> Column:
    """A join key that is never null: rows without one get many keys no other side has.

    In an outer join every null key would otherwise land in the same task. ``row`` are columns that
    tell such rows apart.
    """
    spare = F.concat(F.lit("\u0000none "), F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("string"))
    return F.coalesce(key.cast("string"), spare)


def fill_blanks(
    base: DataFrame,
    source: DataFrame,
    key: str = "ein",
    order: str = "_ord",
    columns: Sequence[str] | None = None,
    lineage: str = "union",
    lineage_column: str = "data_sources",
    key_normalizer=None,
    match_null: bool = False,
) -> DataFrame:
    """Left join on a key; blanks of the base take the source's value, values stay.

    The first source row of a key counts. A blank takes what the source has even when that is
    null, so an empty text in a taking column ends as null or as the source's text. The row count
    is the base's. ``columns`` says which columns take part (default: the shared ones);
    ``filled_columns`` finds those the source fills at all. ``lineage`` is "union" for the sorted
    set of both lists or "first_nonblank" to treat it as any column. ``key_normalizer`` maps both
    keys to one form before the join. Rows without a key match nothing, or with ``match_null`` the
    first source row without one.
    """
    if match_null:
        as_key = key_normalizer or (lambda c: c)
        key_normalizer = lambda c: F.coalesce(as_key(c).cast("string"), F.lit("\u0000null"))
    keyed = with_key(base, key, order, key_normalizer)
    return _fill(keyed, source, key, order, columns, lineage, lineage_column, key_normalizer).drop("_k")


def with_key(base: DataFrame, key: str, order: str = "_ord", key_normalizer=None) -> DataFrame:
    """The base with its join key ``_k``, which several joins can share."""
    as_key = key_normalizer or (lambda c: c)
    return base.withColumn("_k", spread_null_key(as_key(F.col(key)), F.col(order)))


def _fill(left: DataFrame, source: DataFrame, key, order, columns, lineage, lineage_column, key_normalizer) -> DataFrame:
    """``fill_blanks`` for a base that has its ``_k`` and keeps it."""
    as_key = key_normalizer or (lambda c: c)
    if columns is None:
        columns = source.columns
    columns = [c for c in columns if c in left.columns and c in source.columns and c not in (key, order)]
    right = (
        source.select(as_key(F.col(key)).cast("string").alias("_k"), order, *columns)
        .filter(F.col("_k").isNotNull())
    )
    # These rows meet the base by the same key, so one exchange serves both; an aggregate thins them out before it.
    first = F.min_by(F.struct(*columns), order).alias("_first")
    right = right.groupBy("_k").agg(first).select("_k", *[F.col(f"_first.{c}").alias(f"_src_{c}") for c in columns])
    joined = left.join(right, "_k", "left")

    def merged(name: str) -> Column:
        if name not in columns:
            return F.col(name)
        mine, theirs = F.col(name), F.col(f"_src_{name}")
        if name == lineage_column and lineage == "union":
            return F.when(theirs.isNull(), mine).otherwise(lineage_union(mine, theirs)).alias(name)
        return F.when(is_blank(mine), theirs).otherwise(mine).alias(name)

    return joined.select(*[merged(c) for c in left.columns])


def append_rows(base: DataFrame, *sources: DataFrame, keep: Iterable[str] = ("_ord",)) -> DataFrame:
    """Stack sources without a key under the base, all in the canonical schema."""
    result = coerce_schema(base, keep=keep)
    for source in sources:
        result = result.unionByName(coerce_schema(source, keep=keep))
    return result


def merge_sources(
    base: DataFrame,
    keyed: Mapping[str, DataFrame],
    unkeyed: Mapping[str, DataFrame] | None = None,
    key: str = "ein",
    prune: bool = True,
    lineage: str = "union",
    lineage_column: str = "data_sources",
    key_normalizer=None,
) -> DataFrame:
    """Fill from keyed sources in their order (earlier wins), then stack the others.

    The join key is made once and carried through, so the base is shuffled once for all sources.
    ``prune`` drops source columns without any value, at the price of one small aggregate per source.
    """
    result = with_key(coerce_schema(base, keep=("_ord",)), key, "_ord", key_normalizer)
    names = [f.name for f in SCHEMA.fields if f.name != key]
    for source in keyed.values():
        source = coerce_schema(source, keep=("_ord",))
        columns = filled_columns(source, names) if prune else names
        if columns:
            result = _fill(result, source, key, "_ord", columns, lineage, lineage_column, key_normalizer)
    return append_rows(result.drop("_k"), *(unkeyed or {}).values())


def clean_key(value: Column) -> Column:
    """Key text without hyphens and outer blanks."""
    return F.trim(F.replace(value, F.lit("-"), F.lit("")))


def keep_known_keys(source: DataFrame, base: DataFrame, source_key: str, base_key: str) -> DataFrame:
    """Source rows whose cleaned key is a key of the base; the key goes out as it came in."""
    known = base.select(clean_key(F.col(base_key)).alias("_k"))
    return source.withColumn("_k", clean_key(F.col(source_key))).join(known, "_k", "left_semi").drop("_k")


def add_coordinates(df: DataFrame, gazetteer: DataFrame, column: str = "zip_code") -> DataFrame:
    """Latitude and longitude by five-digit ZIP prefix; unknown prefixes give null.

    The gazetteer has ``zip5, latitude, longitude``; Spark broadcasts it when its measured size
    allows. Rows without a ZIP are spread over many tasks.
    """
    places = gazetteer.dropna().select(
        F.col("zip5").alias("_k"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng")
    )
    keyed = df.withColumn("_k", spread_null_key(F.substring(F.col(column), 1, 5), F.col("_ord")))
    return keyed.join(places, "_k", "left").drop("_k")


def _beside(full: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The table with the other one's values as ``_new_`` columns.

    Where the other table has a key more than once, one of its rows counts, the same on every run.
    """
    new = other.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    if columns:
        new = new.groupBy("_k").agg(F.min(F.struct(*[f"_new_{c}" for c in columns])).alias("_new")).select("_k", "_new.*")
    else:
        new = new.distinct()
    return full.withColumn("_k", spread_null_key(F.col(key), *full.columns)).join(new, "_k", "left")


def update_back(full: DataFrame, enriched: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Values of the enriched subset overwrite the full table; its nulls do not."""
    joined = _beside(full, enriched, key, columns)
    return joined.select(*[
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
        for c in full.columns
    ])


def fill_back(
    full: DataFrame, found: DataFrame, key: str, columns: Sequence[str], empty_is_missing: bool = True
) -> DataFrame:
    """Found values go only where there is none; empty finds are no finds.

    ``empty_is_missing`` says whether an empty text in the table counts as missing. The column
    ``fields_updated`` tells how many cells of the row changed.
    """
    joined = _beside(full, found, key, columns)

    def taken(c: str) -> Column:
        missing = is_blank(F.col(c)) if empty_is_missing else F.col(c).isNull()
        return missing & ~is_blank(F.col(f"_new_{c}"))

    changed = sum((taken(c).cast("int") for c in columns), F.lit(0))
    return joined.select(
        *[
            F.when(taken(c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in full.columns
        ],
        changed.alias("fields_updated"),
    )


def remaining(
    work: DataFrame, done: DataFrame, key: str, limit: int | None = None, order: str = "_ord"
) -> DataFrame:
    """Work whose key is not done yet; rows without a key are never done. ``limit`` takes the first N."""
    left = work.join(done.select(key).filter(F.col(key).isNotNull()), key, "left_anti")
    left = left.select(*work.columns)
    return left if limit is None else left.orderBy(order).limit(limit)
