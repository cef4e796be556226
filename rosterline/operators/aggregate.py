"""Counts, distributions, coverage, ratios. All combine before their shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rosterline import fixed
from rosterline.functions.blanks import none_if_empty
from rosterline.functions.clean import code_label, split_list


SALTS = 256


def total_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def count_yes(value: Column) -> Column:
    return F.count_if(value == "Yes")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per non-null value, most frequent first, the value settles ties."""
    counts = (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    )
    if top is None:
        return counts
    return counts.orderBy(F.desc("count"), F.asc(column)).limit(top)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A dimension given in code, unfolded from one literal, so Spark knows that it is small."""
    types = T.StructType.fromDDL(schema)
    listed = F.array(*[
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, types)]) for row in rows])
    return spark.range(1).select(F.inline(listed))


def ordered_distribution(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Counts of the listed values that occur, with their place in the list."""
    place = F.array_position(F.lit(list(order)), F.col(column))
    return (
        value_counts(df.filter(F.col(column).isin(*order)), column)
        .withColumn("position", place.cast("int"))
        .orderBy("position")
    )


def zero_filled_counts(df: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """Every row of the dimension with the number of table rows that have its key, 0 for none."""
    counts = value_counts(df, column).withColumnRenamed(column, key)
    return dimension.join(counts, key, "left").fillna(0, ["count"])


def state_summary(df: DataFrame, by: str = "state") -> DataFrame:
    """Names, revenue, accredited and reporting rows per state; rows without state do not count."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("org_name").alias("org_count"),
        total_or_zero(F.col("total_revenue")).alias("total_revenue"),
        F.avg("total_revenue").alias("avg_revenue"),
        count_yes(F.col("va_accredited")).alias("va_accredited"),
        F.count("total_revenue").alias("with_financials"),
    )


def with_state_name(df: DataFrame, by: str = "state") -> DataFrame:
    return df.withColumn("state_name", code_label(F.col(by), fixed.REGION_NAMES))


def overview(df: DataFrame) -> DataFrame:
    """The headline numbers of a filtered directory, one row."""
    return df.agg(
        F.count(F.lit(1)).alias("organizations"),
        total_or_zero(F.col("total_revenue")).alias("total_revenue"),
        count_yes(F.col("va_accredited")).alias("va_accredited"),
        F.count("total_revenue").alias("with_financials"),
        F.count_if(F.col("org_type") == "501(c)(19)").alias("type_19"),
        F.count_if(F.col("org_type") == "501(c)(3)").alias("type_3"),
        F.avg("confidence_score").alias("avg_score"),
    )


def region_classes(df: DataFrame, column: str = "state") -> DataFrame:
    """Distinct states, territories and military mail codes."""
    code = F.col("code")
    return df.select(F.col(column).alias("code")).distinct().agg(
        F.count_if(code.isin(*fixed.STATES)).alias("states"),
        F.count_if(code.isin(*fixed.TERRITORIES)).alias("territories"),
        F.count_if(code.isin(*fixed.MILITARY_MAIL)).alias("military"),
    )


def score_bands(df: DataFrame, score: str = "confidence_score") -> DataFrame:
    """Mean, exact median and bands of a score between 0 and 1 with three decimals.

    Such a score has at most 1,001 values, which bounds what the exact median keeps.
    """
    value = F.round(F.col(score), 3)
    return df.agg(
        F.avg(score).alias("mean"), F.median(value).alias("median"),
        F.count_if(value > 0.7).alias("high"),
        F.count_if(value.between(0.4, 0.7)).alias("medium"),
        F.count_if(value < 0.4).alias("low"),
    )


def distinct_count(df: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct non-null values, one row: values combine in each task, then across tasks.

    Several such counts in one aggregate would send every row on once per column.
    """
    return df.groupBy(column).agg(F.lit(1).alias("_one")).agg(F.count(column).alias(out))


def exact_median(df: DataFrame, column: str, few: int = 10_000, accuracy: int = 10_000) -> float | None:
    """The exact median of a numeric column without nulls and NaN, of any number of values; null for none.

    Each pass brackets the wanted ranks by a quantile sketch of bounded size, counts the rows below, at
    and between the brackets, and goes on with those between, about one in a thousand. At most ``few``
    values reach the driver. Values tied with a bracket are settled by their count.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    value, n = F.col("v"), rows.count()
    # Ranks within ``rows``, and what was found for ranks of the whole column.
    open_ = {r: r for r in {(n - 1) // 2, n // 2}} if n else {}
    found: dict[int, float] = {}
    while open_:
        if n <= few:
            values = [r["v"] for r in rows.sort("v").collect()]
            found |= {r: values[k] for r, k in open_.items()}
            break
        slack = 4 / accuracy
        shares = [max(0.0, min(open_.values()) / n - slack), min(1.0, (max(open_.values()) + 1) / n + slack)]
        low, high = rows.agg(F.percentile_approx("v", shares, accuracy).alias("b")).first()["b"]
        counts = rows.agg(
            F.count_if(value < low), F.count_if(value == low), F.count_if((value > low) & (value < high)),
            F.count_if((value == high) & (value > low))).first()
        ends = [sum(counts[:k + 1]) for k in range(4)]
        parts = [value < low, None, (value > low) & (value < high), None, value > high]
        places: dict[int, dict[int, int]] = {}
        for r, k in open_.items():
            part = sum(k >= e for e in ends)
            if part in (1, 3):
                found[r] = low if part == 1 else high
            else:
                places.setdefault(part, {})[r] = k - (ends[part - 1] if part else 0)
        if not places:
            break
        if len(places) > 1:
            raise ArithmeticError("a quantile sketch missed its bound")
        (part, open_), = places.items()
        n = (n - ends[3]) if part == 4 else counts[part]
        rows = rows.filter(parts[part])
    return sum(found.values()) / len(found) if found else None


def token_counts(df: DataFrame, column: str, delimiter: str = ";") -> DataFrame:
    """Entries of a list column with their number of occurrences."""
    entries = df.select(F.explode(split_list(F.col(column), delimiter)).alias("token"))
    return entries.groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def distinct_tokens(df: DataFrame, column: str, delimiter: str = ";") -> DataFrame:
    return token_counts(df, column, delimiter).select("token").orderBy("token")


def group_people(
    df: DataFrame, by: str, name: str, title: str, order: str = "_ord", out: str = "key_personnel"
) -> DataFrame:
    """The named people of each group as one JSON list in row order.

    One cell holds a whole group by definition, so this is for groups that fit a cell.
    """
    person = F.struct(F.col(order).alias("o"), F.col(name).alias("name"))
    named = none_if_empty(F.col(name)).isNotNull()
    listed = F.sort_array(F.collect_list(F.when(named, person)))
    people = F.transform(listed, lambda p: F.struct(p["name"].alias("name"), F.lit(title).alias("title")))
    return df.groupBy(by).agg(F.to_json(people).alias(out))


def attach(df: DataFrame, grouped: DataFrame, by: str) -> DataFrame:
    """A group's result on each of its rows; rows without a key have no group and are spread."""
    rest = [c for c in grouped.columns if c != by]
    known = grouped.filter(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("_group"), *rest)
    spare = F.concat(F.lit("\u0000none "), F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("string"))
    rows = df.withColumn("_group", F.coalesce(F.col(by).cast("string"), spare))
    return rows.join(known, "_group", "left").select(*df.columns, *rest)


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null cells and their percentage per column, from one scan."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in columns])
    rows = counts.unpivot(["total"], list(columns), "field", "filled")
    percent = F.when(F.col("total") > 0, F.bround(F.col("filled") / F.col("total") * 100, 1))
    return rows.select("field", "filled", "total", percent.alias("percent"))


def per_capita(
    df: DataFrame, dimension: DataFrame, column: str = "state", key: str = "state",
    population: str = "population", out: str = "per_100k",
) -> DataFrame:
    """Rows per 100,000 inhabitants for every row of the population table."""
    counted = zero_filled_counts(df, column, dimension, key).withColumnRenamed("count", "org_count")
    size = F.col(population)
    ratio = F.when(size > 0, F.col("org_count") / size * 100_000).otherwise(0.0)
    return counted.withColumn(out, F.bround(ratio, 1))


def population_table(
    spark: SparkSession, thousands: Mapping[str, int] = fixed.POPULATION_THOUSANDS
) -> DataFrame:
    return small_table(spark, [(k, v * 1000) for k, v in thousands.items()], "state string, population long")


def bounds_table(spark: SparkSession, bounds: Mapping[str, tuple] = fixed.REGION_BOUNDS) -> DataFrame:
    return small_table(
        spark, [(k, *v) for k, v in bounds.items()],
        "state string, f_lat_min double, f_lat_max double, f_lng_min double, f_lng_max double",
    )


def bounding_boxes(
    df: DataFrame, fallback: DataFrame, by: str = "state", lat: str = "lat", lng: str = "lng",
    min_span: float = 0.5,
) -> DataFrame:
    """Box, centre and larger span of each group's points.

    A box thinner than ``min_span`` on either axis gives way to the fallback table's box, if it has
    one (columns ``by, f_lat_min, f_lat_max, f_lng_min, f_lng_max``).
    """
    points = df.dropna(subset=[lat, lng])
    boxes = points.groupBy(by).agg(
        F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"),
        F.min(lng).alias("lng_min"), F.max(lng).alias("lng_max"), F.count(F.lit(1)).alias("points"),
    )
    thin = (F.col("lat_max") - F.col("lat_min") < min_span) | (F.col("lng_max") - F.col("lng_min") < min_span)
    joined = boxes.join(fallback, by, "left").withColumn("_swap", thin & F.col("f_lat_min").isNotNull())
    side = lambda c: F.when(F.col("_swap"), F.col(f"f_{c}")).otherwise(F.col(c)).alias(c)
    chosen = joined.select(by, "points", *[side(c) for c in ("lat_min", "lat_max", "lng_min", "lng_max")])
    return chosen.withColumns({
        "center_lat": (F.col("lat_min") + F.col("lat_max")) / 2,
        "center_lng": (F.col("lng_min") + F.col("lng_max")) / 2,
        "span": F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lng_max") - F.col("lng_min")),
    })


def top_rows(df: DataFrame, sort: str, n: int, ascending: bool = False, order: str = "_ord") -> DataFrame:
    """The first N rows by a column, nulls last, the row order settles ties."""
    return df.orderBy(*sort_keys(sort, ascending, order)).limit(n)


def sort_keys(sort: str, ascending: bool, order: str = "_ord") -> list[Column]:
    key = F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_last()
    return [key, F.col(order).asc()]


def sort_rows(df: DataFrame, column: str = "org_name", order: str = "_ord") -> DataFrame:
    """Sort as the directory table does: names upwards, all else downwards, nulls last."""
    return df.orderBy(*sort_keys(column, column == "org_name", order))
