"""Completeness: weighted score, letter grade, per-group detail, display tier."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rosterline import fixed
from rosterline.functions.blanks import filled_sql
from rosterline.functions.clean import bucket_label, code_label
from rosterline.operators.coerce import coerce_schema


NUMERIC = frozenset(n for n, t in fixed.COLUMNS if t == "double")


def _has(column: str) -> str:
    return filled_sql(column, column in NUMERIC)


def completeness(weights: Mapping[str, float] = fixed.WEIGHTS) -> Column:
    """Share of the total weight whose columns are filled, three decimals."""
    parts = " + ".join(f"if({_has(c)}, {w}D, 0D)" for c, w in weights.items())
    return F.expr(f"round(({parts}) / {sum(weights.values())}D, 3)")


def grade() -> Column:
    """A to F by which kinds of fields are filled, checked from the top."""
    placed = f"({_has('street_address')} or ({_has('city')} and {_has('state')}))"
    identity = f"({_has('org_name')} and {_has('ein')} and {placed})"
    money, code = _has("total_revenue"), _has("ntee_code")
    contact = f"({_has('phone')} or {_has('email')} or {_has('website')})"
    rated = f"({_has('charity_navigator_rating')} or coalesce(va_accredited = 'Yes', false))"
    return F.expr(f"""
        case when not {identity} then 'F'
             when {money} and {contact} and {rated} then 'A'
             when {money} and {code} then 'B'
             when {money} or {code} then 'C'
             else 'D' end""")


def group_detail(
    groups: Sequence[tuple] = fixed.FIELD_GROUPS,
    rules: Sequence[tuple] = fixed.GROUP_SOURCE_RULES,
    lineage: str = "data_sources",
) -> Column:
    """A struct per field group: cells filled, cells in all, likely source."""

    def source(group: str, default: str) -> str:
        arms = " ".join(
            f"when contains(lower({lineage}), '{part}') then '{label}'"
            for name, part, label in rules if name == group
        )
        return f"case {arms} else '{default}' end" if arms else f"'{default}'"

    def one(name: str, fields: Sequence[str], default: str) -> str:
        filled = " + ".join(f"if({_has(f)}, 1, 0)" for f in fields)
        return (
            f"'{name}', named_struct('filled', {filled}, 'total', {len(fields)}, "
            f"'source', {source(name, default)})"
        )

    return F.expr(f"named_struct({', '.join(one(*g) for g in groups)})")


def detail_json() -> Column:
    return F.to_json(F.struct(grade().alias("grade"), group_detail().alias("groups")))


def group_rows(df: DataFrame, keep: Sequence[str] = ("_ord",)) -> DataFrame:
    """One row per record and field group, with fill percent and its band."""
    names = [g[0] for g in fixed.FIELD_GROUPS]
    rows = df.select(*keep, group_detail().alias("g")).select(
        *keep,
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("field_group"), F.col(f"g.{n}.filled"), F.col(f"g.{n}.total"),
                     F.col(f"g.{n}.source"))
            for n in names
        ])).alias("r"),
    ).select(*keep, "r.*")
    return rows.withColumn("percent", fill_percent(F.col("filled"), F.col("total"))).withColumn(
        "band", fill_band(F.col("percent"))
    )


def fill_percent(filled: Column, total: Column) -> Column:
    return F.when(total > 0, F.bround(filled / total * 100, 0)).otherwise(0.0).cast("int")


def fill_band(percent: Column) -> Column:
    return (
        F.when(percent >= 80, "high").when(percent >= 40, "medium").when(percent > 0, "low")
        .otherwise("none")
    )


def display_tier(column: str = "confidence_grade") -> Column:
    """A, B are Enriched, C is Baseline, all else is Partial."""
    return code_label(F.col(column), fixed.GRADE_TIERS, F.lit("Partial"))


def finish(df: DataFrame, updated_at: str, keep: Sequence[str] = ("_ord",)) -> DataFrame:
    """Score, grade, detail, revenue range and time stamp in one projection over the record."""
    records = coerce_schema(df, keep=keep)
    return records.withColumns({
        "confidence_score": completeness(),
        "confidence_grade": grade(),
        "confidence_detail": detail_json(),
        "annual_revenue_range": bucket_label(F.col("total_revenue")),
        "record_last_updated": F.lit(updated_at),
    })


def in_output_order(df: DataFrame) -> DataFrame:
    """By state, then name, nulls last; the row order settles ties."""
    ties = [F.col("_ord")] if "_ord" in df.columns else []
    return df.orderBy(F.col("state").asc_nulls_last(), F.col("org_name").asc_nulls_last(), *ties)
