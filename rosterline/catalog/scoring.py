"""Queries for completeness scores, grades, group detail and lineage tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterline import fixed
from rosterline.catalog.frame import directory, filled_sql, organizations, over_directory, over_orgs, tier_sql
from rosterline.catalog.registry import query, table
from rosterline.operators.coerce import tag_source
from rosterline.operators.score import completeness, display_tier, group_rows, in_output_order


@query("completeness", over_directory("SELECT _ord, confidence_score FROM dir"))
def scored(spark, sf_dir):
    return organizations(spark, sf_dir).select("_ord", completeness().alias("confidence_score"))


@query("completeness_custom", """
SELECT d.doc_id, round((0.5 * CAST(trim(lang) <> '' AS INT) + 0.3 * CAST(quality IS NOT NULL AS INT)
                        + 0.2 * CAST(toxic IS NOT NULL AS INT)) / 1.0, 3) AS score
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def custom(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return df.select("doc_id", completeness({"lang": 0.5, "quality": 0.3, "toxic": 0.2}).alias("score"))


@query("grades", over_directory(f"SELECT _ord, confidence_grade, {tier_sql()} AS tier FROM dir"))
def grades(spark, sf_dir):
    return directory(spark, sf_dir).select("_ord", "confidence_grade", display_tier().alias("tier"))


def _filled_count(fields) -> str:
    return " + ".join(f"CAST({filled_sql(f)} AS INT)" for f in fields)


def _source_sql(group: str, default: str) -> str:
    arms = "".join(
        f" WHEN contains(lower(data_sources), '{part}') THEN '{label}'"
        for name, part, label in fixed.GROUP_SOURCE_RULES if name == group
    )
    return f"CASE{arms} ELSE '{default}' END" if arms else f"'{default}'"


_GROUPS = " UNION ALL ".join(
    f"SELECT _ord, '{name}' AS field_group, {_filled_count(fields)} AS filled, {len(fields)} AS total, "
    f"{_source_sql(name, default)} AS source FROM orgs"
    for name, fields, default in fixed.FIELD_GROUPS
)


@query("group_detail", over_orgs(f"""
SELECT *, CAST(round_even(filled / total * 100, 0) AS INT) AS percent,
       CASE WHEN round_even(filled / total * 100, 0) >= 80 THEN 'high'
            WHEN round_even(filled / total * 100, 0) >= 40 THEN 'medium'
            WHEN filled > 0 THEN 'low' ELSE 'none' END AS band FROM ({_GROUPS})"""))
def group_detail(spark, sf_dir):
    return group_rows(organizations(spark, sf_dir))


_DETAIL = " || ',' || ".join(
    f"""'"{name}":{{"filled":' || ({_filled_count(fields)}) || ',"total":{len(fields)},"source":"' || {
        _source_sql(name, default)} || '"}}'"""
    for name, fields, default in fixed.FIELD_GROUPS
)


@query("detail_json", over_directory(f"""
SELECT _ord, '{{"grade":"' || confidence_grade || '","groups":{{' || {_DETAIL} || '}}}}' AS confidence_detail FROM dir"""))
def detail(spark, sf_dir):
    return directory(spark, sf_dir).select("_ord", "confidence_detail")


@query("finish_directory", over_directory("""
SELECT _ord, state, org_name, confidence_score, confidence_grade, annual_revenue_range, record_last_updated FROM dir"""))
def finished(spark, sf_dir):
    return in_output_order(directory(spark, sf_dir)).select(
        "_ord", "state", "org_name", "confidence_score", "confidence_grade", "annual_revenue_range",
        "record_last_updated",
    )


@query("tag_source", over_orgs("""
SELECT _ord, CASE WHEN contains(tags, 'propublica') THEN tags WHEN tags = '' THEN 'propublica'
                  ELSE tags || ';propublica' END AS data_sources, '2024-01-01' AS data_freshness_date
FROM (SELECT _ord, CASE WHEN ein IS NULL THEN '' ELSE data_sources END AS tags FROM orgs)"""))
def tagged(spark, sf_dir):
    orgs = organizations(spark, sf_dir).select(
        "_ord", F.when(F.col("ein").isNotNull(), F.col("data_sources")).alias("data_sources")
    )
    return tag_source(orgs, "propublica", "2024-01-01")
