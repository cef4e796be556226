"""Queries for counts, distributions, coverage and ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterline import fixed
from rosterline.catalog.cleaning import labels_sql
from rosterline.catalog.frame import directory, located, organizations, over_directory, over_located, over_orgs
from rosterline.catalog.registry import query, table
from rosterline.operators import aggregate as agg

MONEY = ("total_revenue", "avg_revenue", "revenue")


def cents(df):
    """Money columns to two decimals, so that the order of summation does not show."""
    return df.withColumns({c: F.round(F.col(c), 2) for c in df.columns if c in MONEY})


_STATE_SUMMARY = """
SELECT state, count(org_name) AS org_count, round(coalesce(sum(total_revenue), 0), 2) AS total_revenue,
       round(avg(total_revenue), 2) AS avg_revenue, count(*) FILTER (va_accredited = 'Yes') AS va_accredited,
       count(total_revenue) AS with_financials FROM dir WHERE state IS NOT NULL GROUP BY state"""


@query("state_summary", over_directory(_STATE_SUMMARY))
def state_summary(spark, sf_dir):
    return cents(agg.state_summary(directory(spark, sf_dir)))


@query("state_names", over_directory(f"""
SELECT *, {labels_sql('state', fixed.REGION_NAMES)} AS state_name FROM ({_STATE_SUMMARY})"""))
def state_names(spark, sf_dir):
    return agg.with_state_name(cents(agg.state_summary(directory(spark, sf_dir))))


@query("overview", over_directory("""
SELECT count(*) AS organizations, round(sum(total_revenue), 2) AS total_revenue,
       count(*) FILTER (va_accredited = 'Yes') AS va_accredited, count(total_revenue) AS with_financials,
       count(*) FILTER (org_type = '501(c)(19)') AS type_19, count(*) FILTER (org_type = '501(c)(3)') AS type_3,
       round(avg(confidence_score), 6) AS avg_score FROM dir"""))
def overview(spark, sf_dir):
    return cents(agg.overview(directory(spark, sf_dir))).withColumn("avg_score", F.round("avg_score", 6))


@query("region_classes", over_orgs("SELECT " + ", ".join(
    f"count(DISTINCT CASE WHEN state IN ({', '.join(repr(c) for c in codes)}) THEN state END) AS {name}"
    for name, codes in (("states", fixed.STATES), ("territories", fixed.TERRITORIES), ("military", fixed.MILITARY_MAIL))
) + " FROM orgs"))
def region_classes(spark, sf_dir):
    return agg.region_classes(organizations(spark, sf_dir))


@query("value_counts", "SELECT p_name, count(*) AS count FROM part WHERE p_name IS NOT NULL GROUP BY p_name")
def value_counts(spark, sf_dir):
    return agg.value_counts(table(spark, sf_dir, "part"), "p_name")


@query("value_counts_top", """
SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, l_partkey LIMIT 15""")
def value_counts_top(spark, sf_dir):
    return agg.value_counts(table(spark, sf_dir, "lineitem"), "l_partkey", 15)


_ORDER = [label for _, _, label in fixed.REVENUE_BUCKETS]


@query("ordered_distribution", over_directory(f"""
SELECT annual_revenue_range, count(*) AS count,
       list_position([{', '.join(f"'{x}'" for x in _ORDER)}], annual_revenue_range) AS position
FROM dir WHERE annual_revenue_range IS NOT NULL GROUP BY 1"""))
def ordered_distribution(spark, sf_dir):
    return agg.ordered_distribution(directory(spark, sf_dir), "annual_revenue_range", _ORDER)


@query("score_bands", over_directory("""
SELECT round(avg(confidence_score), 6) AS mean, median(confidence_score) AS median,
       count(*) FILTER (confidence_score > 0.7) AS high,
       count(*) FILTER (confidence_score BETWEEN 0.4 AND 0.7) AS medium,
       count(*) FILTER (confidence_score < 0.4) AS low FROM dir"""))
def score_bands(spark, sf_dir):
    return agg.score_bands(directory(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("token_counts", over_orgs("""
SELECT token, count(*) AS count FROM (SELECT trim(unnest(string_split(data_sources || '; ' || service_categories, ';'))) AS token
FROM orgs) WHERE token <> '' GROUP BY token"""))
def token_counts(spark, sf_dir):
    both = F.concat("data_sources", F.lit("; "), "service_categories")
    return agg.token_counts(organizations(spark, sf_dir).select(both.alias("tags")), "tags")


@query("distinct_tokens", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part")
def distinct_tokens(spark, sf_dir):
    return agg.distinct_tokens(table(spark, sf_dir, "part"), "p_name", " ")


_COVERED = ("ein", "phone", "email", "website", "mission_statement", "total_revenue", "facebook_url", "board_members")


@query("coverage", over_orgs(" UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS filled, count(*) AS total, round_even(count({c}) / count(*) * 100, 1) AS percent FROM orgs"
    for c in _COVERED)))
def coverage(spark, sf_dir):
    return agg.coverage(organizations(spark, sf_dir), _COVERED)


@query("per_capita", """
SELECT n_nationkey AS nation, coalesce(c, 0) AS org_count, coalesce(p, 0) AS population,
       CASE WHEN coalesce(p, 0) > 0 THEN round_even(coalesce(c, 0) / p * 100000, 1) ELSE 0 END AS per_100k
FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey, count(*) AS p FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def per_capita(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").groupBy(
        F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("population"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    people = nations.join(rich, "nation", "left").fillna(0, ["population"])
    return agg.per_capita(table(spark, sf_dir, "supplier"), people, "s_nationkey", "nation")


_BOUNDS = ", ".join(f"('{k}', {a}, {b}, {c}, {d})" for k, (a, b, c, d) in fixed.REGION_BOUNDS.items())


@query("bounding_boxes", over_located(f"""
SELECT *, (lat_min + lat_max) / 2 AS center_lat, (lng_min + lng_max) / 2 AS center_lng,
       greatest(lat_max - lat_min, lng_max - lng_min) AS span
FROM (SELECT g.state, points, CASE WHEN swap THEN y1 ELSE a END AS lat_min, CASE WHEN swap THEN y2 ELSE b END AS lat_max,
             CASE WHEN swap THEN x1 ELSE c END AS lng_min, CASE WHEN swap THEN x2 ELSE d END AS lng_max
      FROM (SELECT q.*, y1, y2, x1, x2, (b - a < 20 OR d - c < 20) AND y1 IS NOT NULL AS swap
            FROM (SELECT state, min(lat) AS a, max(lat) AS b, min(lng) AS c, max(lng) AS d, count(*) AS points
                  FROM loc WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY state) q
            LEFT JOIN (SELECT col0 AS s, CAST(col1 AS DOUBLE) AS y1, CAST(col2 AS DOUBLE) AS y2, CAST(col3 AS DOUBLE) AS x1,
                              CAST(col4 AS DOUBLE) AS x2 FROM (VALUES {_BOUNDS})) ON s = state) g)"""))
def bounding_boxes(spark, sf_dir):
    """The box counts as thin below 20 here, since the coordinates are made of amounts."""
    return agg.bounding_boxes(located(spark, sf_dir), agg.bounds_table(spark), min_span=20.0)


@query("top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return agg.top_rows(orders, "o_totalprice", 100, order="o_orderkey")


@query("sort_rows", over_orgs("SELECT _ord, org_name, total_revenue FROM orgs"))
def sort_rows(spark, sf_dir):
    return agg.sort_rows(organizations(spark, sf_dir).select("_ord", "org_name", "total_revenue"), "total_revenue")


_MEDIANS = (("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("orders", "o_totalprice"), ("customer", "c_acctbal"))


@query("exact_medians", " UNION ALL ".join(f"SELECT '{c}' AS field, median({c}) AS median FROM {t}" for t, c in _MEDIANS))
def exact_medians(spark, sf_dir):
    """Columns of many values, of few values, and of few rows."""
    found = [(c, agg.exact_median(table(spark, sf_dir, t), c)) for t, c in _MEDIANS]
    return agg.small_table(spark, found, "field string, median double")


@query("distinct_keys", """
SELECT 'l_partkey' AS field, count(DISTINCT l_partkey) AS n FROM lineitem
UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem""")
def distinct_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    one, *others = [
        agg.distinct_count(rows, c, "n").select(F.lit(c).alias("field"), "n") for c in ("l_partkey", "l_suppkey", "l_shipdate")]
    for other in others:
        one = one.unionByName(other)
    return one
