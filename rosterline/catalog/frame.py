"""The supplied tables seen as organisations: one record per customer, with the usual gaps.

``organizations`` is the raw record, ``directory`` the finished one. ``ORGS`` and ``DIRECTORY`` are
the same in SQL, as common table expressions ``orgs`` and ``dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterline import fixed
from rosterline.catalog.registry import table
from rosterline.operators.coerce import coerce_schema
from rosterline.operators.score import finish

UPDATED_AT = "2024-01-01T00:00:00"
# One region per nation; the last nation has none, and three are no states.
NATION_STATES = (
    "KY", "CA", "TX", "FL", "PA", "NY", "OH", "VA", "NC", "GA", "IL", "MI", "AZ", "WA", "TN", "MO",
    "IN", "SC", "AL", "MA", "PR", "GU", "AE", "DC", None,
)


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and exact revenue per customer."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(price).cast("double").alias("revenue")
    )


def raw_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    key = lambda df, name, *cols: df.select(c(name).alias("c_custkey"), *cols)
    joined = (
        t("customer")
        .join(order_totals(spark, sf_dir), "c_custkey", "left")
        .join(key(t("part"), "p_partkey", "p_name", "p_type", "p_brand", "p_size"), "c_custkey", "left")
        .join(key(t("documents"), "doc_id", "text"), "c_custkey", "left")
        .join(key(t("labels"), "doc_id", "quality", "toxic"), "c_custkey", "left")
        .join(key(t("pages"), "page_id", "url"), "c_custkey", "left")
    )
    states = ", ".join("null" if s is None else f"'{s}'" for s in NATION_STATES)
    return joined.selectExpr(
        "c_custkey as _ord",
        "concat(p_name, ' ', lower(c_mktsegment)) as org_name",
        "case when c_acctbal >= 0 then lpad(c_custkey, 9, '0') when c_acctbal > -500 then '' end as ein",
        "case quality when 1 then '501(c)(3)' when 0 then '501(c)(19)' end as org_type",
        "case when p_size > 10 then concat(p_size, ' ', p_type, ' street') when p_size > 5 then '  ' end "
        "as street_address",
        "c_mktsegment as city",
        f"get(array({states}), c_nationkey) as state",
        "lpad(c_custkey * 7, 5, '0') as zip_code",
        "case when n_orders >= 12 then string(5020000000 + c_custkey) when n_orders >= 9 then '' end as phone",
        "case when toxic = 0 then concat('Contact', c_custkey, '@Mail.org') end as email",
        "url as website",
        "concat(substring(p_type, 1, 1), p_size) as ntee_code",
        "lpad(p_size, 2, '0') as irs_subsection",
        "text as mission_statement",
        "lower(p_type) as services_offered",
        "concat(lower(p_type), ';', p_brand) as service_categories",
        "revenue as total_revenue",
        "c_acctbal as total_assets",
        "double(n_orders) as num_employees",
        """case when p_size > 25 then concat('[{"name":"', c_name, '","title":"Chair","compensation":', p_size, '}]')
                when p_size > 20 then '' end as key_personnel""",
        "double(quality * 4) as charity_navigator_rating",
        "case toxic when 1 then 'Yes' when 0 then 'No' end as va_accredited",
        "if(c_mktsegment = 'BUILDING', concat('https://facebook.com/', c_custkey), null) as facebook_url",
        "if(p_type = 'PROMO', concat('https://x.com/', c_custkey), null) as twitter_url",
        "if(p_type = 'LARGE', 'https://linkedin.com/in/one', null) as linkedin_url",
        "if(c_mktsegment in ('BUILDING', 'FURNITURE'), 'https://instagram.com/one', null) as instagram_url",
        "if(p_size < 10, 'https://youtube.com/cone', null) as youtube_url",
        "concat('irs_bmf', if(n_orders is not null, ';propublica', ''), "
        "if(quality is not null, ';charity_nav', '')) as data_sources",
    )


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce_schema(raw_organizations(spark, sf_dir), keep=("_ord",))


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(raw_organizations(spark, sf_dir), UPDATED_AT)


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory with coordinates out of two amounts, some of them missing."""
    df = directory(spark, sf_dir)
    return df.withColumns({
        "lat": F.when(F.col("total_assets") > 0, F.col("total_assets") / 100),
        "lng": F.when(F.col("total_revenue").isNotNull(), F.col("num_employees") * -2.0),
    })


# --- the same in SQL ---------------------------------------------------------------------------

_STATE_LIST = ", ".join("NULL" if s is None else f"'{s}'" for s in NATION_STATES)
_PRESENT = {
    "org_name", "ein", "org_type", "street_address", "city", "state", "zip_code", "phone", "email",
    "website", "ntee_code", "irs_subsection", "mission_statement", "services_offered",
    "service_categories", "total_revenue", "total_assets", "num_employees", "key_personnel",
    "charity_navigator_rating", "va_accredited", "facebook_url", "twitter_url", "linkedin_url",
    "instagram_url", "youtube_url", "data_sources",
}
_MISSING = ",\n  ".join(
    f"CAST(NULL AS {'DOUBLE' if t == 'double' else 'VARCHAR'}) AS {n}"
    for n, t in fixed.COLUMNS if n not in _PRESENT
)

ORGS = f"""
totals AS (
  SELECT o_custkey, count(*) AS n_orders,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
  FROM orders GROUP BY o_custkey),
orgs AS (
  SELECT c_custkey AS _ord,
  p_name || ' ' || lower(c_mktsegment) AS org_name,
  CASE WHEN c_acctbal >= 0 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0')
       WHEN c_acctbal > -500 THEN '' END AS ein,
  CASE WHEN quality = 1 THEN '501(c)(3)' WHEN quality = 0 THEN '501(c)(19)' END AS org_type,
  CASE WHEN p_size > 10 THEN p_size || ' ' || p_type || ' street' WHEN p_size > 5 THEN '  ' END
    AS street_address,
  c_mktsegment AS city,
  ([{_STATE_LIST}])[c_nationkey + 1] AS state,
  lpad(CAST(c_custkey * 7 AS VARCHAR), 5, '0') AS zip_code,
  CASE WHEN n_orders >= 12 THEN CAST(5020000000 + c_custkey AS VARCHAR) WHEN n_orders >= 9 THEN '' END
    AS phone,
  CASE WHEN toxic = 0 THEN 'Contact' || c_custkey || '@Mail.org' END AS email,
  url AS website,
  substr(p_type, 1, 1) || p_size AS ntee_code,
  lpad(CAST(p_size AS VARCHAR), 2, '0') AS irs_subsection,
  text AS mission_statement,
  lower(p_type) AS services_offered,
  lower(p_type) || ';' || p_brand AS service_categories,
  revenue AS total_revenue, c_acctbal AS total_assets, CAST(n_orders AS DOUBLE) AS num_employees,
  CASE WHEN p_size > 25 THEN '[{{"name":"' || c_name || '","title":"Chair","compensation":' || p_size || '}}]'
       WHEN p_size > 20 THEN '' END AS key_personnel,
  CAST(quality * 4 AS DOUBLE) AS charity_navigator_rating,
  CASE WHEN toxic = 1 THEN 'Yes' WHEN toxic = 0 THEN 'No' END AS va_accredited,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'https://facebook.com/' || c_custkey END AS facebook_url,
  CASE WHEN p_type = 'PROMO' THEN 'https://x.com/' || c_custkey END AS twitter_url,
  CASE WHEN p_type = 'LARGE' THEN 'https://linkedin.com/in/one' END AS linkedin_url,
  CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'https://instagram.com/one' END
    AS instagram_url,
  CASE WHEN p_size < 10 THEN 'https://youtube.com/cone' END AS youtube_url,
  'irs_bmf' || CASE WHEN n_orders IS NOT NULL THEN ';propublica' ELSE '' END
            || CASE WHEN quality IS NOT NULL THEN ';charity_nav' ELSE '' END AS data_sources,
  {_MISSING}
  FROM customer
  LEFT JOIN totals ON o_custkey = c_custkey
  LEFT JOIN part ON p_partkey = c_custkey
  LEFT JOIN documents d ON d.doc_id = c_custkey
  LEFT JOIN labels l ON l.doc_id = c_custkey
  LEFT JOIN pages ON page_id = c_custkey)"""


def filled_sql(column: str) -> str:
    return f"coalesce(trim(CAST({column} AS VARCHAR)) <> '', false)"


def score_sql() -> str:
    hundredths = " + ".join(
        f"CASE WHEN {filled_sql(c)} THEN {round(w * 100)} ELSE 0 END" for c, w in fixed.WEIGHTS.items()
    )
    return f"round(({hundredths}) / 100.0, 3)"


def grade_sql() -> str:
    has = filled_sql
    identity = (
        f"({has('org_name')} AND {has('ein')} AND ({has('street_address')} OR "
        f"({has('city')} AND {has('state')})))"
    )
    contact = f"({has('phone')} OR {has('email')} OR {has('website')})"
    rated = f"({has('charity_navigator_rating')} OR coalesce(va_accredited = 'Yes', false))"
    money, code = has("total_revenue"), has("ntee_code")
    return (
        f"CASE WHEN {identity} AND {money} AND {contact} AND {rated} THEN 'A' "
        f"WHEN {identity} AND {money} AND {code} THEN 'B' "
        f"WHEN {identity} AND ({money} OR {code}) THEN 'C' WHEN {identity} THEN 'D' ELSE 'F' END"
    )


def bucket_sql(column: str) -> str:
    arms = " ".join(
        f"WHEN {column} >= {low}{'' if high is None else f' AND {column} <= {high}'} THEN '{label}'"
        for low, high, label in fixed.REVENUE_BUCKETS
    )
    return f"CASE {arms} END"


def tier_sql(column: str = "confidence_grade") -> str:
    return (
        f"CASE WHEN {column} IN ('A', 'B') THEN 'Enriched' WHEN {column} = 'C' THEN 'Baseline' "
        "ELSE 'Partial' END"
    )


DIRECTORY = f"""{ORGS},
dir AS (
  SELECT * REPLACE (CAST({score_sql()} AS DOUBLE) AS confidence_score, {grade_sql()} AS confidence_grade,
                    {bucket_sql('total_revenue')} AS annual_revenue_range,
                    '{UPDATED_AT}' AS record_last_updated)
  FROM orgs)"""
LOCATED = f"""{DIRECTORY},
loc AS (
  SELECT *, CASE WHEN total_assets > 0 THEN total_assets / 100 END AS lat,
         CASE WHEN total_revenue IS NOT NULL THEN num_employees * -2.0 END AS lng
  FROM dir)"""


def over_orgs(select: str, more: str = "") -> str:
    """A select over ``orgs``; ``more`` holds further common table expressions."""
    return f"WITH {ORGS}{', ' + more if more else ''}\n{select}"


def over_directory(select: str, more: str = "") -> str:
    return f"WITH {DIRECTORY}{', ' + more if more else ''}\n{select}"


def over_located(select: str) -> str:
    return f"WITH {LOCATED}\n{select}"
