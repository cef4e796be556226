"""Queries for the analytical views and the two reports."""

from __future__ import annotations


from rosterline import fixed
from rosterline.catalog.frame import directory, located, over_directory, over_located, tier_sql
from rosterline.catalog.cleaning import labels_sql
from rosterline.catalog.registry import query
from rosterline.catalog.selection import any_sql
from rosterline.catalog.summaries import _STATE_SUMMARY, cents
from rosterline.plans import views

PEER = " OR ".join(any_sql(c, fixed.PEER_KEYWORDS) for c in views.PEER_TEXT)
FUNDER = f"""total_revenue >= 1e6 AND (coalesce(charity_navigator_rating >= 3, false) OR {
    any_sql('org_name', fixed.FUNDER_KEYWORDS)})"""
BOARD = """coalesce(key_personnel, '') <> '' AND (coalesce(charity_navigator_rating >= 3, false)
  OR coalesce(total_revenue >= 500000, false))"""
SOCIAL = "coalesce(facebook_url, twitter_url, linkedin_url, instagram_url) IS NOT NULL"
PLATFORMS = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in views.SOCIAL_COLUMNS[3:8])
POPULATION = f"""pop AS (SELECT col0 AS state, col1 * 1000 AS population FROM (VALUES {
    ', '.join(f"('{k}', CAST({v} AS BIGINT))" for k, v in fixed.POPULATION_THOUSANDS.items())})),
gap AS (SELECT state, coalesce(n, 0) AS org_count, population,
               round_even(coalesce(n, 0) / population * 100000, 1) AS per_100k
        FROM pop LEFT JOIN (SELECT state AS s, count(*) AS n FROM dir WHERE state IS NOT NULL GROUP BY 1) ON s = state)"""
KEYS = "_ord, org_name, state, city, total_revenue, confidence_score"


@query("local_partners", over_directory(f"SELECT {KEYS} FROM dir WHERE state = 'KY'"))
def local_partners(spark, sf_dir):
    return views.local_partners(directory(spark, sf_dir), "KY").select(*KEYS.split(", "))


@query("potential_funders", over_directory(f"SELECT {KEYS} FROM dir WHERE {FUNDER}"))
def potential_funders(spark, sf_dir):
    return views.potential_funders(directory(spark, sf_dir)).select(*KEYS.split(", "))


@query("potential_funders_by_revenue", over_directory(f"SELECT {KEYS} FROM dir WHERE total_revenue >= 1e6"))
def potential_funders_by_revenue(spark, sf_dir):
    return views.potential_funders(directory(spark, sf_dir), rated=False).select(*KEYS.split(", "))


@query("peer_network", over_directory(f"SELECT {KEYS} FROM dir WHERE {PEER}"))
def peer_network(spark, sf_dir):
    return views.peer_network(directory(spark, sf_dir)).select(*KEYS.split(", "))


@query("gap_analysis", over_directory("SELECT * FROM gap", POPULATION))
def gap_analysis(spark, sf_dir):
    return views.gap_analysis(directory(spark, sf_dir))


@query("gap_extremes", over_directory("""
(SELECT *, 'least' AS side FROM gap ORDER BY per_100k, state LIMIT 15)
UNION ALL (SELECT *, 'best' FROM gap ORDER BY per_100k DESC, state DESC LIMIT 10)""", POPULATION))
def gap_extremes(spark, sf_dir):
    return views.gap_extremes(views.gap_analysis(directory(spark, sf_dir)))


@query("board_prospects", over_directory(f"SELECT {', '.join(views.BOARD_COLUMNS)} FROM dir WHERE {BOARD}"))
def board_prospects(spark, sf_dir):
    return views.board_prospects(directory(spark, sf_dir))


@query("social_partners", over_directory(f"""
SELECT {', '.join(c for c in views.SOCIAL_COLUMNS if c != 'social_platform_count')}, {PLATFORMS} AS social_platform_count
FROM dir WHERE {SOCIAL}"""))
def social_partners(spark, sf_dir):
    return views.social_partners(directory(spark, sf_dir))


_EXPLORE = ", ".join(views.EXPLORE_COLUMNS)


@query("explore_table", over_directory(f"SELECT {_EXPLORE} FROM dir"))
def explore_table(spark, sf_dir):
    return views.explore_table(directory(spark, sf_dir))


@query("funder_table", over_directory(f"""
SELECT {', '.join(views.FUNDER_COLUMNS)} FROM dir WHERE total_revenue >= 1e6 ORDER BY total_revenue DESC, _ord LIMIT 100"""))
def funder_table(spark, sf_dir):
    return views.funder_table(directory(spark, sf_dir))


@query("peer_table", over_directory(f"""
SELECT {', '.join(views.PEER_COLUMNS)} FROM dir WHERE {PEER} ORDER BY total_revenue DESC NULLS LAST, _ord LIMIT 100"""))
def peer_table(spark, sf_dir):
    return views.peer_table(directory(spark, sf_dir))


@query("funder_totals", over_directory("""
SELECT count(*) AS funders, round(coalesce(sum(total_revenue), 0), 2) AS revenue, round(avg(total_revenue), 2) AS avg_revenue
FROM dir WHERE total_revenue >= 1e6"""))
def funder_totals(spark, sf_dir):
    return cents(views.funder_totals(directory(spark, sf_dir)))


@query("peer_totals", over_directory(f"""
SELECT count(*) AS peers, count(DISTINCT state) AS states, round(coalesce(sum(total_revenue), 0), 2) AS revenue
FROM dir WHERE {PEER}"""))
def peer_totals(spark, sf_dir):
    return cents(views.peer_totals(directory(spark, sf_dir)))


_TIERS = ", ".join(f"('{t}', {i + 1})" for i, t in enumerate(fixed.TIER_ORDER))


@query("tier_distribution", over_directory(f"""
SELECT tier, position, count(g) AS count FROM (VALUES {_TIERS}) AS t(tier, position)
LEFT JOIN (SELECT {tier_sql()} AS g FROM dir) ON g = tier GROUP BY ALL"""))
def tier_distribution(spark, sf_dir):
    return views.tier_distribution(directory(spark, sf_dir))


@query("state_table", over_directory(f"""
SELECT *, {labels_sql('state', fixed.REGION_NAMES)} AS state_name FROM ({_STATE_SUMMARY})"""))
def state_table(spark, sf_dir):
    return cents(views.state_table(directory(spark, sf_dir)))


@query("state_headline", over_directory(f"""
SELECT count(*) AS organizations, round(coalesce(sum(total_revenue), 0), 2) AS total_revenue,
       count(*) FILTER (va_accredited = 'Yes') AS va_accredited, count(*) FILTER ({tier_sql()} = 'Enriched') AS enriched
FROM dir WHERE state = 'CA'"""))
def state_headline(spark, sf_dir):
    return cents(views.state_headline(directory(spark, sf_dir), "CA"))


@query("state_points_capped", over_located("""
SELECT _ord, org_name, lat, lng FROM (SELECT * FROM loc WHERE state = 'KY' ORDER BY _ord LIMIT 5)
WHERE lat IS NOT NULL AND lng IS NOT NULL"""))
def state_points_capped(spark, sf_dir):
    return views.state_points(located(spark, sf_dir), "KY", cap=5).select("_ord", "org_name", "lat", "lng")


@query("state_points", over_located("""
SELECT _ord, org_name, lat, lng FROM loc WHERE state = 'KY' AND lat IS NOT NULL AND lng IS NOT NULL"""))
def state_points(spark, sf_dir):
    return views.state_points(located(spark, sf_dir), "KY").select("_ord", "org_name", "lat", "lng")


def _fact_rows(section: str, facts: dict[str, str]) -> str:
    rows = ", ".join(f"{{'metric': '{k}', 'value': CAST({v} AS DOUBLE)}}" for k, v in facts.items())
    return (
        f"SELECT '{section}' AS section, f.metric AS metric, 0 AS rank, CAST(NULL AS VARCHAR) AS label, f.value AS value "
        f"FROM (SELECT unnest([{rows}]) AS f FROM dir)"
    )


def _top(section: str, metric: str, label: str, value: str, source: str, order: str, n: int) -> str:
    return (
        f"SELECT '{section}', '{metric}', CAST(row_number() OVER (ORDER BY {order}) AS INT), {label}, CAST({value} AS DOUBLE) "
        f"FROM {source} QUALIFY row_number() OVER (ORDER BY {order}) <= {n}"
    )


def _counts(section: str, column: str, where: str = "true") -> str:
    return f"(SELECT {column} AS label, count(*) AS n FROM dir WHERE {column} IS NOT NULL AND ({where}) GROUP BY 1)"


_present = lambda c: f"count({c})"
_DIRECTORY_FACTS = {
    "organizations": "count(*)", "distinct_keys": "count(DISTINCT ein)", "with_key": _present("ein"),
    "without_key": "count(*) FILTER (ein IS NULL)", "states": "count(DISTINCT state)",
    "with_phone": _present("phone"), "with_email": _present("email"), "with_website": _present("website"),
    "with_mission": _present("mission_statement"), "with_financials": _present("total_revenue"),
    "with_rating": _present("charity_navigator_rating"), "accredited": "count(*) FILTER (va_accredited = 'Yes')",
    "mean_score": "round(avg(confidence_score), 3)", "median_score": "median(confidence_score)",
    "high_score": "count(*) FILTER (confidence_score > 0.7)",
    "medium_score": "count(*) FILTER (confidence_score BETWEEN 0.4 AND 0.7)",
    "low_score": "count(*) FILTER (confidence_score < 0.4)",
}
_GRADES = ", ".join(f"('{g}', '{g} ({label})')" for g, label in fixed.GRADE_LABELS.items())


@query("directory_report", over_directory(f"""
{_fact_rows('directory', _DIRECTORY_FACTS)}
UNION ALL SELECT 'grades', 'rows', 0, label, CAST(count(confidence_grade) AS DOUBLE)
          FROM (VALUES {_GRADES}) AS g(grade, label) LEFT JOIN dir ON confidence_grade = grade GROUP BY label
UNION ALL ({_top('states', 'rows', 'label', 'n', _counts('states', 'state'), 'n DESC, label', 15)})
UNION ALL ({_top('types', 'rows', 'label', 'n', _counts('types', 'org_type'), 'n DESC, label', 10)})
UNION ALL SELECT 'revenue_ranges', 'rows', 0, label, n FROM {_counts('', 'annual_revenue_range')}
UNION ALL SELECT 'sources', 'rows', 0, token, count(*) FROM (SELECT unnest(string_split(data_sources, ';')) AS token FROM dir)
          GROUP BY token"""))
def directory_report(spark, sf_dir):
    return views.directory_report(directory(spark, sf_dir))


_LOCAL = "state = 'KY'"
_VIEW_FACTS = {
    "organizations": "count(*)", "local": f"count(*) FILTER ({_LOCAL})",
    **{f"local_with_{c}": f"count({c}) FILTER ({_LOCAL})" for c in ("phone", "email", "website")},
    "funders": f"count(*) FILTER ({FUNDER})",
    "funder_revenue": f"round(coalesce(sum(total_revenue) FILTER ({FUNDER}), 0), 2)",
    "peers": f"count(*) FILTER ({PEER})", "board_prospects": f"count(*) FILTER ({BOARD})",
    "social_partners": f"count(*) FILTER ({SOCIAL})",
    "on_three_platforms": f"count(*) FILTER ({SOCIAL} AND {PLATFORMS} >= 3)",
}


@query("strategy_report", over_directory(f"""
{_fact_rows('views', _VIEW_FACTS)}
UNION ALL ({_top('local', 'top', 'org_name', 'confidence_score', f'(SELECT * FROM dir WHERE {_LOCAL})', 'confidence_score DESC NULLS LAST, _ord', 5)})
UNION ALL ({_top('funders', 'top', 'org_name', 'total_revenue', f'(SELECT * FROM dir WHERE {FUNDER})', 'total_revenue DESC NULLS LAST, _ord', 10)})
UNION ALL ({_top('peers', 'states', 'label', 'n', _counts('', 'state', PEER), 'n DESC, label', 5)})
UNION ALL ({_top('peers', 'top', 'org_name', 'confidence_score', f'(SELECT * FROM dir WHERE {PEER})', 'confidence_score DESC NULLS LAST, _ord', 5)})
UNION ALL ({_top('gap', 'least_served', 'state', 'per_100k', 'gap', 'per_100k, state', 10)})""", POPULATION))
def strategy_report(spark, sf_dir):
    return views.strategy_report(directory(spark, sf_dir), "KY")
