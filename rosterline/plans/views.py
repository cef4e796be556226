"""The analytical views of a finished directory. Each takes the directory and returns a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterline import fixed
from rosterline.functions.blanks import is_blank, is_true
from rosterline.functions.keywords import any_column_matches, any_of, matches_any
from rosterline.operators import aggregate as agg
from rosterline.operators.coerce import pick_columns
from rosterline.operators.filters import in_state
from rosterline.operators.score import display_tier
from rosterline.session import cut_lineage

BOARD_COLUMNS = (
    "org_name", "state", "key_personnel", "charity_navigator_rating", "total_revenue", "website",
    "phone", "email",
)
SOCIAL_COLUMNS = (
    "org_name", "state", "website", "facebook_url", "twitter_url", "linkedin_url", "instagram_url",
    "youtube_url", "social_platform_count", "total_revenue",
)
EXPLORE_COLUMNS = (
    "ein", "org_name", "state", "city", "org_type", "total_revenue", "va_accredited", "ntee_code",
    "phone", "website", "confidence_grade", "confidence_score",
)
FUNDER_COLUMNS = (
    "org_name", "state", "city", "total_revenue", "total_assets", "org_type", "ntee_code", "website",
    "phone",
)
PEER_COLUMNS = (
    "org_name", "state", "city", "total_revenue", "org_type", "mission_statement", "services_offered",
    "website",
)
PEER_TEXT = ("mission_statement", "services_offered", "org_name", "service_categories")


def at_least(column: str, value: float) -> Column:
    return is_true(F.col(column) >= value)


def is_local(state: str) -> Column:
    return is_true(F.col("state") == state)


def is_funder(rated: bool = True, min_revenue: float = 1_000_000, min_rating: float = 3) -> Column:
    """Revenue alone, or (``rated``) revenue with a good rating or a funder's name."""
    rich = at_least("total_revenue", min_revenue)
    if not rated:
        return rich
    named = matches_any(F.col("org_name"), fixed.FUNDER_KEYWORDS)
    return rich & (at_least("charity_navigator_rating", min_rating) | named)


def is_peer(words: Sequence[str] = fixed.PEER_KEYWORDS, columns: Sequence[str] = PEER_TEXT) -> Column:
    return any_column_matches([F.col(c) for c in columns], words)


def is_board_prospect(min_rating: float = 3, min_revenue: float = 500_000) -> Column:
    well_run = at_least("charity_navigator_rating", min_rating) | at_least("total_revenue", min_revenue)
    return ~is_blank(F.col("key_personnel")) & well_run


def is_social() -> Column:
    """One of four platforms; the fifth, video, only counts towards the number."""
    return any_of([F.col(c).isNotNull() for c in SOCIAL_COLUMNS[3:7]])


def platform_count() -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in SOCIAL_COLUMNS[3:8]), F.lit(0))


def _sorted(df: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    return df.orderBy(*agg.sort_keys(column, ascending))


def local_partners(df: DataFrame, state: str) -> DataFrame:
    return _sorted(df.filter(is_local(state)), "confidence_score")


def potential_funders(df: DataFrame, rated: bool = True) -> DataFrame:
    return _sorted(df.filter(is_funder(rated)), "total_revenue")


def peer_network(df: DataFrame, sort: str = "confidence_score") -> DataFrame:
    return _sorted(df.filter(is_peer()), sort)


def gap_analysis(df: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Population rows by their number of organisations per 100,000, least served first."""
    table = agg.population_table(df.sparkSession) if population is None else population
    return agg.per_capita(df, table).orderBy("per_100k", "state")


def gap_extremes(gap: DataFrame, least: int = 15, best: int = 10) -> DataFrame:
    """The least served, upwards, then the best served, downwards."""
    low = gap.orderBy("per_100k", "state").limit(least).withColumn("side", F.lit("least"))
    high = gap.orderBy(F.desc("per_100k"), F.desc("state")).limit(best).withColumn("side", F.lit("best"))
    return low.unionByName(high)


def board_prospects(df: DataFrame) -> DataFrame:
    return _sorted(df.filter(is_board_prospect()), "total_revenue").select(*BOARD_COLUMNS)


def social_partners(df: DataFrame) -> DataFrame:
    counted = df.filter(is_social()).withColumn("social_platform_count", platform_count())
    return pick_columns(_sorted(counted, "social_platform_count"), SOCIAL_COLUMNS)


def explore_table(df: DataFrame, sort: str = "org_name") -> DataFrame:
    return agg.sort_rows(df, sort).select(*EXPLORE_COLUMNS)


def funder_table(df: DataFrame, n: int = 100) -> DataFrame:
    """The top funders by revenue, with the columns of the funder list."""
    return agg.top_rows(df.filter(is_funder(rated=False)), "total_revenue", n).select(*FUNDER_COLUMNS)


def peer_table(df: DataFrame, n: int = 100) -> DataFrame:
    return agg.top_rows(df.filter(is_peer()), "total_revenue", n).select(*PEER_COLUMNS)


def funder_totals(df: DataFrame) -> DataFrame:
    return df.filter(is_funder(rated=False)).agg(
        F.count(F.lit(1)).alias("funders"), agg.total_or_zero(F.col("total_revenue")).alias("revenue"),
        F.avg("total_revenue").alias("avg_revenue"),
    )


def peer_totals(df: DataFrame) -> DataFrame:
    return df.filter(is_peer()).agg(
        F.count(F.lit(1)).alias("peers"), F.count_distinct("state").alias("states"),
        agg.total_or_zero(F.col("total_revenue")).alias("revenue"),
    )


def tier_distribution(df: DataFrame, column: str = "confidence_grade") -> DataFrame:
    """All display tiers in order with their rows, 0 for none; ``column`` holds letter grades."""
    tiers = agg.small_table(
        df.sparkSession, [(t, i + 1) for i, t in enumerate(fixed.TIER_ORDER)], "tier string, position int"
    )
    return agg.zero_filled_counts(df.withColumn("tier", display_tier(column)), "tier", tiers, "tier")


def state_table(df: DataFrame) -> DataFrame:
    """State summary with names, most organisations first."""
    return agg.with_state_name(agg.state_summary(df)).orderBy(F.desc("org_count"), "state")


def state_headline(df: DataFrame, state: str) -> DataFrame:
    """Headline numbers of one state; ``confidence_grade`` holds letter grades."""
    return df.filter(is_local(state)).agg(
        F.count(F.lit(1)).alias("organizations"),
        agg.total_or_zero(F.col("total_revenue")).alias("total_revenue"),
        agg.count_yes(F.col("va_accredited")).alias("va_accredited"),
        F.count_if(display_tier() == "Enriched").alias("enriched"),
    )


def state_points(df: DataFrame, state: str, cap: int | None = None) -> DataFrame:
    """The rows of a state that have coordinates, of all its rows or of the first ``cap``."""
    rows = df.filter(is_local(state))
    if cap is not None:
        rows = rows.orderBy("_ord").limit(cap)
    return rows.dropna(subset=["lat", "lng"])


# --- reports: long tables (section, metric, rank, label, value) ------------------------------

def _facts(df: DataFrame, section: str, facts: dict[str, Column]) -> DataFrame:
    """Named aggregates of one scan as report rows."""
    one = df.agg(*[c.cast("double").alias(n) for n, c in facts.items()])
    return one.unpivot([], list(facts), "metric", "value").select(
        F.lit(section).alias("section"), "metric", F.lit(0).alias("rank"),
        F.lit(None).cast("string").alias("label"), "value",
    )


def _rows(df: DataFrame, section: str, metric: str, rank: Column, label: str | None, value: str) -> DataFrame:
    name = F.lit(None) if label is None else F.col(label)
    return df.select(
        F.lit(section).alias("section"), F.lit(metric).alias("metric"), rank.alias("rank"),
        name.cast("string").alias("label"), F.col(value).cast("double").alias("value"),
    )


def _ranked(
    df: DataFrame, section: str, metric: str, label: str, value: str, n: int, keys: Sequence[Column]
) -> DataFrame:
    """A top list as report rows; only the N rows that are left after the limit get numbered."""
    place = F.row_number().over(Window.orderBy(*keys))
    return _rows(df.orderBy(*keys).limit(n), section, metric, place, label, value)


def _counted(df: DataFrame, section: str, metric: str, column: str, top: int | None = None) -> DataFrame:
    """Value counts as report rows, numbered when only the top ones are asked for."""
    counts = agg.value_counts(df, column)
    if top is None:
        return _rows(counts, section, metric, F.lit(0), column, "count")
    return _ranked(counts, section, metric, column, "count", top, [F.desc("count"), F.asc(column)])


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def directory_report(df: DataFrame) -> DataFrame:
    """Totals, coverage, score bands, grades, top states and types, ranges, sources.

    The parts share one written table of the columns they need.
    """
    present = lambda c: F.count_if(c)
    flags = ("phone", "email", "website", "mission_statement", "total_revenue", "charity_navigator_rating")
    df = cut_lineage(df.select(
        "ein", "state", "org_type", "annual_revenue_range", "data_sources", "confidence_score",
        "confidence_grade", "va_accredited", *[F.col(c).isNotNull().alias(c) for c in flags],
    ))
    score = F.round(F.col("confidence_score"), 3)
    facts = _facts(df, "directory", {
        "organizations": F.count(F.lit(1)), "with_key": F.count("ein"), "without_key": F.count_if(F.col("ein").isNull()),
        "with_phone": present("phone"),
        "with_email": present("email"), "with_website": present("website"),
        "with_mission": present("mission_statement"), "with_financials": present("total_revenue"),
        "with_rating": present("charity_navigator_rating"),
        "accredited": agg.count_yes(F.col("va_accredited")),
        "mean_score": F.bround(F.avg("confidence_score"), 3), "median_score": F.median(score),
        "high_score": F.count_if(score > 0.7), "medium_score": F.count_if(score.between(0.4, 0.7)),
        "low_score": F.count_if(score < 0.4),
    })
    distinct = [
        _rows(agg.distinct_count(df, c, "n"), "directory", metric, F.lit(0), None, "n")
        for metric, c in (("distinct_keys", "ein"), ("states", "state"))]
    grades = agg.small_table(
        df.sparkSession, [(f"{g} ({label})", g) for g, label in fixed.GRADE_LABELS.items()],
        "label string, grade string",
    )
    sources = agg.token_counts(df, "data_sources")
    return _stack([
        facts,
        *distinct,
        _rows(agg.zero_filled_counts(df, "confidence_grade", grades, "grade"), "grades", "rows",
              F.lit(0), "label", "count"),
        _counted(df, "states", "rows", "state", 15),
        _counted(df, "types", "rows", "org_type", 10),
        _counted(df, "revenue_ranges", "rows", "annual_revenue_range"),
        _rows(sources, "sources", "rows", F.lit(0), "token", "count"),
    ])


def strategy_report(df: DataFrame, state: str, population: DataFrame | None = None) -> DataFrame:
    """The numbers and short lists of all six views, from the directory.

    The parts share one written table, so the long texts are searched once.
    """
    known = [F.col(c).isNotNull().alias(c) for c in ("phone", "email", "website")]
    df = cut_lineage(df.select(
        "_ord", "org_name", "state", "total_revenue", "confidence_score", *known,
        is_local(state).alias("local"), is_funder().alias("funder"), is_peer().alias("peer"),
        is_board_prospect().alias("board"), is_social().alias("social"),
        platform_count().alias("platforms"),
    ))
    local, funder, peer, social = (F.col(c) for c in ("local", "funder", "peer", "social"))
    here = lambda c: F.count_if(local & F.col(c))
    facts = _facts(df, "views", {
        "organizations": F.count(F.lit(1)), "local": F.count_if(local), "local_with_phone": here("phone"),
        "local_with_email": here("email"), "local_with_website": here("website"),
        "funders": F.count_if(funder),
        "funder_revenue": F.bround(agg.total_or_zero(F.when(funder, F.col("total_revenue"))), 2),
        "peers": F.count_if(peer), "board_prospects": F.count_if("board"),
        "social_partners": F.count_if(social),
        "on_three_platforms": F.count_if(social & (F.col("platforms") >= 3)),
    })
    by_score = agg.sort_keys("confidence_score", False)
    return _stack([
        facts,
        _ranked(df.filter(local), "local", "top", "org_name", "confidence_score", 5, by_score),
        _ranked(df.filter(funder), "funders", "top", "org_name", "total_revenue", 10,
                agg.sort_keys("total_revenue", False)),
        _counted(df.filter(peer), "peers", "states", "state", 5),
        _ranked(df.filter(peer), "peers", "top", "org_name", "confidence_score", 5, by_score),
        _ranked(gap_analysis(df, population), "gap", "least_served", "state", "per_100k", 10,
                [F.asc("per_100k"), F.asc("state")]),
    ])


def report_lines(report: DataFrame) -> DataFrame:
    """Report rows as lines of text in reading order."""
    order = ("section", "metric", "rank", F.desc("value"), "label")
    text = F.concat_ws(
        "  ", "section", "metric", F.when(F.col("rank") > 0, F.col("rank").cast("string")), "label",
        F.format_string("%.3f", "value"),
    )
    return report.orderBy(*order).select(text.alias("line"))
