"""Queries for classification and directory filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterline import fixed
from rosterline.catalog.frame import directory, filled_sql, organizations, over_directory, over_orgs, tier_sql
from rosterline.catalog.registry import query, table
from rosterline.functions.keywords import any_column_matches, matches_any
from rosterline.operators import filters
from rosterline.operators.classify import ClassifyRule, classify, classify_counts
from rosterline.operators.coerce import pick_columns, rename_first_alias
from rosterline.operators.score import display_tier

# The documents are invented prose, so the word lists are invented too.
TEXT_RULE = ClassifyRule(
    name="text", code="source", subsection="lang", code_prefix="src1", subsection_value="de",
    include=("tion the", "contact", "éaux", "contact us"), exclude=("license", "erthes on"),
)


def any_sql(column: str, words) -> str:
    tests = " OR ".join("contains(lower({}), '{}')".format(column, w.replace("'", "''")) for w in words)
    return f"coalesce({tests}, false)"


_HITS = f"""hits AS (
  SELECT doc_id, coalesce(starts_with(source, 'src1'), false) AS code, coalesce(trim(lang) = 'de', false) AS sub,
         {any_sql('text', TEXT_RULE.include)} AS kw, {any_sql('text', TEXT_RULE.exclude)} AS gone FROM documents)"""


@query("classify_keywords", f"WITH {_HITS} SELECT doc_id FROM hits WHERE (code OR sub OR kw) AND NOT gone")
def classify_keywords(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), TEXT_RULE).select("doc_id")


@query("classify_counts", f"""WITH {_HITS}
SELECT count(*) FILTER (code) AS by_code, count(*) FILTER (sub) AS by_subsection, count(*) FILTER (kw) AS by_keyword,
       count(*) FILTER ((code OR sub OR kw) AND gone) AS excluded,
       count(*) FILTER ((code OR sub OR kw) AND NOT gone) AS kept FROM hits""")
def counted(spark, sf_dir):
    return classify_counts(table(spark, sf_dir, "documents"), TEXT_RULE)


@query("classify_default_lists", f"""
SELECT doc_id, {any_sql('text', fixed.INCLUDE_KEYWORDS)} AS included, {any_sql('text', fixed.EXCLUDE_KEYWORDS)} AS excluded,
       {any_sql('text', fixed.PEER_KEYWORDS)} AS peer FROM documents""")
def default_lists(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", matches_any(text, fixed.INCLUDE_KEYWORDS).alias("included"),
        matches_any(text, fixed.EXCLUDE_KEYWORDS).alias("excluded"),
        matches_any(text, fixed.PEER_KEYWORDS).alias("peer"),
    )


@query("keyword_whole_words", r"""
SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\b(contact|on the|die)\b')""")
def whole_words(spark, sf_dir):
    words = ("contact", "on the", "die")
    return table(spark, sf_dir, "documents").filter(
        matches_any(F.col("text"), words, word_boundary=True)
    ).select("doc_id")


@query("keyword_columns", over_orgs(f"""
SELECT _ord FROM orgs WHERE {any_sql('org_name', ['ring', 'gear fur'])} OR {any_sql('mission_statement', ['erthes', 'éaux'])
} OR {any_sql('service_categories', ['brand#12'])} OR {any_sql('org_name', ['erthes', 'éaux', 'brand#12'])
} OR {any_sql('mission_statement', ['ring', 'brand#12', 'gear fur'])
} OR {any_sql('service_categories', ['ring', 'erthes', 'éaux', 'gear fur'])}"""))
def keyword_columns(spark, sf_dir):
    words = ("ring", "gear fur", "erthes", "éaux", "brand#12")
    columns = [F.col(c) for c in ("org_name", "mission_statement", "service_categories")]
    return organizations(spark, sf_dir).filter(any_column_matches(columns, words)).select("_ord")


@query("state_share", over_orgs("""
SELECT count(*) FILTER (upper(state) = 'KY') AS matched, count(*) AS total,
       round_even(count(*) FILTER (upper(state) = 'KY') / greatest(count(*), 1) * 100, 1) AS percent FROM orgs"""))
def state_share(spark, sf_dir):
    return filters.state_share(organizations(spark, sf_dir), "ky")


@query("search_columns", over_orgs("""
SELECT _ord FROM orgs WHERE contains(lower(org_name), 'old g') OR contains(lower(city), 'old g')
   OR contains(lower(mission_statement), 'old g') OR contains(lower(services_offered), 'old g')
   OR contains(lower(service_categories), 'old g')"""))
def search_columns(spark, sf_dir):
    return organizations(spark, sf_dir).filter(filters.search("Old G")).select("_ord")


@query("search_pattern", over_orgs("""
SELECT _ord FROM orgs WHERE regexp_matches(org_name, '(?i)^(old|new) .*ure$') OR regexp_matches(city, '(?i)^(old|new) .*ure$')
"""))
def search_pattern(spark, sf_dir):
    found = filters.search("^(old|new) .*ure$", ("org_name", "city"), regex=True)
    return organizations(spark, sf_dir).filter(found).select("_ord")


def _spec(name: str, spec: filters.FilterSpec, where: str) -> None:
    """One query per filter, over the finished directory with display tiers."""

    @query(name, over_directory(f"SELECT _ord, ein, org_name FROM dir WHERE {where}"))
    def run(spark, sf_dir):
        df = directory(spark, sf_dir).withColumn("confidence_grade", display_tier())
        return spec.apply(df).select("_ord", "ein", "org_name")


Spec = filters.FilterSpec
_spec("filter_tier_state_type",
      Spec(tiers=("Enriched", "Baseline"), states=("KY", "CA", "PR"), org_types=("501(c)(3)",)),
      f"{tier_sql()} IN ('Enriched', 'Baseline') AND state IN ('KY', 'CA', 'PR') AND org_type = '501(c)(3)'")
_spec("filter_city_zip_code", Spec(city="build", zip_prefix="00", code_prefix="e1"),
      "contains(lower(city), 'build') AND starts_with(zip_code, '00') AND starts_with(ntee_code, 'E1')")
_spec("filter_categories", Spec(categories=("promo", "Brand#7")),
      "contains(lower(service_categories), 'promo') OR contains(lower(service_categories), 'brand#7')")
_spec("filter_revenue_range", Spec(revenue="$1M–$10M"), "total_revenue BETWEEN 1e6 AND 1e7")
_spec("filter_employee_range", Spec(employees="11–50"), "num_employees BETWEEN 11 AND 50")
_spec("filter_flag_yes", Spec(accredited=True), "va_accredited = 'Yes'")
_spec("filter_flag_no", Spec(accredited=False), "va_accredited IS NULL OR va_accredited <> 'Yes'")
_spec("filter_has_contact", Spec(has_contact=True),
      " OR ".join(filled_sql(c) for c in ("phone", "email", "website")))
_spec("filter_min_score", Spec(min_score=0.65), "confidence_score >= 0.65")
_spec("filter_all", Spec(text="bolt", tiers=("Enriched",), states=("KY", "TX", "FL", "OH", "NY"), city="ur",
                         zip_prefix="0", categories=("a",), revenue=(500_000, None), employees="1–10",
                         accredited=False, code_prefix="", has_contact=True, min_score=0.3),
      f"""contains(lower(org_name || ' ' || city || ' ' || services_offered || ' ' || service_categories || ' '
      || coalesce(mission_statement, '')), 'bolt') AND {tier_sql()} = 'Enriched'
      AND state IN ('KY', 'TX', 'FL', 'OH', 'NY') AND contains(lower(city), 'ur') AND starts_with(zip_code, '0')
      AND contains(lower(service_categories), 'a') AND total_revenue >= 500000 AND num_employees BETWEEN 1 AND 10
      AND coalesce(va_accredited, '') <> 'Yes' AND ({filled_sql('phone')} OR {filled_sql('email')}
      OR {filled_sql('website')}) AND confidence_score >= 0.3""")


@query("needs_enrichment", over_orgs("""
SELECT _ord, website FROM orgs
WHERE website IS NOT NULL AND (email IS NULL OR facebook_url IS NULL OR twitter_url IS NULL)"""))
def needs_enrichment(spark, sf_dir):
    return organizations(spark, sf_dir).filter(filters.needs_enrichment()).select("_ord", "website")


@query("point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1")
def point_lookup(spark, sf_dir):
    found = filters.lookup(table(spark, sf_dir, "orders"), "o_orderstatus", "F", order="o_orderkey")
    return found.select("o_orderkey", "o_totalprice")


@query("name_matches", over_orgs("""
SELECT _ord, org_name FROM orgs WHERE contains(lower(org_name), 'gear') ORDER BY _ord LIMIT 20"""))
def name_matches(spark, sf_dir):
    return filters.name_matches(organizations(spark, sf_dir), "GEAR").select("_ord", "org_name")


@query("column_subset", "SELECT s_suppkey, s_name FROM supplier")
def column_subset(spark, sf_dir):
    return pick_columns(table(spark, sf_dir, "supplier"), ("s_suppkey", "s_missing", "s_name"))


@query("first_alias", "SELECT p_name AS org_name, p_retailprice AS total_revenue, p_partkey AS ein FROM part")
def first_alias(spark, sf_dir):
    return rename_first_alias(table(spark, sf_dir, "part"), {
        "org_name": ("p_title", "p_name", "p_type"), "total_revenue": ("p_retailprice", "p_size"),
        "ein": ("p_key", "p_partkey"), "website": ("p_url",),
    })
