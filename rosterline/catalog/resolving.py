"""Queries for entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterline.catalog.frame import organizations, over_orgs
from rosterline.catalog.registry import query, table
from rosterline.operators import resolve
from rosterline.operators.similarity import similarity


@query("merge_exact_documents", """
SELECT text, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars,
       CASE WHEN count(*) = 1 THEN min(source) ELSE array_to_string(list_sort(list(DISTINCT source)), ';') END AS source
FROM documents WHERE text <> '' GROUP BY text
UNION ALL SELECT text, doc_id, lang, n_chars, source FROM documents WHERE text IS NULL OR text = ''""")
def exact_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text", "doc_id", "lang", "n_chars", "source")
    return resolve.merge_exact(docs, "text", order="doc_id", lineage="source")


def firsts(columns, order: str) -> str:
    return ", ".join(f"arg_min({c}, {order}) FILTER ({c} IS NOT NULL) AS {c}" for c in columns)


def lineage_sql(column: str = "data_sources") -> str:
    return (
        f"CASE WHEN count(*) = 1 THEN min({column}) ELSE array_to_string(list_sort(list_filter(list_distinct(flatten("
        f"list(string_split({column}, ';')) FILTER ({column} IS NOT NULL))), lambda x: x <> '')), ';') END AS {column}"
    )


RECORD = ("org_name", "ein", "state", "city", "phone", "email", "website", "total_revenue", "va_accredited")


@query("merge_group_by_order_customer", f"""
SELECT o_custkey, min(o_orderkey) AS o_orderkey, {firsts(('o_orderstatus', 'o_totalprice', 'urgent'), 'o_orderkey')},
       {lineage_sql('o_orderpriority')}
FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END AS urgent FROM orders) GROUP BY o_custkey""")
def merge_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).alias("urgent"),
    )
    return resolve.merge_group(orders, "o_custkey", "o_orderkey", "o_orderpriority")


def _stacked(spark, sf_dir):
    """Organisations twice, the second time as another source with other gaps."""
    orgs = organizations(spark, sf_dir).select("_ord", *RECORD, "data_sources")
    again = orgs.select(
        (F.col("_ord") + 100_000_000).alias("_ord"),
        *[F.lit(None).cast("string").alias(c) if c in ("org_name", "state") else F.col(c) for c in RECORD],
        F.lit("crm;irs_bmf").alias("data_sources"),
    ).withColumn("phone", F.lit("555"))
    return orgs.unionByName(again)


_STACKED = f"""stacked AS (
  SELECT _ord, {', '.join(RECORD)}, data_sources FROM orgs
  UNION ALL SELECT _ord + 100000000, {', '.join('NULL' if c in ('org_name', 'state') else "'555'" if c == 'phone' else c
                                                for c in RECORD)}, 'crm;irs_bmf' FROM orgs)"""


def own_row_sql(key: str) -> str:
    return f"CASE WHEN coalesce({key}, '') = '' THEN 'row ' || _ord ELSE {key} END"


def merged_sql(rows: str, group: str) -> str:
    return f"SELECT min(_ord) AS _ord, {firsts(RECORD, '_ord')}, {lineage_sql()} FROM {rows} GROUP BY {group}"


@query("merge_exact_key", over_orgs(merged_sql("stacked", own_row_sql("ein")), _STACKED))
def merge_exact_key(spark, sf_dir):
    return resolve.merge_exact(_stacked(spark, sf_dir))


_DOMAIN = r"regexp_replace(lower(regexp_extract(website, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


@query("merge_domain", over_orgs(merged_sql("orgs", own_row_sql(_DOMAIN))))
def merge_domain(spark, sf_dir):
    return resolve.merge_domain(organizations(spark, sf_dir).select("_ord", *RECORD, "data_sources"))


@query("merge_domain_shared", over_orgs(f"""
SELECT min(_ord) AS _ord, {firsts(('org_name', 'website'), '_ord')}, {lineage_sql()}
FROM orgs
GROUP BY CASE WHEN coalesce({_DOMAIN}, '') IN ('', 'spam-farm.example.org', 'cheap-pills.example.com') THEN 'row ' || _ord ELSE {_DOMAIN} END"""))
def merge_domain_shared(spark, sf_dir):
    orgs = organizations(spark, sf_dir)
    return resolve.merge_domain(
        orgs.select("_ord", "org_name", "website", "data_sources"),
        shared_domains=("spam-farm.example.org", "cheap-pills.example.com"),
    )


# The measure and the greedy rule in SQL: one row of LCS lengths per character of the second text,
# then one step per row of a block with the list of its anchors so far.
def lcs_sql(texts: str) -> str:
    """A query giving ``x, y, lcs`` for the distinct pairs of texts."""
    return f"""(
  WITH RECURSIVE g(x, y, i, dp) AS (
    SELECT x, y, 0, list_transform(range(0, length(x) + 1), lambda j: 0) FROM {texts}
    UNION ALL
    SELECT x, y, i + 1, list_transform(range(0, length(x) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE
      list_max(list_transform(range(1, j + 1), lambda q:
        CASE WHEN x[q] = y[i + 1] THEN dp[q] + 1 ELSE dp[q + 1] END)) END)
    FROM g WHERE i < length(y))
  SELECT x, y, dp[length(x) + 1] AS lcs FROM g WHERE i = length(y))"""


def words_sql(text: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({text}, ' '), lambda x: x <> '')), ' ')"


def walk_sql(rows: str) -> str:
    """Common table expressions up to ``walk``: the cluster of each comparable row."""
    return f"""named AS (
  SELECT _ord, upper(state) || '|' || upper(city) AS block, {words_sql('org_name')} AS name
  FROM {rows} WHERE state IS NOT NULL AND city IS NOT NULL AND org_name IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY _ord) AS k FROM named),
texts AS (SELECT DISTINCT a.name AS x, b.name AS y FROM placed a JOIN placed b ON a.block = b.block AND a.k < b.k),
grid AS {lcs_sql('texts')},
near AS (
  SELECT b.block, b.k, list(a._ord) AS earlier FROM placed a JOIN placed b ON a.block = b.block AND a.k < b.k
  JOIN grid ON grid.x = a.name AND grid.y = b.name
  WHERE 200 * lcs >= 85 * (length(a.name) + length(b.name)) GROUP BY b.block, b.k),
steps AS (
  SELECT p.block, p.k, p._ord, coalesce(earlier, []) AS earlier FROM placed p LEFT JOIN near USING (block, k)),
walk AS (
  WITH RECURSIVE w(block, k, _ord, anchors, cluster) AS (
    SELECT block, k, _ord, [_ord], _ord FROM steps WHERE k = 1
    UNION ALL
    SELECT block, k, _ord, CASE WHEN hit IS NULL THEN list_append(anchors, _ord) ELSE anchors END, coalesce(hit, _ord)
    FROM (SELECT s.block, s.k, s._ord, w.anchors,
                 list_min(list_filter(w.anchors, lambda a: list_contains(s.earlier, a))) AS hit
          FROM w JOIN steps s ON s.block = w.block AND s.k = w.k + 1))
  SELECT _ord, cluster FROM w)"""


def clustered_sql(rows: str) -> str:
    return f"(SELECT r.*, coalesce(cluster, r._ord) AS cluster FROM {rows} r LEFT JOIN walk ON walk._ord = r._ord)"


@query("merge_fuzzy", over_orgs(merged_sql(clustered_sql("orgs"), "cluster"), walk_sql("orgs")), python=True)
def merge_fuzzy(spark, sf_dir):
    return resolve.merge_fuzzy(organizations(spark, sf_dir).select("_ord", *RECORD, "data_sources"))


# --- blocks for the search by shared grams ------------------------------------------------------------

def _titled(spark, sf_dir):
    """Documents as organisations: the first three words as name, the source as place."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("_ord"), F.regexp_extract("text", r"^(\S+ \S+ \S+)", 1).alias("org_name"),
        F.col("source").alias("state"), F.lit("x").alias("city"), F.col("lang").alias("data_sources"))


_TITLED = r"""titled AS (
  SELECT doc_id AS _ord, regexp_extract(text, '^(\S+ \S+ \S+)', 1) AS org_name, source AS state, 'x' AS city, lang AS data_sources
  FROM documents)"""
_TITLED_MERGED = (
    f"WITH {_TITLED}, {walk_sql('titled')} SELECT min(_ord) AS _ord, {firsts(('org_name', 'state', 'city'), '_ord')}, "
    f"{lineage_sql()} FROM {clustered_sql('titled')} GROUP BY cluster")


@query("merge_fuzzy_blocks", _TITLED_MERGED, python=True)
def merge_fuzzy_blocks(spark, sf_dir):
    """Blocks as the data have them, each in one task where it is small."""
    return resolve.merge_fuzzy(_titled(spark, sf_dir))


@query("merge_fuzzy_pieces", _TITLED_MERGED, python=True)
def merge_fuzzy_pieces(spark, sf_dir):
    """The same result from the search by rare grams, in slices, with a budget that makes it halve."""
    return resolve.merge_fuzzy(_titled(spark, sf_dir), small_block=4, slice_rows=100, max_candidates=5e4, finish_below=20)


_TIERS = f"""{_STACKED},
exact AS ({merged_sql('stacked', own_row_sql('ein'))}),
{walk_sql('exact')},
fuzzy AS ({merged_sql(clustered_sql('exact'), 'cluster')}),
final AS ({merged_sql('fuzzy', own_row_sql(_DOMAIN))})"""


@query("deduplicate", over_orgs("SELECT * FROM final", _TIERS), python=True)
def deduplicate(spark, sf_dir):
    """All three tiers over organisations from two sources."""
    return resolve.deduplicate(_stacked(spark, sf_dir))


@query("tier_counts", over_orgs(" UNION ALL ".join(
    f"SELECT '{tier}' AS tier, count(*) AS rows FROM {rows}"
    for tier, rows in (("start", "stacked"), ("exact", "exact"), ("fuzzy", "fuzzy"), ("domain", "final"))), _TIERS), python=True)
def tier_counts(spark, sf_dir):
    return resolve.tier_counts(_stacked(spark, sf_dir))


_PAIRS = f"""pairs AS (SELECT _ord, {words_sql('org_name')} AS x,
                {words_sql("(services_offered || ' ' || lower(city))")} AS y FROM orgs),
distinct_pairs AS (SELECT DISTINCT x, y FROM pairs), grid AS {lcs_sql('distinct_pairs')}"""


@query("name_similarity", over_orgs("""
SELECT _ord, round_even(200 * lcs / (length(x) + length(y)), 4) AS score FROM pairs JOIN grid USING (x, y)""", _PAIRS), python=True)
def name_similarity(spark, sf_dir):
    """Each organisation's name against its category and city."""
    other = F.concat("services_offered", F.lit(" "), F.lower("city"))
    score = similarity(F.col("org_name"), other)
    return organizations(spark, sf_dir).select("_ord", F.bround(score, 4).alias("score"))
