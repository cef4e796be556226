"""Queries for merges, lookups, update-backs, stacking and work queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterline import fixed
from rosterline.catalog.frame import order_totals, organizations, over_orgs
from rosterline.catalog.registry import query, table
from rosterline.operators import aggregate as agg
from rosterline.operators import merge
from rosterline.operators.coerce import SCHEMA, coerce_schema, empty_records


def shop_base(spark, sf_dir):
    """Customers with some blanks as the base of a merge."""
    c = F.col
    return table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("_ord"),
        F.when(c("c_acctbal") > -900, c("c_custkey").cast("string")).alias("ein"),
        F.when(c("c_acctbal") >= 0, c("c_name")).when(c("c_acctbal") > -500, "").alias("org_name"),
        F.when(c("c_nationkey") > 3, c("c_mktsegment")).alias("city"),
        F.lit(None).cast("double").alias("total_revenue"),
        F.when(c("c_nationkey") > 5, "irs_bmf;crm").otherwise("").alias("data_sources"),
    )


BASE = """base AS (
  SELECT c_custkey AS _ord, CASE WHEN c_acctbal > -900 THEN CAST(c_custkey AS VARCHAR) END AS ein,
         CASE WHEN c_acctbal >= 0 THEN c_name WHEN c_acctbal > -500 THEN '' END AS org_name,
         CASE WHEN c_nationkey > 3 THEN c_mktsegment END AS city, CAST(NULL AS DOUBLE) AS total_revenue,
         CASE WHEN c_nationkey > 5 THEN 'irs_bmf;crm' ELSE '' END AS data_sources FROM customer)"""


def order_source(spark, sf_dir):
    """Orders as a source with many rows per key, of which the first counts."""
    c = F.col
    return table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("_ord"), c("o_custkey").cast("string").alias("ein"),
        F.when(c("o_orderstatus") != "P", F.concat(F.lit("Order "), c("o_orderkey").cast("string"))).alias("org_name"),
        c("o_orderpriority").alias("city"), c("o_totalprice").alias("total_revenue"),
        F.when(c("o_orderstatus") == "F", "orders;crm").alias("data_sources"),
    )


ORDER_SOURCE = """src AS (
  SELECT CAST(o_custkey AS VARCHAR) AS k, CASE WHEN o_orderstatus <> 'P' THEN 'Order ' || o_orderkey END AS s_name,
         o_orderpriority AS s_city, o_totalprice AS s_revenue,
         CASE WHEN o_orderstatus = 'F' THEN 'orders;crm' END AS s_sources
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)"""
_UNION = """CASE WHEN s_sources IS NULL THEN data_sources ELSE array_to_string(list_sort(list_filter(
  list_distinct(string_split(coalesce(data_sources, '') || ';' || s_sources, ';')), lambda x: x <> '')), ';') END"""
_FILL = """SELECT _ord, ein, CASE WHEN coalesce(org_name, '') = '' THEN s_name ELSE org_name END AS org_name,
  coalesce(city, s_city) AS city, coalesce(total_revenue, s_revenue) AS total_revenue, {} AS data_sources
  FROM base LEFT JOIN src ON k = ein"""


@query("fill_blanks", f"WITH {BASE}, {ORDER_SOURCE} {_FILL.format(_UNION)}")
def fill_blanks(spark, sf_dir):
    return merge.fill_blanks(shop_base(spark, sf_dir), order_source(spark, sf_dir))


@query("fill_first_lineage", f"""WITH {BASE}, {ORDER_SOURCE}
{_FILL.format("CASE WHEN coalesce(data_sources, '') = '' THEN s_sources ELSE data_sources END")}""")
def fill_first_lineage(spark, sf_dir):
    return merge.fill_blanks(shop_base(spark, sf_dir), order_source(spark, sf_dir), lineage="first_nonblank")


def supplier_source(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("_ord"), F.col("s_suppkey").cast("string").alias("ein"),
        F.col("s_name").alias("org_name"), F.col("s_acctbal").alias("total_revenue"),
        F.col("s_acctbal").alias("total_assets"), F.lit("suppliers").alias("data_sources"),
    )


def part_rows(spark, sf_dir):
    """Parts as a source without a key."""
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 10_000_000).alias("_ord"), F.col("p_name").alias("org_name"),
        F.col("p_retailprice").alias("total_revenue"), F.lit("parts").alias("data_sources"),
    )


@query("merge_sources", f"""
WITH {BASE}, {ORDER_SOURCE},
first AS ({_FILL.format(_UNION)}),
second AS (
  SELECT first._ord, ein, CASE WHEN coalesce(org_name, '') = '' THEN s_name ELSE org_name END AS org_name, city,
         coalesce(total_revenue, s_acctbal) AS total_revenue, s_acctbal AS total_assets,
         CASE WHEN s_suppkey IS NULL THEN data_sources ELSE array_to_string(list_sort(list_filter(list_distinct(
           string_split(coalesce(data_sources, '') || ';suppliers', ';')), lambda x: x <> '')), ';') END AS data_sources
  FROM first LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = ein)
SELECT * FROM second
UNION ALL SELECT p_partkey + 10000000, NULL, p_name, NULL, p_retailprice, NULL, 'parts' FROM part""")
def merge_sources(spark, sf_dir):
    keyed = {
        "orders": order_source(spark, sf_dir), "nothing": empty_records(spark).withColumn("_ord", F.lit(0).cast("long")),
        "suppliers": supplier_source(spark, sf_dir),
    }
    merged = merge.merge_sources(shop_base(spark, sf_dir), keyed, {"parts": part_rows(spark, sf_dir)})
    return merged.select("_ord", "ein", "org_name", "city", "total_revenue", "total_assets", "data_sources")


@query("append_sources", """
SELECT c_custkey AS _ord, c_name AS org_name, c_acctbal AS total_assets, CAST(NULL AS DOUBLE) AS total_revenue FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier
UNION ALL SELECT p_partkey + 10000000, p_name, NULL, p_retailprice FROM part""")
def append_sources(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_ord"), F.col("c_name").alias("org_name"), F.col("c_acctbal").alias("total_assets")
    )
    suppliers = supplier_source(spark, sf_dir).drop("total_revenue")
    empty = coerce_schema(empty_records(spark, SCHEMA).withColumn("_ord", F.lit(0).cast("long")), keep=("_ord",))
    return merge.append_rows(customers, empty, suppliers, part_rows(spark, sf_dir)).select(
        "_ord", "org_name", "total_assets", "total_revenue"
    )


@query("first_rows", """
SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def first_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return merge.first_rows(orders, "o_custkey", "o_orderkey")


@query("filled_columns", over_orgs("SELECT " + ", ".join(
    f"count({n}) > 0 AS {n}" for n, _ in fixed.COLUMNS) + " FROM orgs"))
def filled_columns(spark, sf_dir):
    """Which columns have any value."""
    names = [n for n, _ in fixed.COLUMNS]
    found = set(merge.filled_columns(organizations(spark, sf_dir), names))
    return spark.range(1).select(*[F.lit(n in found).alias(n) for n in names])


@query("semi_clean_key", """
SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS ein FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def semi_clean_key(spark, sf_dir):
    source = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("ein")
    )
    nine = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    base = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(
        F.concat(F.substring(nine, 1, 2), F.lit("-"), F.substring(nine, 3, 7), F.lit(" ")).alias("key")
    )
    return merge.keep_known_keys(source, base, "ein", "key")


@query("zip_coordinates", over_orgs("""
SELECT _ord, zip_code, s_acctbal / 100 AS lat, CAST(s_nationkey AS DOUBLE) AS lng
FROM orgs LEFT JOIN supplier ON lpad(CAST(s_suppkey * 7 AS VARCHAR), 5, '0') = substr(zip_code, 1, 5)"""))
def zip_coordinates(spark, sf_dir):
    gazetteer = table(spark, sf_dir, "supplier").select(
        F.lpad((F.col("s_suppkey") * 7).cast("string"), 5, "0").alias("zip5"),
        (F.col("s_acctbal") / 100).alias("latitude"), F.col("s_nationkey").cast("double").alias("longitude"),
    )
    orgs = organizations(spark, sf_dir).select("_ord", "zip_code")
    return merge.add_coordinates(orgs, gazetteer)


@query("zero_filled_counts", """
SELECT n_nationkey, n_name, coalesce(n, 0) AS count FROM nation
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def zero_filled(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return agg.zero_filled_counts(table(spark, sf_dir, "supplier"), "s_nationkey", nations, "n_nationkey")


@query("update_back", """
SELECT c_custkey, CASE WHEN c_nationkey = 3 AND n_orders > 9 THEN 'busy' ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_nationkey = 3 THEN coalesce(n_orders * 1.0, c_acctbal) ELSE c_acctbal END AS c_acctbal
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def update_back(spark, sf_dir):
    full = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    one_nation = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select("c_custkey")
    enriched = one_nation.join(order_totals(spark, sf_dir), "c_custkey").select(
        "c_custkey", F.when(F.col("n_orders") > 9, "busy").alias("c_mktsegment"),
        F.col("n_orders").cast("double").alias("c_acctbal"),
    )
    return merge.update_back(full, enriched, "c_custkey", ["c_mktsegment", "c_acctbal"])


_FOUND = """found AS (SELECT c_custkey AS k, CASE WHEN c_nationkey > 12 THEN 'https://site/' || c_custkey ELSE '' END AS w,
                             CASE WHEN c_acctbal > 0 THEN '555' END AS p FROM customer WHERE c_nationkey > 8)"""


def _found(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "customer").filter("c_nationkey > 8").select(
        c("c_custkey").alias("_ord"),
        F.when(c("c_nationkey") > 12, F.concat(F.lit("https://site/"), c("c_custkey").cast("string")))
        .otherwise("").alias("website"),
        F.when(c("c_acctbal") > 0, "555").alias("phone"),
    )


def _fill_back_sql(missing: str) -> str:
    return over_orgs("""
SELECT _ord, CASE WHEN tw THEN w ELSE website END AS website, CASE WHEN tp THEN p ELSE phone END AS phone,
       CAST(tw AS INT) + CAST(tp AS INT) AS fields_updated FROM j""", f"""{_FOUND},
j AS (SELECT *, ({missing.format('website')}) AND coalesce(w, '') <> '' AS tw,
             ({missing.format('phone')}) AND coalesce(p, '') <> '' AS tp FROM orgs LEFT JOIN found ON k = _ord)""")


@query("fill_back", _fill_back_sql("{0} IS NULL OR {0} = ''"))
def fill_back(spark, sf_dir):
    orgs = organizations(spark, sf_dir).select("_ord", "website", "phone")
    return merge.fill_back(orgs, _found(spark, sf_dir), "_ord", ["website", "phone"])


@query("fill_back_nulls", _fill_back_sql("{0} IS NULL"))
def fill_back_nulls(spark, sf_dir):
    orgs = organizations(spark, sf_dir).select("_ord", "website", "phone")
    return merge.fill_back(orgs, _found(spark, sf_dir), "_ord", ["website", "phone"], empty_is_missing=False)


@query("remaining_work", """
SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 30)""")
def remaining_work(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = events.filter("event_type = 'signup' AND value > 30").select("user_id")
    return merge.remaining(events.select("event_id", "user_id"), done, "user_id")


@query("remaining_first", """
SELECT event_id, user_id FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 30) ORDER BY event_id LIMIT 50""")
def remaining_first(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = events.filter("event_type = 'signup' AND value > 30").select("user_id")
    return merge.remaining(events.select("event_id", "user_id"), done, "user_id", limit=50, order="event_id")


_PEOPLE = """SELECT conv_id, to_json(coalesce(list({'name': text, 'title': 'Speaker'} ORDER BY turn)
  FILTER (text <> '' AND role = 'user'), [])) AS key_personnel FROM conversations GROUP BY conv_id"""


def _speakers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn(
        "speaker", F.when(F.col("role") == "user", F.col("text"))
    )


@query("group_people_json", f"""
SELECT conv_id, CAST(key_personnel AS VARCHAR) AS key_personnel FROM ({_PEOPLE})""")
def group_people_json(spark, sf_dir):
    return agg.group_people(_speakers(spark, sf_dir), "conv_id", "speaker", "Speaker", order="turn")


@query("group_people_attached", f"""
SELECT conv_id, turn, CAST(key_personnel AS VARCHAR) AS key_personnel FROM conversations JOIN ({_PEOPLE}) USING (conv_id)""")
def group_people_attached(spark, sf_dir):
    rows = _speakers(spark, sf_dir)
    people = agg.group_people(rows, "conv_id", "speaker", "Speaker", order="turn")
    return agg.attach(rows.select("conv_id", "turn"), people, "conv_id")
