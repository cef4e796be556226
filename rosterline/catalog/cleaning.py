"""Queries for the normalisers and small scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterline import fixed
from rosterline.catalog.frame import organizations, over_orgs
from rosterline.catalog.registry import query, table
from rosterline.functions import clean
from rosterline.functions.blanks import to_number
from rosterline.operators.coerce import coerce_schema
from rosterline.operators.normalize import normalize_records

CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"
UNCASED = r"[^\p{Lu}\p{Ll}\p{Lt}]"


def title_sql(value: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({value}), '({CASED}+|{UNCASED}+)'), "
        "lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || x[2:]), '')"
    )


def labels_sql(value: str, labels: dict[str, str]) -> str:
    arms = " ".join("WHEN '{}' THEN '{}'".format(*[x.replace("'", "''") for x in p]) for p in labels.items())
    return f"CASE {value} {arms} END"


@query("norm_key", """
WITH raw AS (SELECT o_orderkey, o_orderkey || '-' || o_custkey || '.' || substr(o_orderpriority, 1, 1) AS raw
             FROM orders),
     d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM raw)
SELECT o_orderkey, raw,
       CASE WHEN length(digits) = 9 THEN substr(digits, 1, 2) || '-' || substr(digits, 3) END AS ein
FROM d""")
def norm_key(spark, sf_dir):
    raw = F.concat(
        F.col("o_orderkey").cast("string"), F.lit("-"), F.col("o_custkey").cast("string"), F.lit("."),
        F.substring("o_orderpriority", 1, 1),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.withColumn("ein", clean.normalize_key(F.col("raw")))


@query("norm_phone", r"""
WITH raw AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || ' (' || CAST(o_totalprice AS DECIMAL(18,2)) || ') '
                    || o_orderkey AS raw FROM orders),
     d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS n FROM raw),
     t AS (SELECT *, CASE WHEN length(n) = 11 AND n[1] = '1' THEN n[2:] ELSE n END AS t FROM d)
SELECT o_orderkey, CASE WHEN length(t) = 10 THEN '(' || t[1:3] || ') ' || t[4:6] || '-' || t[7:10] END AS phone
FROM t""")
def norm_phone(spark, sf_dir):
    raw = F.concat(
        F.col("o_custkey").cast("string"), F.lit(" ("),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(") "),
        F.col("o_orderkey").cast("string"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", clean.normalize_phone(raw).alias("phone"))


@query("norm_zip", """
WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey || '-' || l_suppkey || ' ' || l_orderkey AS raw FROM lineitem),
     k AS (SELECT *, regexp_replace(raw, '[^0-9-]', '', 'g') AS k FROM raw),
     t AS (SELECT *, ltrim(substr(k, 6), '-') AS tail FROM k)
SELECT l_orderkey, l_linenumber,
       CASE WHEN length(k) >= 5 THEN CASE WHEN length(tail) = 4 THEN substr(k, 1, 5) || '-' || tail
                                          ELSE substr(k, 1, 5) END END AS zip_code
FROM t""")
def norm_zip(spark, sf_dir):
    raw = F.concat(
        F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), F.lit(" "),
        F.col("l_orderkey").cast("string"),
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", clean.normalize_zip(raw).alias("zip_code")
    )


_URL_FORMS = "[url, substr(url, position('//' IN url) + 2) || '/;v=1', '  ' || upper(url) || '//', '']"


@query("norm_url", rf"""
WITH raw AS (SELECT page_id, unnest({_URL_FORMS}) AS raw, unnest([1, 2, 3, 4]) AS form FROM pages),
     t AS (SELECT *, trim(raw) AS x FROM raw),
     f AS (SELECT *, CASE WHEN regexp_matches(x, '^https?://') THEN x ELSE 'https://' || x END AS u FROM t),
     p AS (SELECT *, regexp_extract(u, '^(https?)://([^/?#]*)([^?#]*)', ['s', 'h', 'p']) AS m FROM f)
SELECT page_id, form, raw, CASE WHEN x <> '' AND m.h <> '' THEN rtrim(m.s || '://' || lower(m.h) ||
       regexp_replace(m.p, '^((?:.*/)?[^/;]*);[^/]*$', '\1'), '/') END AS website
FROM p""")
def norm_url(spark, sf_dir):
    url = F.col("url")
    bare = F.concat(F.regexp_replace(url, "^[^/]*//", ""), F.lit("/;v=1"))
    forms = F.array(url, bare, F.concat(F.lit("  "), F.upper(url), F.lit("//")), F.lit(""))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("p", "raw"))
    return rows.select("page_id", (F.col("p") + 1).alias("form"), "raw",
                       clean.normalize_url(F.col("raw")).alias("website"))


@query("web_domain", r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')
       AS domain
FROM pages""")
def web_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean.web_domain(F.col("url")).alias("domain"))


_NAME_TO_CODE = labels_sql("v", fixed.STATE_CODES_BY_NAME)


@query("norm_state", over_orgs(f"""
SELECT _ord, form, v AS raw, CASE WHEN length(v) = 2 THEN v ELSE {_NAME_TO_CODE} END AS state
FROM (SELECT _ord, 1 AS form, upper({labels_sql('state', fixed.REGION_NAMES)}) AS v FROM orgs
      UNION ALL SELECT _ord, 2, upper(state) FROM orgs)"""))
def norm_state(spark, sf_dir):
    orgs = organizations(spark, sf_dir).select("_ord", "state")
    name = clean.code_label(F.col("state"), fixed.REGION_NAMES)
    code = F.concat(F.lit(" "), F.lower("state"))
    forms = orgs.select("_ord", F.posexplode(F.array(name, code)).alias("p", "raw"))
    return forms.select("_ord", (F.col("p") + 1).alias("form"), F.upper(F.trim("raw")).alias("raw"),
                        clean.normalize_state(F.col("raw")).alias("state"))


@query("title_text", f"""
SELECT doc_id, {title_sql('text')} AS title FROM documents""")
def title_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean.title_case(F.col("text")).alias("title"))


_NAME_RAW = "' ' || p_name || '''s  ' || p_type || ' va post-' || p_size || 'th '"
_ACRONYMS = ", ".join(f"'{a}'" for a in fixed.NAME_ACRONYMS)


@query("norm_name", f"""
WITH t AS (SELECT p_partkey, regexp_replace({title_sql(f"trim({_NAME_RAW})")}, '\\s+', ' ', 'g') AS t FROM part)
SELECT p_partkey, array_to_string(list_transform(string_split(t, ' '),
       lambda w: CASE WHEN list_contains([{_ACRONYMS}], upper(w)) THEN upper(w) ELSE w END), ' ') AS org_name
FROM t""")
def norm_name(spark, sf_dir):
    raw = F.concat(
        F.lit(" "), "p_name", F.lit("'s  "), "p_type", F.lit(" va post-"), F.col("p_size").cast("string"),
        F.lit("th "),
    )
    return table(spark, sf_dir, "part").select("p_partkey", clean.normalize_name(raw).alias("org_name"))


@query("numeric_coerce", r"""
WITH raw AS (SELECT l_orderkey, l_linenumber,
                    CASE WHEN l_returnflag = 'R' THEN 'n/a' WHEN l_linestatus = 'O' THEN CAST(l_partkey AS VARCHAR)
                         WHEN l_returnflag = 'N' THEN 'NaN' ELSE '' END AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber,
       CASE WHEN NOT isnan(TRY_CAST(raw AS DOUBLE)) THEN TRY_CAST(raw AS DOUBLE) END AS amount
FROM raw""")
def numeric_coerce(spark, sf_dir):
    raw = (
        F.when(F.col("l_returnflag") == "R", "n/a")
        .when(F.col("l_linestatus") == "O", F.col("l_partkey").cast("string"))
        .when(F.col("l_returnflag") == "N", "NaN").otherwise("")
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", to_number(raw).alias("amount"))


_BUCKETS = " ".join(
    f"WHEN amount >= {lo}{'' if hi is None else f' AND amount <= {hi}'} THEN '{label}'"
    for lo, hi, label in fixed.REVENUE_BUCKETS
)


@query("revenue_buckets", f"""
WITH a AS (SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount FROM orders
           UNION ALL SELECT 'balance', c_custkey, c_acctbal FROM customer
           UNION ALL SELECT 'floor', c_custkey, floor(c_acctbal / 10000) FROM customer)
SELECT kind, id, CASE {_BUCKETS} END AS revenue_range FROM a""")
def revenue_buckets(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    amounts = orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"),
                            F.col("o_totalprice").alias("amount"))
    balance = lambda kind, value: customer.select(F.lit(kind).alias("kind"), F.col("c_custkey").alias("id"),
                                                  value.alias("amount"))
    amounts = amounts.unionByName(balance("balance", F.col("c_acctbal"))).unionByName(
        balance("floor", F.floor(F.col("c_acctbal") / 10000).cast("double"))
    )
    return amounts.select("kind", "id", clean.bucket_label(F.col("amount")).alias("revenue_range"))


def _currency_sql(value: str) -> str:
    def scaled(unit: str, places: int, suffix: str) -> str:
        return f"'$' || printf('%.{places}f', round_even(CAST({value} / {unit} AS DOUBLE), {places})) || '{suffix}'"

    return (
        f"CASE WHEN {value} IS NULL THEN 'N/A' WHEN {value} >= 1e9 THEN {scaled('1e9', 1, 'B')} "
        f"WHEN {value} >= 1e6 THEN {scaled('1e6', 1, 'M')} WHEN {value} >= 1e3 THEN {scaled('1e3', 0, 'K')} "
        f"ELSE {scaled('1.0', 0, '')} END"
    )


@query("compact_currency", over_orgs(f"""
SELECT _ord, {_currency_sql('total_revenue')} AS revenue, {_currency_sql('total_assets')} AS assets,
       {_currency_sql('(total_revenue * 1000)')} AS large FROM orgs"""))
def compact_currency(spark, sf_dir):
    money = lambda c: clean.compact_currency(c)
    return organizations(spark, sf_dir).select(
        "_ord", money(F.col("total_revenue")).alias("revenue"), money(F.col("total_assets")).alias("assets"),
        money(F.col("total_revenue") * 1000).alias("large"),
    )


@query("join_address", over_orgs("""
SELECT _ord, concat_ws(', ', nullif(street_address, ''), nullif(city, ''), nullif(state, ''), nullif(zip_code, ''))
       AS address FROM orgs"""))
def join_address(spark, sf_dir):
    parts = [F.col(c) for c in ("street_address", "city", "state", "zip_code")]
    return organizations(spark, sf_dir).select("_ord", clean.join_address(*parts).alias("address"))


@query("code_labels", over_orgs(f"""
SELECT _ord, irs_subsection, coalesce({labels_sql('irs_subsection', fixed.SUBSECTION_LABELS)},
       '501(c)(' || irs_subsection || ')') AS org_type,
       {labels_sql('irs_subsection', fixed.STATUS_LABELS)} AS tax_exempt_status,
       {labels_sql('state', fixed.REGION_NAMES)} AS state_name FROM orgs"""))
def code_labels(spark, sf_dir):
    code = F.col("irs_subsection")
    other = F.concat(F.lit("501(c)("), code, F.lit(")"))
    return organizations(spark, sf_dir).select(
        "_ord", "irs_subsection",
        clean.code_label(code, fixed.SUBSECTION_LABELS, other).alias("org_type"),
        clean.code_label(code, fixed.STATUS_LABELS).alias("tax_exempt_status"),
        clean.code_label(F.col("state"), fixed.REGION_NAMES).alias("state_name"),
    )


@query("slug_names", r"""
WITH w AS (SELECT p_partkey, list_filter(string_split(lower(p_name || '-' || p_type || '-' || p_size), '-'),
                                         lambda x: x <> '') AS parts FROM part),
     f AS (SELECT p_partkey, string_split(array_to_string(parts, ' '), ' ') AS words FROM w)
SELECT p_partkey, array_to_string(list_transform(words, lambda x: CASE WHEN regexp_full_match(x, '[a-z]{1,3}')
       THEN upper(x) ELSE upper(x[1]) || x[2:] END), ' ') AS org_name FROM f""")
def slug_names(spark, sf_dir):
    slug = F.lower(F.concat(
        F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("-"), "p_type", F.lit("-"),
        F.col("p_size").cast("string"),
    ))
    return table(spark, sf_dir, "part").select("p_partkey", clean.slug_to_name(slug).alias("org_name"))


@query("people_from_json", over_orgs("""
SELECT _ord, CAST(i AS BIGINT) AS position, key_personnel ->> ('$[' || i || '].name') AS name,
       key_personnel ->> ('$[' || i || '].title') AS title, CAST(key_personnel ->> ('$[' || i || '].compensation') AS DOUBLE) AS pay
FROM (SELECT _ord, key_personnel, unnest(range(0, CAST(json_array_length(key_personnel) AS BIGINT))) AS i
      FROM orgs WHERE json_valid(key_personnel))"""))
def people_from_json(spark, sf_dir):
    people = organizations(spark, sf_dir).select("_ord", F.posexplode(clean.people_list(F.col("key_personnel"))))
    return people.select(
        "_ord", F.col("pos").cast("long").alias("position"), "col.name", "col.title", F.col("col.compensation").alias("pay"))


@query("split_lists", over_orgs("""
SELECT _ord, trim(x) AS category FROM
  (SELECT _ord, unnest(string_split(service_categories || '; ;' || city || ' ', ';')) AS x FROM orgs)
WHERE trim(x) <> ''"""))
def split_lists(spark, sf_dir):
    text = F.concat("service_categories", F.lit("; ;"), "city", F.lit(" "))
    entries = F.explode(clean.split_list(text))
    return organizations(spark, sf_dir).select("_ord", entries.alias("category"))


_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"


@query("normalize_records", over_orgs(rf"""
SELECT _ord,
       CASE WHEN length({_DIGITS.format('ein')}) = 9
            THEN substr({_DIGITS.format('ein')}, 1, 2) || '-' || substr({_DIGITS.format('ein')}, 3) END AS ein,
       CASE WHEN length({_DIGITS.format('phone')}) = 10 THEN '(' || phone[1:3] || ') ' || phone[4:6] || '-' || phone[7:]
            END AS phone,
       rtrim(regexp_extract(website, '^(https?://[^?#]*)', 1), '/') AS website,
       state, substr(zip_code, 1, 5) AS zip_code,
       {title_sql('org_name')} AS org_name, lower(trim(email)) AS email, coalesce(country, 'US') AS country,
       facebook_url, twitter_url FROM orgs"""))
def normalize_table(spark, sf_dir):
    """Website hosts in the data are lower-case already."""
    return normalize_records(organizations(spark, sf_dir)).select(
        "_ord", "ein", "phone", "website", "state", "zip_code", "org_name", "email", "country",
        "facebook_url", "twitter_url",
    )


@query("coerce_schema", """
SELECT c_custkey AS _ord, c_name AS org_name, CAST(NULL AS VARCHAR) AS ein, TRY_CAST(c_mktsegment AS DOUBLE) AS total_revenue,
       c_acctbal AS total_assets, CAST(c_nationkey AS VARCHAR) AS state FROM customer""")
def coerced(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_ord"), F.col("c_name").alias("org_name"),
        F.col("c_mktsegment").alias("total_revenue"), F.col("c_acctbal").alias("total_assets"),
        F.col("c_nationkey").alias("state"), F.lit("gone").alias("extra"),
    )
    return coerce_schema(raw, keep=("_ord",)).select(
        "_ord", "org_name", "ein", "total_revenue", "total_assets", "state"
    )
