"""Queries for contact extraction, landed web documents and JSON sources.

The supplied pages have no contact data to speak of, so some queries add a few links made from
each page's own address.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from rosterline import fixed
from rosterline.catalog.cleaning import title_sql
from rosterline.catalog.frame import ORGS, organizations
from rosterline.catalog.registry import query, table
from rosterline.functions import contact
from rosterline.operators import enrich
from rosterline.session import shared_folder
from rosterline.sources import documents as docs
from rosterline.sources import web

EMAIL, PHONE = fixed.EMAIL_PATTERN, fixed.PHONE_PATTERN


def quoted(words: Sequence[str]) -> str:
    return ", ".join("'{}'".format(w.replace("'", "''")) for w in words)


def holds_any(value: str, parts: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({value}, '{p}')" for p in parts) + ")"


def bad_email(e: str, parts: Sequence[str]) -> str:
    return holds_any(e, parts)


def first_email_sql(text: str, bad: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '{EMAIL}'), lambda e: lower(e)), lambda e: NOT ({bad}))[1]"


_LISTED = f"e IN ({quoted(fixed.SKIP_EMAILS)}) OR " + " OR ".join(f"ends_with(e, '{x}')" for x in fixed.SKIP_EMAIL_ENDINGS)


@query("contacts_from_text", f"""
SELECT doc_id, nullif(regexp_extract(text, '{PHONE}'), '') AS phone, {first_email_sql('text', _LISTED)} AS email,
       {first_email_sql('text', holds_any('e', fixed.SKIP_EMAIL_PARTS))} AS site_email FROM documents""")
def contacts_from_text(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", contact.first_phone(text).alias("phone"), contact.first_email(text).alias("email"),
        contact.first_email(text, (), (), fixed.SKIP_EMAIL_PARTS).alias("site_email"),
    )


# Written apart from the library: the entities and the kinds of quoting that the pages hold.
def unescape_sql(value: str) -> str:
    for entity, text in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"),
        ("&#xe9;", "é"), ("&Uuml;", "Ü"), ("&#8211;", "–"), ("&amp;", "&"),
    ):
        value = f"replace({value}, '{entity}', '{text}')"
    return value


def links_sql(html: str) -> str:
    """Pages cut at ``<a``, comments left out; then the value behind ``href=`` by its first character."""
    live = f"regexp_replace({html}, '<!--(.|\\n)*?-->', '', 'g')"
    tags = f"list_transform(string_split(replace({live}, '<A ', '<a '), '<a ')[2:], lambda p: ' ' || p)"
    rest = "ltrim(regexp_replace(a, '^[^>]*?[ ]href *=', ''))"
    value = (f"CASE WHEN starts_with({rest}, chr(34)) THEN split_part({rest}, chr(34), 2) WHEN starts_with({rest}, chr(39)) "
             f"THEN split_part({rest}, chr(39), 2) ELSE regexp_extract({rest}, '^[^ >]*') END")
    linked = f"list_filter({tags}, lambda a: regexp_matches(a, '^[^>]* href *='))"
    return f"list_transform(list_transform({linked}, lambda a: {value}), lambda h: {unescape_sql('h')})"


_ROW_RE = "(?is)<(?:li)\\b[^>]*>(.*?)</(?:li)>"


@query("html_list_rows", rf"""
WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<(?:ul)\b[^>]*>(.*?)</(?:ul)>', 1) AS ul FROM pages),
     r AS (SELECT page_id, regexp_extract_all(ul, '{_ROW_RE}', 1) AS items FROM t),
     u AS (SELECT page_id, items[1] AS head, unnest(items[2:]) AS item, unnest(range(0, len(items) - 1)) AS row_no FROM r)
SELECT page_id, row_no, trim({unescape_sql("regexp_replace(item, '<[^>]*>', '', 'g')")}) AS entry,
       replace(lower(trim({unescape_sql("regexp_replace(head, '<[^>]*>', '', 'g')")})), ' ', '_') AS header FROM u""")
def html_list_rows(spark, sf_dir):
    """The first list of each page as a one-column table."""
    rows = web.table_rows(
        table(spark, sf_dir, "pages"), ["page_id"], container="ul", row="li", header_cells=("a",), cells=("a",),
        min_cells=1,
    )
    return rows.select("page_id", F.col("row_no").cast("long").alias("row_no"),
                       web.cell("none", 0).alias("entry"), F.get("headers", F.lit(0)).alias("header"))


def order_tables(spark, sf_dir):
    """An HTML table per customer, its orders as rows, the last row too short to count."""
    c = F.col
    text = lambda name: c(name).cast("string")
    cells = F.concat(
        F.lit("<tr><td>Post &amp; o'brien "), text("o_custkey"), F.lit("</td><td>"), text("o_orderkey"),
        F.lit("</td>\n<td><b> 502 </b> "), text("o_custkey"), F.lit("</td><td> "), c("o_orderpriority"),
        F.lit(" </td><td>ky</td><td>"), F.when(c("o_orderstatus") == "O", F.concat(F.lit("Rep "), text("o_orderkey")))
        .otherwise(""), F.lit("</td></tr>"),
    )
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct(c("o_orderkey").alias("k"), cells.alias("row")))), lambda r: r["row"]
    )
    head = ("<html><body><TABLE class='x'><tr><th>Name</th><th>POA</th><th>Org Phone</th><th>Org City</th>"
            "<th>Org State</th><th>Representative</th></tr>")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.concat(F.lit(head), F.array_join(listed, "\n"), F.lit("<tr><td>end</td></tr></TABLE></body></html>")).alias("html")
    )


_ACCREDITED = """SELECT o_custkey, 'Post & o''brien ' || o_custkey AS org_name, o_orderpriority AS city, 'ky' AS state,
  '' AS zip_code, '502' || o_custkey AS phone, CASE WHEN o_orderstatus = 'O' THEN 'Rep ' || o_orderkey ELSE '' END AS representative_name,
  'VA-Accredited VSO' || CASE WHEN o_orderstatus = 'O' THEN '; Rep: Rep ' || o_orderkey ELSE '' END AS accreditation_details,
  o_orderkey FROM orders"""


@query("accredited_organizations", f"SELECT * EXCLUDE (o_orderkey) FROM ({_ACCREDITED})")
def accredited_organizations(spark, sf_dir):
    return web.accredited_organizations(order_tables(spark, sf_dir), ["o_custkey"]).drop("_ord")


@query("accredited_records", f"""
SELECT {title_sql('org_name')} AS org_name, {title_sql('city')} AS city, 'KY' AS state, zip_code, phone,
       'Yes' AS va_accredited, accreditation_details, key_personnel
FROM ({_ACCREDITED}) JOIN (
  SELECT o_custkey, CAST(to_json(coalesce(list({{'name': 'Rep ' || o_orderkey, 'title': 'VSO Representative'}} ORDER BY o_orderkey)
         FILTER (o_orderstatus = 'O'), [])) AS VARCHAR) AS key_personnel FROM orders GROUP BY 1) USING (o_custkey)""")
def accredited_records(spark, sf_dir):
    rows = web.accredited_organizations(order_tables(spark, sf_dir), ["o_custkey"])
    return web.map_accredited(rows).drop("_ord")


@query("searched_organizations", """
SELECT o_custkey, 'Post & o''brien ' || o_custkey AS org_name, CAST(o_orderkey AS VARCHAR) AS city, '502' || o_custkey AS state,
       o_orderpriority AS zip_code, 'ky' AS phone, CAST(NULL AS VARCHAR) AS representative_name, 'VA-Accredited VSO' AS accreditation_details
FROM orders""")
def searched_organizations(spark, sf_dir):
    return web.searched_organizations(order_tables(spark, sf_dir), ["o_custkey"]).drop("_ord")


@query("sitemap_resources", """
SELECT array_to_string(list_transform(string_split(p_name || ' ' || lower(p_type), ' '), lambda w:
         CASE WHEN length(w) <= 3 THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' ') AS org_name,
       'https://dir.example.org/resource/detail/' || p_partkey || '/' || replace(p_name, ' ', '-') || '-' || lower(p_type) AS website,
       CAST(p_partkey AS VARCHAR) AS resource_id, '' AS services_offered, 'NRD Resource' AS service_categories
FROM part""")
def sitemap_resources(spark, sf_dir):
    """Part addresses twice, and page addresses that are no resources."""
    slug = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("-"), F.lower("p_type"))
    detail = F.concat(F.lit("https://dir.example.org/resource/detail/"), F.col("p_partkey").cast("string"), F.lit("/"), slug)
    parts = table(spark, sf_dir, "part").select(detail.alias("url"))
    urls = parts.unionByName(parts).unionByName(table(spark, sf_dir, "pages").select("url"))
    return web.sitemap_resources(urls)


# --- pages with contact links made from their own address -----------------------------------------

def landed_pages(spark, sf_dir):
    c = F.col
    host = F.regexp_extract("url", "//([^/]*)", 1)
    key = c("page_id").cast("string")
    secure = F.startswith(c("url"), F.lit("https"))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.when(c("page_id") < 10, 404).otherwise(200).alias("status"),
        F.concat(
            c("html"),
            F.when(secure, F.concat(F.lit('<a class="m" href="mailto:Info@'), host, F.lit('?subject=x">write</a>')))
            .otherwise(F.concat(F.lit("<p>desk"), key, F.lit("@Mail.org or (502) 555-"), F.lpad(key, 4, "0"), F.lit("</p>"))),
            F.lit("<!-- <a href='https://www.linkedin.com/in/gone'>no</a>\n--><A class=x href = 'https://www.instagram.com/q"), key,
            F.lit("'>&Uuml;</A><a href=https://www.youtube.com/c/bare"), key,
            F.lit(">&#xe9; &#8211;</a><a title=\"o'x\" href=\"/it's&amp;lt;"), key, F.lit('">q</a>'),
            F.lit('<a href="https://www.facebook.com/sharer/x">s</a><a href="https://www.Facebook.com/org.'), key,
            F.lit('/">f</a><script>go("https://twitter.com/intent/a", "https://x.com/org'), key,
            F.lit("\")</script><meta name='description' content=' Aid &amp; care no. "), key, F.lit(" '>"),
        ).alias("html"),
    )


_PAGES = """landed AS (
  SELECT page_id, url, CASE WHEN page_id < 10 THEN 404 ELSE 200 END AS status,
         html || CASE WHEN starts_with(url, 'https')
           THEN '<a class="m" href="mailto:Info@' || regexp_extract(url, '//([^/]*)', 1) || '?subject=x">write</a>'
           ELSE '<p>desk' || page_id || '@Mail.org or (502) 555-' || lpad(CAST(page_id AS VARCHAR), 4, '0') || '</p>' END
         || '<!-- <a href=''https://www.linkedin.com/in/gone''>no</a>' || chr(10)
         || '--><A class=x href = ''https://www.instagram.com/q' || page_id
         || '''>&Uuml;</A><a href=https://www.youtube.com/c/bare' || page_id
         || '>&#xe9; &#8211;</a><a title="o''x" href="/it''s&amp;lt;' || page_id || '">q</a>'
         || '<a href="https://www.facebook.com/sharer/x">s</a><a href="https://www.Facebook.com/org.' || page_id
         || '/">f</a><script>go("https://twitter.com/intent/a", "https://x.com/org' || page_id
         || '")</script><meta name=''description'' content='' Aid &amp; care no. ' || page_id || ' ''>' AS html
  FROM pages)"""


def social_sql(name: str, pattern: str, skip: Sequence[str]) -> str:
    ok = lambda u: f"NOT {holds_any(f'lower({u})', skip)}" if skip else "true"
    raw = f"nullif(regexp_extract(html, '{pattern}'), '')"
    return (
        f"rtrim(coalesce(list_filter(list_transform(hrefs, lambda h: regexp_extract(h, '{pattern}')), "
        f"lambda u: u <> '' AND {ok('u')})[1], CASE WHEN {ok(raw)} THEN {raw} END), '/') AS {name}"
    )


def socials_sql(skip: Sequence[str] = ()) -> str:
    return ", ".join(social_sql(n, p, skip) for n, p in fixed.SOCIAL_PATTERNS.items())


_META = f"""CASE WHEN contains(html, '<meta name=''description''') THEN trim({
    unescape_sql("regexp_extract(html, '<meta name=''description'' content=''([^'']*)''', 1)")}) END"""
_MAILTO = f"""list_filter(list_transform(list_filter(hrefs, lambda h: starts_with(h, 'mailto:')),
  lambda h: lower(trim(split_part(replace(h, 'mailto:', ''), '?', 1)))),
  lambda e: regexp_matches(e, '^{EMAIL}') AND NOT {holds_any('e', fixed.SKIP_EMAIL_PARTS)})[1]"""
_LINKED = f"linked AS (SELECT *, {links_sql('html')} AS hrefs FROM landed WHERE status = 200)"
_SITE = f"""SELECT page_id, nullif(regexp_extract(html, '{PHONE}'), '') AS phone,
  coalesce({_MAILTO}, {first_email_sql('html', holds_any('e', fixed.SKIP_EMAIL_PARTS))}) AS email,
  {socials_sql(fixed.SKIP_SOCIAL_PARTS)}, {_META} AS mission_statement FROM linked"""
_PAGE = f"""SELECT page_id, url, {socials_sql()}, {first_email_sql('html', _LISTED)} AS email, {_META} AS mission_statement
  FROM linked"""


@query("site_details", f"WITH {_PAGES}, {_LINKED} {_SITE}")
def site_details(spark, sf_dir):
    return enrich.site_details(landed_pages(spark, sf_dir), keep=("page_id",))


@query("page_details", f"WITH {_PAGES}, {_LINKED} {_PAGE}")
def page_details(spark, sf_dir):
    return enrich.page_details(landed_pages(spark, sf_dir), keep=("page_id", "url"))


@query("page_links", f"WITH {_PAGES} SELECT page_id, unnest({links_sql('html')}) AS href FROM landed")
def page_links(spark, sf_dir):
    return landed_pages(spark, sf_dir).select("page_id", F.explode(contact.links(F.col("html"))).alias("href"))


_SOCIAL = tuple(fixed.SOCIAL_PATTERNS)
_FILLED = ", ".join(
    f"CASE WHEN needy AND o.{c} IS NULL THEN coalesce(nullif(f.{c}, ''), o.{c}) ELSE o.{c} END AS {c}"
    for c in ("email", "mission_statement", *_SOCIAL)
)
_CHANGED = " + ".join(
    f"CAST(coalesce(needy AND o.{c} IS NULL AND f.{c} <> '', false) AS INT)" for c in ("email", "mission_statement", *_SOCIAL)
)


@query("enrich_from_pages", f"""
WITH {ORGS}, {_PAGES}, {_LINKED}, found AS ({_PAGE}), one AS (SELECT DISTINCT ON (url) * FROM found),
o AS (SELECT *, website IS NOT NULL AND (email IS NULL OR facebook_url IS NULL OR twitter_url IS NULL) AS needy FROM orgs)
SELECT _ord, website, {_FILLED}, {_CHANGED} AS fields_updated FROM o LEFT JOIN one f ON f.url = o.website""")
def enrich_from_pages(spark, sf_dir):
    columns = ("_ord", "website", "email", "mission_statement", *_SOCIAL)
    orgs = organizations(spark, sf_dir).select(*columns)
    return enrich.enrich_from_pages(orgs, landed_pages(spark, sf_dir))


# --- search results made from events ---------------------------------------------------------------

def result_rows(spark, sf_dir):
    c = F.col
    user = c("user_id").cast("string")
    kind = lambda name, *parts: (c("event_type") == name, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    url: Column = F.when(*kind("view", "https://www.google.com/q", user))
    for test, value in (
        kind("click", "https://www.facebook.com/org", user, "/"), kind("signup", "https://site", user, ".org/a"),
        kind("error", "http://fedex.com/q"), kind("purchase", "https://x.com/intent"),
    ):
        url = url.when(test, value)
    return table(spark, sf_dir, "events").select(
        user.alias("ein"), c("event_id").alias("rank"), url.alias("url"),
        F.when(c("value") > 40, F.concat(F.lit("Call 502.555."), F.lpad(F.substring(user, 1, 4), 4, "0"))).alias("title"),
        F.when(c("value") > 30, F.concat(F.lit("mail Desk"), c("event_id").cast("string"), F.lit("@Mail.org or x@y.net")))
        .when(c("value") > 20, "noreply@mail.org, desk@mail.org").alias("snippet"),
    )


_RESULTS = """results AS (
  SELECT CAST(user_id AS VARCHAR) AS ein, event_id AS rank,
    CASE event_type WHEN 'view' THEN 'https://www.google.com/q' || user_id
      WHEN 'click' THEN 'https://www.facebook.com/org' || user_id || '/' WHEN 'signup' THEN 'https://site' || user_id || '.org/a'
      WHEN 'error' THEN 'http://fedex.com/q' WHEN 'purchase' THEN 'https://x.com/intent' END AS url,
    CASE WHEN value > 40 THEN 'Call 502.555.' || lpad(substr(CAST(user_id AS VARCHAR), 1, 4), 4, '0') END AS title,
    CASE WHEN value > 30 THEN 'mail Desk' || event_id || '@Mail.org or x@y.net'
         WHEN value > 20 THEN 'noreply@mail.org, desk@mail.org' END AS snippet FROM events)"""


def evidence_sql(site_ok: str) -> str:
    profiles = ", ".join(
        f"rtrim(arg_min(regexp_extract(url, '{p}'), rank) FILTER (regexp_extract(url, '{p}') <> '' AND NOT "
        f"{holds_any(f'''lower(regexp_extract(url, '{p}'))''', fixed.SKIP_SOCIAL_PARTS)}), '/') AS {n}"
        for n, p in fixed.SOCIAL_PATTERNS.items()
    )
    return f"""evidence AS (
  SELECT ein, arg_min(url, rank) FILTER ({site_ok}) AS website,
         arg_min(regexp_extract(t, '{PHONE}'), rank) FILTER (regexp_extract(t, '{PHONE}') <> '') AS phone,
         arg_min(m, rank) FILTER (m <> '' AND NOT {holds_any('lower(m)', fixed.SKIP_EMAIL_PARTS)}) AS email, {profiles}
  FROM (SELECT *, coalesce(snippet, '') || ' ' || coalesce(title, '') AS t,
               regexp_extract(coalesce(snippet, '') || ' ' || coalesce(title, ''), '{EMAIL}') AS m,
               replace(lower(regexp_extract(url, '//([^/]*)', 1)), 'www.', '') AS host FROM results) GROUP BY ein)"""


_BY_SUFFIX = f"host NOT IN ({quoted(fixed.SKIP_DOMAINS)}) AND NOT (" + " OR ".join(
    f"ends_with(host, '.{d}')" for d in fixed.SKIP_DOMAINS) + ")"
_BY_PART = f"NOT {holds_any('host', fixed.SKIP_DOMAINS)}"


@query("result_evidence", f"WITH {_RESULTS}, {evidence_sql(_BY_SUFFIX)} SELECT * FROM evidence")
def result_evidence(spark, sf_dir):
    return enrich.evidence_from_results(result_rows(spark, sf_dir))


@query("result_evidence_substring", f"WITH {_RESULTS}, {evidence_sql(_BY_PART)} SELECT * FROM evidence")
def result_evidence_substring(spark, sf_dir):
    """Any part of the host counts, so ``fedex.com`` is skipped for its ``x.com``."""
    return enrich.evidence_from_results(result_rows(spark, sf_dir), substring_domains=True)


def site_pages(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("https://site"), key, F.lit(".org/a")).alias("url"),
        F.concat(
            F.lit('<a href="mailto:Hi@org'), key, F.lit('.net?x=1">m</a> (502) 555-'), F.lpad(key, 4, "0"),
            F.lit(' <a href="https://www.linkedin.com/company/c'), key, F.lit('/">l</a>'),
            F.lit('<meta name="description" content="Aid no. '), key, F.lit('">'),
        ).alias("html"),
    )


_SITES = """sites AS (
  SELECT 'https://site' || c_custkey || '.org/a' AS url, 'hi@org' || c_custkey || '.net' AS s_email,
         '(502) 555-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS s_phone,
         'https://www.linkedin.com/company/c' || c_custkey AS s_link, 'Aid no. ' || c_custkey AS s_mission FROM customer),
combined AS (
  SELECT ein, website, coalesce(phone, s_phone) AS phone, coalesce(email, s_email) AS email, facebook_url, twitter_url,
         coalesce(linkedin_url, s_link) AS linkedin_url, instagram_url, youtube_url, s_mission AS mission_statement
  FROM evidence LEFT JOIN sites ON url = website)"""


@query("combined_evidence", f"WITH {_RESULTS}, {evidence_sql(_BY_PART)}, {_SITES} SELECT * FROM combined")
def combined_evidence(spark, sf_dir):
    evidence = enrich.evidence_from_results(result_rows(spark, sf_dir), substring_domains=True)
    return enrich.combine_evidence(evidence, enrich.site_details(site_pages(spark, sf_dir)))


_ENRICHED = ", ".join(
    f"CASE WHEN coalesce(c.{c}, '') = '' THEN coalesce(f.{c}, c.{c}) ELSE c.{c} END AS {c}" for c in enrich.FOUND
)
_TAKEN = " + ".join(f"CAST(coalesce(c.{c}, '') = '' AND f.{c} IS NOT NULL AS INT)" for c in enrich.FOUND)
_EMPTY = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in enrich.FOUND if c not in ("phone", "email"))


@query("enrich_from_results", f"""
WITH {_RESULTS}, {evidence_sql(_BY_SUFFIX)}, {_SITES},
c AS (SELECT CAST(c_custkey AS VARCHAR) AS ein, CASE WHEN c_acctbal > 0 THEN '555' ELSE '' END AS phone,
             CASE WHEN c_nationkey > 9 THEN c_name END AS email, {_EMPTY} FROM customer)
SELECT c.ein, {_ENRICHED}, {_TAKEN} AS fields_updated FROM c LEFT JOIN combined f ON f.ein = c.ein""")
def enrich_from_results(spark, sf_dir):
    c = F.col
    records = table(spark, sf_dir, "customer").select(
        c("c_custkey").cast("string").alias("ein"), F.when(c("c_acctbal") > 0, "555").otherwise("").alias("phone"),
        F.when(c("c_nationkey") > 9, c("c_name")).alias("email"),
        *[F.lit(None).cast("string").alias(n) for n in enrich.FOUND if n not in ("phone", "email")],
    )
    return enrich.enrich_from_results(records, result_rows(spark, sf_dir), site_pages(spark, sf_dir))


# --- JSON documents made from rows -------------------------------------------------------------------

@query("json_props", "SELECT event_id, event_type, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    parsed = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", "event_type", parsed["k"].alias("k"))


def as_documents(df, schema: str, *keys: str):
    """Rows to JSON text and back by schema, as if read from landed files."""
    text = df.select(F.to_json(F.struct(*df.columns)).alias("doc"))
    return text.select(F.from_json("doc", schema).alias("d")).select("d.*").withColumn(
        "_ord", F.monotonically_increasing_id()
    )


def landed(spark, df, schema: str):
    """Rows as compressed files of JSON documents, read as such."""
    folder = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    df.write.option("compression", "gzip").json(folder)
    return docs.read_json(spark, folder, schema)


def financial_sql(officers: str) -> str:
    return f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS ein, CAST(count(*) AS DOUBLE) AS num_employees,
       arg_max(o_totalprice, o_orderkey) AS total_revenue, CAST(max(o_orderkey) AS DOUBLE) AS total_expenses,
       CASE WHEN arg_max(o_orderstatus, o_orderkey) = 'F' THEN CAST(max(o_orderkey) AS DOUBLE) END AS total_assets,
       CAST(to_json(list({{'name': o_orderpriority, 'title': '', 'compensation': CASE WHEN o_orderstatus = 'F' THEN o_totalprice END}}
            ORDER BY o_orderkey) FILTER ({officers})) AS VARCHAR) AS key_personnel
FROM o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY o_custkey"""


def filings(spark, sf_dir):
    """A filing per order, the latest first; customers in debt were not found."""
    c = F.col
    filing = F.struct(
        c("o_orderkey").alias("k"), c("o_totalprice").cast("string").alias("totrevenue"),
        c("o_orderkey").cast("string").alias("totfuncexpns"),
        F.when(c("o_orderstatus") == "F", c("o_orderkey").cast("string")).otherwise("n/a").alias("totassetsend"),
    )
    officer = F.struct(
        c("o_orderkey").alias("k"), c("o_orderpriority").alias("name"),
        F.when(c("o_orderstatus") == "F", c("o_totalprice")).alias("compensation"),
    )
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(filing), asc=False).alias("filings"),
        F.sort_array(F.collect_list(officer)).alias("officers"), F.count(F.lit(1)).alias("n"),
    )
    customer = table(spark, sf_dir, "customer").select(c("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    documents = grouped.join(customer, "o_custkey").select(
        F.lpad(c("o_custkey").cast("string"), 9, "0").alias("ein"),
        F.when(c("c_acctbal") < 0, 404).otherwise(200).alias("status"),
        F.struct(c("c_name").alias("name"), c("n").cast("string").alias("number_of_forms_filed")).alias("organization"),
        F.transform("filings", lambda f: f.withField("officers", c("officers"))).alias("filings_with_data"),
    )
    return as_documents(documents, docs.FINANCIALS)


_FINANCIAL = ("ein", "num_employees", "total_revenue", "total_expenses", "total_assets", "key_personnel")


@query("financial_documents", financial_sql("true"))
def financial_documents(spark, sf_dir):
    return docs.flatten_financials(filings(spark, sf_dir)).select(*_FINANCIAL)


@query("financial_documents_ten", financial_sql("n <= 10"))
def financial_documents_ten(spark, sf_dir):
    return docs.flatten_financials(filings(spark, sf_dir), officers_limit=10).select(*_FINANCIAL)


@query("rating_documents", """
SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS ein, text AS mission_statement, 'https://site/' || doc_id AS website,
       CAST(quality AS DOUBLE) AS charity_navigator_rating, n_chars / 2 AS charity_navigator_score,
       CASE WHEN toxic = 1 THEN 'HIGH' END AS cn_alert_level, 'https://facebook.com/' || source AS facebook_url,
       CASE WHEN lang <> 'en' THEN 'https://twitter.com/' || lang END AS twitter_url
FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 100""")
def rating_documents(spark, sf_dir):
    c = F.col
    key = c("doc_id").cast("string")
    org = F.struct(
        c("text").alias("mission"), F.concat(F.lit("https://site/"), key).alias("websiteURL"),
        F.struct((c("n_chars") / 2).cast("string").alias("score"), c("quality").cast("string").alias("rating"))
        .alias("currentRating"),
        F.when(c("toxic") == 1, F.array(F.struct(F.lit("HIGH").alias("severity")))).alias("advisories"),
        F.struct(F.concat(F.lit("https://facebook.com/"), "source").alias("facebookProfileUrl"),
                 F.when(c("lang") != "en", c("lang")).otherwise("").alias("twitterHandle")).alias("socialMedia"),
    )
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.lpad(key, 9, "0").alias("ein"),
        F.struct(F.when(c("n_chars") > 100, org).alias("organizationByEIN")).alias("data"),
    )
    return docs.flatten_ratings(as_documents(rows, docs.RATINGS)).select(
        "ein", "mission_statement", "website", "charity_navigator_rating", "charity_navigator_score",
        "cn_alert_level", "facebook_url", "twitter_url",
    )


@query("facility_documents", """
SELECT l_orderkey || '-' || l_linenumber AS facility_id, 'vet_center' AS facility_type, 'Center ' || l_partkey AS org_name,
       l_suppkey || ' Main' AS street_address,
       CASE l_returnflag WHEN 'A' THEN 'New Albany' WHEN 'N' THEN 'O''Fallon' ELSE '' END AS city, 'KY' AS state,
       lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS zip_code, '' AS phone,
       CASE WHEN l_linestatus = 'O' THEN 'Care; Dental' ELSE 'Dental' END AS services_offered,
       'Yes' AS va_accredited, 'VA Vet Center' AS accreditation_details, l_discount AS lat, l_tax AS lng
FROM lineitem""")
def facility_documents(spark, sf_dir):
    """An answer page per order, a facility per line; a service is an object or a name."""
    # Lines are collected as they are and become facilities afterwards, so that the shuffle is narrow.
    lines = F.collect_list(F.struct(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount", "l_tax"))

    def facility(l):
        city = F.when(l["l_returnflag"] == "A", "new ALBANY ").when(l["l_returnflag"] == "N", "o'fallon")
        attributes = F.struct(
            F.concat(F.lit("Center "), l["l_partkey"].cast("string"), F.lit(" ")).alias("name"),
            F.struct(F.struct(
                F.concat(l["l_suppkey"].cast("string"), F.lit(" Main ")).alias("address_1"), city.alias("city"),
                F.lit(" ky").alias("state"), F.lpad(l["l_suppkey"].cast("string"), 5, "0").alias("zip"),
            ).alias("physical")).alias("address"),
            F.struct(F.when(l["l_linestatus"] == "O", F.array(F.lit('{"name":"Care"}'), F.lit("Dental")))
                     .otherwise(F.array(F.lit("Dental"))).alias("health")).alias("services"),
            l["l_discount"].alias("lat"), l["l_tax"].alias("long"),
        )
        return F.struct(
            F.concat(l["l_orderkey"].cast("string"), F.lit("-"), l["l_linenumber"].cast("string")).alias("id"),
            attributes.alias("attributes"),
        )

    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines")).select(
        F.transform("lines", facility).alias("data"))
    documents = landed(spark, pages.select(F.lit("vet_center").alias("facility_type"), "data"), docs.FACILITIES)
    return docs.flatten_facilities(documents).select(
        "facility_id", "facility_type", "org_name", "street_address", "city", "state", "zip_code", "phone",
        "services_offered", "va_accredited", "accreditation_details", "lat", "lng",
    )


@query("facility_order", """
SELECT l_orderkey || '-' || l_linenumber AS facility_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS place
FROM lineitem""")
def facility_order(spark, sf_dir):
    """Pages in another order than their numbers: facilities still follow the pages and their places there."""
    c = F.col
    facility = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", facility.alias("f")))).alias("listed"))
    rows = pages.select(
        c("l_orderkey").alias("_ord"), F.lit("vet_center").alias("facility_type"), F.transform("listed", lambda x: x["f"]).alias("data"))
    text = rows.select("_ord", F.to_json(F.struct("facility_type", "data")).alias("doc")).repartition(7, F.hash("_ord"))
    read = text.select("_ord", F.from_json("doc", docs.FACILITIES).alias("d")).select("_ord", "d.*")
    return docs.flatten_facilities(read).select("facility_id", c("_ord").alias("place"))


@query("resource_order", """
SELECT name, row_number() OVER (ORDER BY n_nationkey, spot) - 1 AS place
FROM (SELECT n_nationkey, 0 AS spot, n_name AS name FROM nation
      UNION ALL SELECT s_nationkey, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def resource_order(spark, sf_dir):
    """A list per nation: itself at the top, its suppliers in two folders, one of them without a name."""
    c = F.col
    listed = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.sort_array(F.collect_list(F.struct("s_suppkey", F.struct(c("s_name").alias("name")).alias("r")))).alias("all"))
    some = F.transform("all", lambda x: x["r"])
    half = F.floor(F.size("all") / 2).cast("int")
    folder = lambda name, rows: F.struct(name.cast("string").alias("name"), rows.alias("resources"))
    rows = table(spark, sf_dir, "nation").join(listed, c("n_nationkey") == c("s_nationkey"), "left").select(
        c("n_nationkey").cast("long").alias("_ord"), F.array(F.struct(c("n_name").alias("title"))).alias("resources"),
        F.array(folder(F.lit("first"), F.slice(some, F.lit(1), half)),
                folder(F.lit(None), F.slice(some, half + 1, F.size("all")))).alias("folders"))
    text = rows.select("_ord", F.to_json(F.struct("resources", "folders")).alias("doc")).repartition(5, F.hash("_ord"))
    read = text.select("_ord", F.from_json("doc", docs.RESOURCES).alias("d")).select("_ord", "d.*")
    return docs.flatten_resources(read).select(c("org_name").alias("name"), c("_ord").alias("place"))


def resource_sql(text: str) -> str:
    return rf"""
WITH r AS (
  SELECT 'Doc ' || doc_id AS org_name, 'https://a/' || doc_id AS website, '502' || doc_id AS phone,
         {text} AS services_offered, '' AS service_categories FROM documents WHERE lang = 'en'
  UNION ALL SELECT source || ' ' || doc_id, 'https://b/' || doc_id, '', lang || ' & co', source FROM documents)
SELECT * FROM r"""


def resources(spark, sf_dir):
    """A resource at the top and one in a folder; without a title or name it is none."""
    c = F.col
    key = c("doc_id").cast("string")
    top = F.struct(
        F.when(c("lang") == "en", F.concat(F.lit("Doc "), key, F.lit(" "))).otherwise("").alias("title"),
        F.concat(F.lit("https://a/"), key).alias("url"), F.lit("").alias("phone"),
        F.concat(F.lit("502"), key).alias("phoneNumber"), c("text").alias("description"),
    )
    filed = F.struct(
        F.concat("source", F.lit(" "), key).alias("name"), F.concat(F.lit("https://b/"), key).alias("link"),
        F.concat(F.lit("<p class='x'>"), "lang", F.lit(" &amp; co</p>")).alias("summary"),
    )
    rows = table(spark, sf_dir, "documents").select(
        F.array(top).alias("resources"),
        F.array(F.struct(c("source").alias("name"), F.array(filed).alias("resources"))).alias("folders"),
    )
    return as_documents(rows, docs.RESOURCES)


@query("resource_documents", resource_sql("text"))
def resource_documents(spark, sf_dir):
    return docs.flatten_resources(resources(spark, sf_dir)).drop("_ord")


@query("resource_documents_short", resource_sql("substr(text, 1, 500)"))
def resource_documents_short(spark, sf_dir):
    return docs.flatten_resources(resources(spark, sf_dir), text_limit=500).drop("_ord")
