"""Queries that write tables to the shared folder and read them back through the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rosterline import fixed
from rosterline.catalog.frame import UPDATED_AT, directory, over_directory
from rosterline.catalog.registry import query, table
from rosterline.operators.coerce import row_order
from rosterline.operators.merge import first_rows
from rosterline.plans import views
from rosterline.plans.directory import Inputs, build_directory
from rosterline.session import shared_folder
from rosterline.sources import export
from rosterline.sources.stages import Stages
from rosterline.sources.tabular import map_filings, map_master, read_directory, read_text_csv
from rosterline.sources.web import read_sitemap


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


# --- master files ---------------------------------------------------------------------------------------

def master_rows(spark, sf_dir):
    """Customers as rows of a master extract."""
    c = F.col
    return table(spark, sf_dir, "customer").select(
        F.lpad(c("c_custkey").cast("string"), 9, "0").alias("EIN"), c("c_name").alias("NAME"),
        F.concat(c("c_mktsegment"), F.lit(" VETERANS")).alias("SORT_NAME"), c("c_mktsegment").alias("CITY"),
        F.lit(" ky").alias("STATE"), F.concat(F.lpad(c("c_custkey").cast("string"), 5, "0"), F.lit("-123456")).alias("ZIP"),
        F.when(c("c_nationkey") % 2 == 0, "19").otherwise("03").alias("SUBSECTION"),
        F.concat(F.lit("W"), c("c_nationkey").cast("string")).alias("NTEE_CD"),
        c("c_acctbal").cast("string").alias("REVENUE_AMT"), F.lit("n/a").alias("ASSET_AMT"))


def master_files(spark, sf_dir) -> list[str]:
    """Two folders with other columns in another order; the second repeats some keys."""
    folder = new_folder(spark)
    rows = master_rows(spark, sf_dir)
    rows.repartition(4, "EIN").write.option("header", True).option("escape", '"').csv(f"{folder}/a")
    again = rows.filter("EIN % 3 = 0").select("NAME", "EIN", F.lit("second").alias(" sort_name "), "SUBSECTION")
    again.repartition(3, "EIN").write.option("header", True).option("escape", '"').csv(f"{folder}/b")
    return [f"{folder}/a", f"{folder}/b"]


def many_files(spark, sf_dir, files: int = 200) -> str:
    """A folder of up to ``files`` files in as many folders, of different sizes and with three headers in turn."""
    folder = new_folder(spark)
    # The square of a key from 46,341 on is beyond an int.
    number = F.col("EIN").cast("long")
    rows = master_rows(spark, sf_dir).withColumn("part", F.format_string("%03d", number * number % files))
    sorted_ = rows.repartition(8, "part").sortWithinPartitions("part", "EIN")
    for turn, columns in enumerate((("EIN", "NAME", "NTEE_CD"), ("NTEE_CD", "EIN", "CITY"), ("NAME", "NTEE_CD", "ZIP", "EIN"))):
        sorted_.filter(F.col("part").cast("int") % 3 == turn).select("part", *columns).write.mode("append").partitionBy(
            "part").option("header", True).option("escape", '"').csv(folder)
    return folder


_MASTER_SQL = """SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS ein,
  array_to_string(list_transform(string_split(c_name, '#'), lambda w: upper(w[1]) || lower(w[2:])), '#') AS org_name,
  {alt} AS org_name_alt, {city} AS city, {state} AS state, {zip} AS zip_code,
  CASE WHEN c_nationkey % 2 = 0 THEN '501(c)(19)' ELSE '501(c)(3)' END AS org_type, {ntee} AS ntee_code, {revenue} AS total_revenue
  FROM customer"""
_FIRST_FILE = _MASTER_SQL.format(
    alt="upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Veterans'", city="upper(c_mktsegment[1]) || lower(c_mktsegment[2:])",
    state="'KY'", zip="lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '-123456'", ntee="'W' || c_nationkey", revenue="c_acctbal")
_SECOND_FILE = _MASTER_SQL.format(alt="'Second'", city="NULL", state="NULL", zip="NULL", ntee="NULL", revenue="CAST(NULL AS DOUBLE)")
_MASTER = ("ein", "org_name", "org_name_alt", "city", "state", "zip_code", "org_type", "ntee_code", "total_revenue")


@query("master_files", f"{_FIRST_FILE} UNION ALL {_SECOND_FILE} WHERE c_custkey % 3 = 0")
def master_from_files(spark, sf_dir):
    return map_master(read_text_csv(spark, master_files(spark, sf_dir))).select(*_MASTER)


@query("master_files_short_zip", f"SELECT ein, substr(zip_code, 1, 10) AS zip_code FROM ({_FIRST_FILE} UNION ALL {_SECOND_FILE} WHERE c_custkey % 3 = 0)")
def master_short_zip(spark, sf_dir):
    return map_master(read_text_csv(spark, master_files(spark, sf_dir)), zip_length=10).select("ein", "zip_code")


@query("master_first_rows", _FIRST_FILE)
def master_first_rows(spark, sf_dir):
    """The first row of each key, in the order of the files."""
    return map_master(first_rows(read_text_csv(spark, master_files(spark, sf_dir)), "EIN")).select(*_MASTER)


@query("master_many_files", """
SELECT 'W' || c_nationkey AS ntee_code, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS ein, part % 3 <> 1 AS has_name
FROM (SELECT *, c_custkey * c_custkey % 200 AS part FROM customer)
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY part, c_custkey) = 1""")
def master_many_files(spark, sf_dir):
    """The first row of each category in the order of 200 files."""
    rows = read_text_csv(spark, [many_files(spark, sf_dir)])
    return first_rows(rows, "NTEE_CD").select(
        F.col("NTEE_CD").alias("ntee_code"), F.col("EIN").alias("ein"), F.col("NAME").isNotNull().alias("has_name"))


@query("filing_extract", """
SELECT lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS ein, o_orderpriority AS mission_statement, CAST(o_orderkey AS VARCHAR) AS num_employees
FROM orders""")
def filing_extract(spark, sf_dir):
    folder = new_folder(spark)
    table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("ORG_EIN"), F.col("o_orderpriority").alias("MISSION_DESC"),
        F.col("o_orderkey").alias("EMPLOYEECNT"), "o_orderstatus",
    ).write.option("header", True).csv(folder)
    return map_filings(read_text_csv(spark, [folder])).select("ein", "mission_statement", "num_employees")


# --- the finished directory, views and reports -----------------------------------------------------------

_STORED = ("ein", "org_name", "state", "city", "total_revenue", "confidence_score", "confidence_grade", "services_offered")


@query("directory_file", over_directory(
    "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" if c in ("ein", "org_name") else c for c in _STORED) + " FROM dir"))
def directory_file(spark, sf_dir):
    """Written as CSV with a byte order mark and read back; empty text and null are one in CSV."""
    folder = new_folder(spark)
    export.write_directory(directory(spark, sf_dir), folder)
    return read_directory(spark, folder, multi_line=True).select(*_STORED)


@query("view_file", over_directory("SELECT org_name, nullif(ein, '') AS ein, state FROM dir WHERE state = 'KY'"))
def view_file(spark, sf_dir):
    folder = new_folder(spark)
    view = directory(spark, sf_dir).filter("state = 'KY'").select("_ord", "org_name", "ein", "state")
    export.write_views({"local": view}, folder)
    return read_directory(spark, f"{folder}/local").select("org_name", "ein", "state")


@query("report_file", over_directory("SELECT 'directory  organizations  ' || printf('%.3f', CAST(count(*) AS DOUBLE)) AS line FROM dir"))
def report_file(spark, sf_dir):
    """A report written as text; one of its lines."""
    folder = new_folder(spark)
    export.write_report(views.directory_report(directory(spark, sf_dir)), folder)
    return spark.read.text(folder).select(F.col("value").alias("line")).filter(F.col("line").startswith("directory  organizations  "))


@query("sitemap_file", "SELECT url FROM pages")
def sitemap_file(spark, sf_dir):
    folder = new_folder(spark)
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit(" "), "url", F.lit("\n")).alias("loc"))
    pages.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(folder)
    return read_sitemap(spark, folder)


# --- stages -------------------------------------------------------------------------------------------------

def _stages(spark, **options) -> Stages:
    return Stages(spark, new_folder(spark), **options)


@query("stage_resumed", "SELECT c_custkey, c_name FROM customer")
def stage_resumed(spark, sf_dir):
    """A stage written once and read back by a later run that must not compute it."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    first = _stages(spark)
    first.stage("customers", lambda: customers)

    def never():
        raise AssertionError("computed again")

    return Stages(spark, first.folder, resume=True).stage("customers", never)


@query("stage_renewed", "SELECT c_custkey, upper(c_name) AS c_name FROM customer WHERE c_custkey % 2 = 0")
def stage_renewed(spark, sf_dir):
    """Two stages whose input changes between two runs: both are computed again; an unchanged third run reads them."""
    source = new_folder(spark)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    folder = new_folder(spark)
    calls = []

    def run():
        rows = spark.read.parquet(source)
        stages = Stages(spark, folder, resume=True)
        first = stages.stage("copied", lambda: calls.append("copied") or rows, inputs=[rows])
        upper = lambda: calls.append("upper") or first.withColumn("c_name", F.upper("c_name"))
        return stages.stage("upper", upper, inputs=[first], rule="upper case")

    customers.filter("c_custkey % 3 = 0").write.parquet(source)
    run()
    customers.filter("c_custkey % 2 = 0").write.mode("overwrite").parquet(source)
    run()
    renewed = run()
    if calls != ["copied", "upper"] * 2:
        raise AssertionError(f"stages computed: {calls}")
    return renewed


@query("stage_skipped", "SELECT c_custkey, c_name FROM customer")
def stage_skipped(spark, sf_dir):
    """A skipped transform passes its input on."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return _stages(spark, run=()).stage("renamed", lambda: customers.limit(0), otherwise=lambda: customers)


def _inputs(spark, sf_dir) -> Inputs:
    c = F.col
    master = read_text_csv(spark, master_files(spark, sf_dir))
    ratings = table(spark, sf_dir, "labels").select(
        row_order().alias("_ord"), F.concat(F.substring(F.lpad(c("doc_id").cast("string"), 9, "0"), 1, 2), F.lit("-"),
                                            F.substring(F.lpad(c("doc_id").cast("string"), 9, "0"), 3, 7)).alias("ein"),
        (c("quality") * 4.0).alias("charity_navigator_rating"))
    listed = table(spark, sf_dir, "supplier").select(
        row_order().alias("_ord"), c("s_name").alias("org_name"), F.concat(F.lit("https://s"), c("s_suppkey").cast("string"), F.lit(".org")).alias("website"))
    return Inputs(master, {"charity_nav": ratings}, {"va_vso": listed})


_RATED = """rated AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS k, min_by(quality * 4.0, doc_id) FILTER (quality IS NOT NULL) AS rating
                      FROM labels GROUP BY doc_id)"""


@query("partial_build", f"""
WITH m AS ({_FIRST_FILE}), {_RATED}
SELECT substr(ein, 1, 2) || '-' || substr(ein, 3) AS ein, org_name, CAST(rating AS DOUBLE) AS charity_navigator_rating
FROM m LEFT JOIN rated ON k = ein
UNION ALL SELECT NULL, array_to_string(list_transform(string_split(s_name, '#'), lambda w: upper(w[1]) || lower(w[2:])), '#'), NULL FROM supplier""")
def partial_build(spark, sf_dir):
    """All stages but the resolution; keyed rows fill in over hyphenated keys."""
    stages = _stages(spark, run=("base", "charity_nav", "va_vso", "merged"))
    built = build_directory(_inputs(spark, sf_dir), "2024-01-01", UPDATED_AT, stages=stages)
    return built.select("ein", "org_name", "charity_navigator_rating")


@query("build_without_sources", f"""
WITH m AS ({_FIRST_FILE}) SELECT substr(ein, 1, 2) || '-' || substr(ein, 3) AS ein, org_name, 'irs_bmf' AS data_sources FROM m""")
def build_without_sources(spark, sf_dir):
    """Skipped sources, merge and resolution: the base goes straight to the end."""
    built = build_directory(_inputs(spark, sf_dir), "2024-01-01", UPDATED_AT, stages=_stages(spark, run=("base",)))
    return built.select("ein", "org_name", "data_sources")
