"""Landed web documents as rows: HTML tables and sitemaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterline.functions.blanks import none_if_empty, strip
from rosterline.functions.clean import slug_to_name, title_case
from rosterline.functions.contact import cell_text
from rosterline.operators.aggregate import attach, group_people
from rosterline.operators.coerce import row_order, with_room

DETAIL_URL = r"/resource/detail/(\d+)/(.+?)$"


def _element(tags: Sequence[str]) -> str:
    return rf"(?is)<(?:{'|'.join(tags)})\b[^>]*>(.*?)</(?:{'|'.join(tags)})>"


def _inner(html: Column, tags: Sequence[str]) -> Column:
    return F.regexp_extract_all(html, F.lit(_element(tags)), F.lit(1))


def table_rows(
    pages: DataFrame,
    keep: Sequence[str],
    container: str = "table",
    row: str = "tr",
    header_cells: Sequence[str] = ("th", "td"),
    cells: Sequence[str] = ("td",),
    header: bool = True,
    min_cells: int = 3,
) -> DataFrame:
    """Rows of the first table of each page: ``row_no``, ``headers`` and ``cells`` as text arrays.

    The first row gives the headers, lower-cased with ``_`` for blanks. Rows with fewer than
    ``min_cells`` cells go. Other tags may play table, row and cell.
    """
    first = F.regexp_extract("html", _element([container]), 1)
    tables = pages.select(*keep, _inner(first, [row]).alias("_rows"))
    name = lambda c: F.replace(F.lower(cell_text(c)), F.lit(" "), F.lit("_"))
    headers = F.transform(_inner(F.get("_rows", F.lit(0)), header_cells), name) if header else F.array().cast("array<string>")
    body = F.slice("_rows", 2 if header else 1, F.greatest(F.size("_rows"), F.lit(1)))
    # Headers and rows part ways before the rows spread, so that no row carries the whole table.
    split = tables.select(*keep, headers.alias("headers"), body.alias("_body"))
    rows = split.select(*keep, "headers", F.posexplode("_body").alias("row_no", "_row"))
    values = F.transform(_inner(F.col("_row"), cells), cell_text)
    return rows.select(*keep, "row_no", "headers", values.alias("cells")).filter(F.size("cells") >= min_cells)


def cell(name: str, position: int) -> Column:
    """A row's cell by header name, else by position, else the empty text."""
    by_name = F.get(F.col("cells"), (F.array_position("headers", F.lit(name)) - 1).cast("int"))
    named = F.when(F.array_contains("headers", name), by_name)
    return F.coalesce(none_if_empty(named), none_if_empty(F.get(F.col("cells"), F.lit(position))), F.lit(""))


def _ordered_rows(pages: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, Column]:
    """Table rows and their numbers: by the pages' ``_ord`` and the place in the table, also after a
    repartition; in the order of the scan when pages have no ``_ord``."""
    if "_ord" not in pages.columns:
        return table_rows(pages, keep), row_order()
    # A page has no more rows than characters; counting them would search every page twice.
    roomy = with_room(pages.select("_ord", "html", *(c for c in keep if c not in ("_ord", "html"))), F.length("html"))
    rows = table_rows(roomy, ["_start", *(c for c in keep if c != "_ord")])
    return rows, F.col("_start") + F.col("row_no")


def accredited_organizations(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The accreditation table: one row per organisation and representative."""
    rows, number = _ordered_rows(pages, keep)
    rep = cell("representative", 5)
    out = rows.select(
        number.alias("_ord"), *(c for c in keep if c != "_ord"),
        cell("organization_name", 0).alias("org_name"),
        cell("org_city", 3).alias("city"), cell("org_state", 4).alias("state"),
        F.lit("").alias("zip_code"), cell("org_phone", 2).alias("phone"),
        rep.alias("representative_name"),
        F.when(rep != "", F.concat(F.lit("VA-Accredited VSO; Rep: "), rep))
        .otherwise("VA-Accredited VSO").alias("accreditation_details"),
    )
    return out.filter(F.col("org_name") != "")


def searched_organizations(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The fallback listing: name, city, state, ZIP, phone by position; it knows no representatives."""
    rows, number = _ordered_rows(pages, keep)
    at = lambda i: F.coalesce(F.get(F.col("cells"), F.lit(i)), F.lit(""))
    out = rows.select(
        number.alias("_ord"), *(c for c in keep if c != "_ord"), at(0).alias("org_name"), at(1).alias("city"), at(2).alias("state"),
        at(3).alias("zip_code"), at(4).alias("phone"), F.lit(None).cast("string").alias("representative_name"),
        F.lit("VA-Accredited VSO").alias("accreditation_details"),
    )
    return out.filter(F.col("org_name") != "")


def map_accredited(rows: DataFrame, order: str = "_ord") -> DataFrame:
    """Accredited rows to the canonical record, with all of an organisation's people on each row.

    Rows of a listing without representatives have no people, not an empty list.
    """
    people = group_people(rows, "org_name", "representative_name", "VSO Representative", order)
    return attach(rows, people, "org_name").select(
        order,
        title_case(strip(F.col("org_name"))).alias("org_name"),
        title_case(strip(F.col("city"))).alias("city"),
        F.upper(strip(F.col("state"))).alias("state"),
        "zip_code", "phone", F.lit("Yes").alias("va_accredited"), "accreditation_details",
        F.when(F.col("representative_name").isNotNull(), F.col("key_personnel")).alias("key_personnel"),
    )


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """The ``loc`` of each ``<url>`` of landed sitemaps."""
    df = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    return df.select(strip(F.col("loc")).alias("url"))


def sitemap_resources(urls: DataFrame, pattern: str = DETAIL_URL) -> DataFrame:
    """Distinct detail addresses with their number and a name from the slug."""
    found = urls.select("url").filter(F.col("url").rlike(pattern)).dropDuplicates()
    return found.select(
        slug_to_name(F.regexp_extract("url", pattern, 2)).alias("org_name"),
        F.col("url").alias("website"),
        F.regexp_extract("url", pattern, 1).alias("resource_id"),
        F.lit("").alias("services_offered"),
        F.lit("NRD Resource").alias("service_categories"),
    )
