"""JSON sources, read with a schema and flattened to canonical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterline.functions.blanks import none_if_empty, strip, to_number
from rosterline.functions.clean import PERSON, people_json, title_case
from rosterline.functions.contact import visible_text
from rosterline.operators.coerce import row_order, with_room

FINANCIALS = (
    "ein string, status int, organization struct<name:string,city:string,state:string,"
    "ntee_code:string,number_of_forms_filed:string>, filings_with_data array<struct<"
    "totrevenue:string,totfuncexpns:string,totassetsend:string,totliabend:string,"
    f"totnetassetend:string,tax_prd:string,officers:{PERSON}>>"
)
RATINGS = (
    "ein string, data struct<organizationByEIN:struct<name:string,ein:string,mission:string,"
    "websiteURL:string,currentRating:struct<score:string,rating:string>,"
    "advisories:array<struct<severity:string,description:struct<text:string>>>,"
    "socialMedia:struct<facebookProfileUrl:string,twitterHandle:string,linkedinUrl:string,"
    "instagramHandle:string,youtubeUrl:string>>>"
)
FACILITIES = (
    "facility_type string, data array<struct<id:string,attributes:struct<name:string,website:string,"
    "address:struct<physical:struct<address_1:string,address_2:string,city:string,state:string,"
    "zip:string>>,phone:struct<main:string>,hours:map<string,string>,"
    "services:struct<health:array<string>>,lat:double,long:double>>>"
)
_RESOURCE = (
    "title:string,name:string,url:string,website:string,link:string,description:string,"
    "summary:string,phone:string,phoneNumber:string"
)
RESOURCES = (
    f"resources array<struct<{_RESOURCE}>>, folders array<struct<name:string,"
    f"resources:array<struct<{_RESOURCE}>>>>"
)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per line, with the row order of the scan."""
    return spark.read.schema(schema).json(path).withColumn("_ord", row_order())


def flatten_financials(docs: DataFrame, officers_limit: int | None = None) -> DataFrame:
    """One row per key from the latest filing, the first of its list; documents not found go.

    ``officers_limit`` keeps only the first officers.
    """
    if "status" in docs.columns:
        docs = docs.filter(F.coalesce(F.col("status"), F.lit(200)) != 404)
    latest = F.get(F.col("filings_with_data"), F.lit(0))
    listed = latest["officers"] if officers_limit is None else F.slice(latest["officers"], 1, officers_limit)
    officers = F.transform(listed, lambda o: F.struct(
        F.coalesce(o["name"], F.lit("")).alias("name"), F.coalesce(o["title"], F.lit("")).alias("title"),
        o["compensation"].alias("compensation"),
    ))
    return docs.select(
        "_ord", "ein",
        to_number(F.col("organization.number_of_forms_filed")).alias("num_employees"),
        to_number(latest["totrevenue"]).alias("total_revenue"),
        to_number(latest["totfuncexpns"]).alias("total_expenses"),
        to_number(latest["totassetsend"]).alias("total_assets"),
        to_number(latest["totliabend"]).alias("total_liabilities"),
        to_number(latest["totnetassetend"]).alias("net_assets"),
        people_json(officers).alias("key_personnel"),
    )


def flatten_ratings(docs: DataFrame) -> DataFrame:
    """Rating, alert, mission and profiles per key; documents without an organisation go."""
    org = F.col("data.organizationByEIN")
    social = org["socialMedia"]

    def profile(prefix: str, handle: Column) -> Column:
        return F.concat(F.lit(prefix), none_if_empty(handle))

    return docs.filter(org.isNotNull()).select(
        "_ord", "ein",
        org["mission"].alias("mission_statement"),
        org["websiteURL"].alias("website"),
        to_number(org["currentRating"]["rating"]).alias("charity_navigator_rating"),
        to_number(org["currentRating"]["score"]).alias("charity_navigator_score"),
        F.get(org["advisories"], F.lit(0))["severity"].alias("cn_alert_level"),
        social["facebookProfileUrl"].alias("facebook_url"),
        profile("https://twitter.com/", social["twitterHandle"]).alias("twitter_url"),
        social["linkedinUrl"].alias("linkedin_url"),
        profile("https://instagram.com/", social["instagramHandle"]).alias("instagram_url"),
        social["youtubeUrl"].alias("youtube_url"),
    )


def elements(docs: DataFrame, listed: Column) -> tuple[DataFrame, Column]:
    """One row per element ``e`` of a list, with the columns of its document, and the element's number.

    Numbers follow the documents' ``_ord`` and the places in the list, also after a repartition. Documents
    without ``_ord`` give numbers in the order of the scan.
    """
    docs = docs.withColumn("_list", listed)
    if "_ord" not in docs.columns:
        return docs.select(*docs.columns, F.explode("_list").alias("e")).drop("_list"), row_order()
    rows = with_room(docs, F.greatest(F.size("_list"), F.lit(0)))
    rows = rows.select(*rows.columns, F.posexplode("_list").alias("_place", "e")).drop("_list")
    return rows, F.col("_start") + F.col("_place")


def service_name(entry: Column) -> Column:
    """A service is an object with a name, or the name itself."""
    return F.when(F.startswith(entry, F.lit("{")), F.coalesce(F.get_json_object(entry, "$.name"), F.lit(""))
                  ).otherwise(entry)


def flatten_facilities(pages: DataFrame) -> DataFrame:
    """One row per facility of each answer page, in page order, with its services as one text."""
    rows, number = elements(pages, F.col("data"))
    a = F.col("e.attributes")
    place = a["address"]["physical"]
    kind = title_case(F.replace(F.col("facility_type"), F.lit("_"), F.lit(" ")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        number.alias("_ord"),
        F.col("e.id").alias("facility_id"), "facility_type",
        strip(empty(a["name"])).alias("org_name"),
        strip(empty(place["address_1"])).alias("street_address"),
        empty(place["address_2"]).alias("street_address_2"),
        title_case(strip(empty(place["city"]))).alias("city"),
        F.upper(strip(empty(place["state"]))).alias("state"),
        strip(empty(place["zip"])).alias("zip_code"),
        F.lit("US").alias("country"),
        empty(a["phone"]["main"]).alias("phone"),
        empty(a["website"]).alias("website"),
        empty(F.array_join(F.transform(a["services"]["health"], service_name), "; "))
        .alias("services_offered"),
        F.lit("VA Facility").alias("org_type"),
        F.lit("Yes").alias("va_accredited"),
        F.concat(F.lit("VA "), kind).alias("accreditation_details"),
        a["lat"].alias("lat"), a["long"].alias("lng"),
    )


def first_text(*fields: Column) -> Column:
    """The first of the fields that has text, else the empty text."""
    return F.coalesce(*[none_if_empty(f) for f in fields], F.lit(""))


def flatten_resources(docs: DataFrame, text_limit: int | None = None) -> DataFrame:
    """Resources at the top and then in folders, the folder's name as category; the unnamed go.

    ``text_limit`` keeps only so many characters of a description.
    """
    def filed(category: Column, listed: Column) -> Column:
        return F.coalesce(F.transform(listed, lambda r: F.struct(category.alias("category"), r.alias("r"))), F.array())

    foldered = F.flatten(F.transform("folders", lambda f: filed(F.coalesce(f["name"], F.lit("")), f["resources"])))
    rows, number = elements(docs, F.concat(filed(F.lit(""), F.col("resources")), F.coalesce(foldered, F.array())))
    r = lambda *names: first_text(*[F.col(f"e.r.{n}") for n in names])
    about = r("description", "summary")
    about = F.when(F.contains(about, F.lit("<")), visible_text(about)).otherwise(about)
    return rows.filter(r("title", "name") != "").select(
        number.alias("_ord"),
        strip(r("title", "name")).alias("org_name"),
        strip(r("url", "website", "link")).alias("website"),
        strip(r("phone", "phoneNumber")).alias("phone"),
        (about if text_limit is None else F.substring(about, 1, text_limit)).alias("services_offered"),
        F.col("e.category").alias("service_categories"),
    )
