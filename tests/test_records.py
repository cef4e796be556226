"""Classification, coercion, scoring and filters on hand-made records."""

import itertools
import json
import statistics

import pytest

from rosterline import fixed
from rosterline.operators import filters
from rosterline.operators.aggregate import distinct_count, exact_median
from rosterline.operators.classify import classify, classify_counts
from rosterline.operators.coerce import SCHEMA, coerce_schema, empty_records, rename_first_alias, tag_source
from rosterline.operators.score import completeness, detail_json, display_tier, finish, grade, group_rows


def records(spark, rows):
    """Canonical records from dicts of the columns that have a value."""
    names = [f.name for f in SCHEMA.fields]
    return spark.createDataFrame(
        [(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)], "_ord long, " + ", ".join(
            f"{n} {t}" for n, t in fixed.COLUMNS)
    )


def test_classification(spark):
    rows = [
        ("W30", "03", "plain"), (" W30", "03", "plain"), (None, " 19 ", "plain"), ("A", "03", "David Fund"),
        ("W30", "19", "Happy Vet Clinic veterans"), (None, None, None), ("A", "03", "Salvation Army"),
    ]
    df = spark.createDataFrame(rows, "NTEE_CD string, SUBSECTION string, NAME string")
    assert [r.NAME for r in classify(df).collect()] == ["plain", "plain", "David Fund"]
    assert classify_counts(df).first().asDict() == {
        "by_code": 2, "by_subsection": 2, "by_keyword": 3, "excluded": 2, "kept": 3}


def test_coercion(spark):
    df = spark.createDataFrame([(1, "x", "12", float("nan"))], "_ord int, org_name string, total_revenue string, total_assets double")
    out = coerce_schema(df, keep=("_ord",))
    assert out.columns == ["_ord"] + [n for n, _ in fixed.COLUMNS]
    row = out.first()
    assert (row.org_name, row.total_revenue, row.total_assets, row.ein) == ("x", 12.0, None, None)
    assert empty_records(spark).schema == SCHEMA


def test_first_alias(spark):
    df = spark.createDataFrame([("1", None, "n")], "FEIN string, TOTAL_REVENUE string, NAME string")
    out = rename_first_alias(df, fixed.FILING_ALIASES)
    assert out.columns == ["ein", "org_name", "total_revenue"]


def test_source_tag(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("a;nrd",)], "data_sources string")
    assert [r.data_sources for r in tag_source(df, "nrd", "2024-01-01").collect()] == ["nrd", "nrd", "a;nrd", "a;nrd"]


FULL = {
    "org_name": "n", "ein": "1", "city": "c", "state": "KY", "total_revenue": 1.0, "phone": "p", "ntee_code": "W",
    "va_accredited": "Yes",
}


@pytest.mark.parametrize("gone,letter", [
    ((), "A"), (("phone",), "B"), (("va_accredited",), "B"), (("phone", "ntee_code"), "C"),
    (("total_revenue",), "C"), (("total_revenue", "ntee_code"), "D"), (("ein",), "F"), (("city",), "F"),
    (("va_accredited", "ntee_code"), "C"),
])
def test_grades(spark, gone, letter):
    row = {k: v for k, v in FULL.items() if k not in gone}
    assert records(spark, [row]).select(grade()).first()[0] == letter


def test_no_flag_and_no_rating_is_not_rated(spark):
    """A missing flag counts as not accredited."""
    row = {**FULL, "va_accredited": None, "ntee_code": None}
    assert records(spark, [row]).select(grade()).first()[0] == "C"


def test_completeness(spark):
    rows = [{}, {"org_name": "  ", "ein": ""}, {"org_name": "x", "ein": "1", "total_revenue": 0.0},
            {c: ("x" if t == "string" else 1.0) for c, t in fixed.COLUMNS}]
    got = [r[0] for r in records(spark, rows).orderBy("_ord").select(completeness()).collect()]
    assert got == [0.0, 0.0, 0.23, 1.0]


def test_more_fields_never_lower_the_score(spark):
    columns = list(fixed.WEIGHTS)
    kinds = dict(fixed.COLUMNS)
    rows, row = [], {}
    for c in columns:
        row = {**row, c: "x" if kinds[c] == "string" else 1.0}
        rows.append(row)
    scores = [r[0] for r in records(spark, rows).orderBy("_ord").select(completeness()).collect()]
    assert all(a < b for a, b in itertools.pairwise(scores)) and scores[-1] == 1.0


def test_detail(spark):
    row = {**FULL, "data_sources": "irs_bmf;va_vso;charity_nav"}
    detail = json.loads(records(spark, [row]).select(detail_json()).first()[0])
    assert detail["grade"] == "A"
    assert list(detail["groups"]) == [g[0] for g in fixed.FIELD_GROUPS]
    assert detail["groups"]["contact"] == {"filled": 1, "total": 3, "source": "va_vso"}
    assert detail["groups"]["ratings"]["source"] == "charity_nav"
    assert detail["groups"]["financials"]["source"] == "propublica"
    assert detail["groups"]["personnel"] == {"filled": 0, "total": 2, "source": "propublica / nrd"}


def test_group_bands(spark):
    rows = {r.field_group: (r.percent, r.band) for r in group_rows(records(spark, [FULL])).collect()}
    assert rows["identity"] == (67, "medium") and rows["contact"] == (33, "low")
    assert rows["social"] == (0, "none") and rows["location"] == (50, "medium")


def test_tiers(spark):
    df = spark.createDataFrame([(g,) for g in ("A", "B", "C", "D", "F", "?", None)], "confidence_grade string")
    assert [r[0] for r in df.select(display_tier()).collect()] == [
        "Enriched", "Enriched", "Baseline", "Partial", "Partial", "Partial", "Partial"]


def test_finish(spark):
    row = finish(records(spark, [FULL]), "2024-01-01T00:00:00").first()
    assert (row.confidence_grade, row.annual_revenue_range, row.record_last_updated) == (
        "A", "Under $50K", "2024-01-01T00:00:00")


def test_filters(spark):
    df = records(spark, [
        {"org_name": "Aid (KY)", "va_accredited": "Yes", "phone": "  ", "total_revenue": 50_000.0},
        {"org_name": "Other", "va_accredited": "No", "phone": "1", "city": "Aidville"},
        {"org_name": None, "total_revenue": 50_000.5},
    ])
    ids = lambda spec: [r._ord for r in spec.apply(df).orderBy("_ord").collect()]
    spec = filters.FilterSpec
    assert ids(spec()) == [0, 1, 2]
    assert ids(spec(text="aid")) == [0, 1] and ids(spec(text="(ky)")) == [0]
    assert ids(spec(text="a.d", regex=True)) == [0, 1]
    assert ids(spec(accredited=False)) == [1, 2] and ids(spec(accredited=True)) == [0]
    assert ids(spec(has_contact=True)) == [1]
    assert ids(spec(revenue="Under $50K")) == [0] and ids(spec(revenue="$50K–$500K")) == [0, 2]


def test_state_share_of_nothing(spark):
    assert filters.state_share(records(spark, []), "KY").first().asDict() == {"matched": 0, "total": 0, "percent": 0.0}


def test_lookup_takes_the_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "_ord int, ein string")
    assert filters.lookup(df, "ein", "a").collect()[0]._ord == 1


def test_needs_enrichment(spark):
    df = records(spark, [{"website": "w"}, {"website": "w", "email": "e", "facebook_url": "f", "twitter_url": "t"}, {}])
    assert [r._ord for r in df.filter(filters.needs_enrichment()).collect()] == [0]


@pytest.mark.parametrize("values", [
    [], [None, float("nan")], [3.0], [3.0, 1.0], [1.0] * 500, [1.0] * 300 + [2.0] * 300, [1.0] * 299 + [2.0] * 301,
    [float(i * i % 977) for i in range(3001)], [1e300, -1e300, 1e-300, 0.0] * 400 + [5.0], [float(2 ** (i % 900)) for i in range(2000)],
    [1.0] * 900 + [float("inf")] * 1100, [-float("inf")] * 1000 + [7.0, 8.0] + [9.0] * 1000])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
    known = sorted(v for v in values if v is not None and v == v)
    want = statistics.median(known) if known else None
    for few, accuracy in ((10_000, 10_000), (20, 50), (1, 40)):
        assert exact_median(df, "x", few, accuracy) == want


def test_distinct_count(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b"), (5, "")], "i int, x string")
    assert distinct_count(df, "x", "n").collect() == [(3,)] and distinct_count(df.filter("i = 0"), "x", "n").collect() == [(0,)]
