"""Merges and update-backs on hand-made rows."""

from pyspark.sql import functions as F

from rosterline.functions.clean import digits
from rosterline.operators import merge
from rosterline.operators.coerce import empty_records

BASE = "_ord long, ein string, org_name string, city string, data_sources string"
ROWS = [
    (0, "1", "Kept", "", "irs_bmf"), (1, "2", "", None, "irs_bmf"), (2, None, None, "x", None),
    (3, "1", None, None, ""), (4, "9", "", "y", "irs_bmf"),
]
SOURCE = [(5, "1", "Late", "Late", "pp"), (1, "1", "First", None, "pp;irs_bmf"), (2, "2", None, "c2", None),
          (3, None, "Null", "Null", "pp"), (4, "7", "Unknown", "u", "pp")]


def filled(spark, **options):
    base, source = spark.createDataFrame(ROWS, BASE), spark.createDataFrame(SOURCE, BASE)
    return [tuple(r) for r in merge.fill_blanks(base, source, **options).orderBy("_ord").collect()]


def test_fill_blanks(spark):
    assert filled(spark) == [
        (0, "1", "Kept", None, "irs_bmf;pp"),  # an empty text takes the first source row's null
        (1, "2", None, "c2", "irs_bmf"),
        (2, None, None, "x", None),  # keys that are null never match
        (3, "1", "First", None, "irs_bmf;pp"),
        (4, "9", None, "y", "irs_bmf"),
    ]


def test_first_nonblank_lineage(spark):
    assert [r[4] for r in filled(spark, lineage="first_nonblank")] == ["irs_bmf", "irs_bmf", None, "pp;irs_bmf", "irs_bmf"]


def test_only_listed_columns_take_part(spark):
    assert [r[2] for r in filled(spark, columns=["city"])] == ["Kept", "", None, None, ""]


def test_filled_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "a int, b string, c string")
    assert merge.filled_columns(df, ["a", "b", "c"]) == ["a", "c"]


def test_key_normalizer(spark):
    base = spark.createDataFrame([(0, "12-3456789", None)], "_ord long, ein string, city string")
    source = spark.createDataFrame([(0, "123456789", "c")], "_ord long, ein string, city string")
    assert merge.fill_blanks(base, source).first().city is None
    row = merge.fill_blanks(base, source, key_normalizer=digits).first()
    assert (row.ein, row.city) == ("12-3456789", "c")


def test_merge_sources_order_and_empty(spark):
    frame = lambda rows: spark.createDataFrame(rows, "_ord long, ein string, city string, data_sources string")
    base = frame([(0, "1", None, "b"), (1, "2", None, "b")])
    keyed = {"first": frame([(0, "1", "one", "f")]), "none": empty_records(spark).withColumn("_ord", F.lit(1).cast("long")),
             "second": frame([(0, "1", "two", "s"), (1, "2", "two", "s")])}
    others = {"rows": frame([(7, None, "z", "r")])}
    got = merge.merge_sources(base, keyed, others).orderBy("_ord").select("_ord", "city", "data_sources").collect()
    assert [tuple(r) for r in got] == [(0, "one", "b;f;s"), (1, "two", "b;s"), (7, "z", "r")]


def test_row_count_is_kept_under_a_hot_key(spark):
    base = spark.range(3000).selectExpr(
        "id as _ord", "case when id % 3 = 0 then null when id % 3 = 1 then 'hot' else string(id) end as ein",
        "cast(null as string) as city")
    source = spark.range(5000).selectExpr("id as _ord", "if(id < 2500, 'hot', string(id)) as ein", "string(id) as city")
    out = merge.fill_blanks(base, source)
    assert out.count() == 3000
    assert out.filter("ein = 'hot'").select("city").distinct().collect()[0].city == "0"


def test_keys_in_two_spellings_meet(spark):
    base = spark.createDataFrame([(0, "123456789", None)], "_ord long, ein string, phone string")
    source = spark.createDataFrame([(0, "12-3456789", "555")], "_ord long, ein string, phone string")
    assert merge.fill_blanks(base, source).first().phone is None
    assert merge.fill_blanks(base, source, key_normalizer=merge.digits).first().phone == "555"


def test_null_keys_match_only_when_asked(spark):
    base = spark.createDataFrame([(0, None, None), (1, "a", None)], "_ord long, ein string, phone string")
    source = spark.createDataFrame([(0, None, "n"), (1, None, "m"), (2, "a", "x")], "_ord long, ein string, phone string")
    got = lambda **o: [r.phone for r in merge.fill_blanks(base, source, **o).orderBy("_ord").collect()]
    assert got() == [None, "x"] and got(match_null=True) == ["n", "x"]


def test_repeated_keys_do_not_multiply_rows(spark):
    full = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k long, v string")
    assert sorted(map(tuple, merge.update_back(full, twice, "k", ["v"]).collect())) == [(1, "x"), (2, "z")]
    assert sorted(map(tuple, merge.fill_back(full, twice, "k", ["v"]).collect())) == [(1, "a", 0), (2, "z", 1)]


def test_first_rows(spark):
    df = spark.createDataFrame([(2, "a", None), (1, "a", "x"), (3, None, "n"), (4, None, "m")], "_ord int, k string, v string")
    assert sorted((r._ord, r.k, r.v) for r in merge.first_rows(df, "k").collect()) == [(1, "a", "x"), (3, None, "n")]


def test_known_keys_keep_their_spelling(spark):
    source = spark.createDataFrame([("12-3",), ("12-3",), ("99",)], "e string")
    base = spark.createDataFrame([("123",), ("123",), (None,)], "k string")
    assert [r.e for r in merge.keep_known_keys(source, base, "e", "k").collect()] == ["12-3", "12-3"]


def test_update_and_fill_back(spark):
    full = spark.createDataFrame([(1, "a", ""), (2, None, "z"), (None, "n", "n")], "k int, x string, y string")
    new = spark.createDataFrame([(1, "b", "q"), (2, "c", None)], "k int, x string, y string")
    rows = lambda df: sorted([tuple(r) for r in df.collect()], key=str)
    assert rows(merge.update_back(full, new, "k", ["x", "y"])) == [(1, "b", "q"), (2, "c", "z"), (None, "n", "n")]
    assert rows(merge.fill_back(full, new, "k", ["x", "y"])) == [(1, "a", "q", 1), (2, "c", "z", 1), (None, "n", "n", 0)]
    assert rows(merge.fill_back(full, new, "k", ["x", "y"], empty_is_missing=False)) == [
        (1, "a", "", 0), (2, "c", "z", 1), (None, "n", "n", 0)]


def test_rows_without_key_are_never_done(spark):
    work = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "b")], "_ord int, ein string")
    done = spark.createDataFrame([("a",), (None,)], "ein string")
    assert [r._ord for r in merge.remaining(work, done, "ein").orderBy("_ord").collect()] == [2, 3, 4]
    assert [r._ord for r in merge.remaining(work, done, "ein", limit=2).collect()] == [2, 3]


def test_coordinates(spark):
    df = spark.createDataFrame([(1, "40165-1"), (2, "99999"), (3, None)], "_ord int, zip_code string")
    places = spark.createDataFrame([("40165", 38.0, -85.0), ("99999", None, 1.0)], "zip5 string, latitude double, longitude double")
    got = merge.add_coordinates(df, places).orderBy("_ord").collect()
    assert [(r.lat, r.lng) for r in got] == [(38.0, -85.0), (None, None), (None, None)]
