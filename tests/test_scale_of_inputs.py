"""Inputs that the queries make themselves, with keys and sizes beyond those of the supplied tables."""

import pathlib

from pyspark.sql import functions as F

from rosterline.catalog import QUERIES, SQL, landing
from rosterline.operators.coerce import with_room
from rosterline.session import shared_folder
from tests.compare import database, difference


def test_many_files_with_keys_whose_square_is_no_int(spark, tmp_path):
    spark.range(46_300, 46_400).union(spark.range(900_000, 900_100)).coalesce(1).selectExpr(
        "id as c_custkey", "concat('Customer#', id) as c_name", "cast(id % 25 as int) as c_nationkey",
        "id / 2 as c_acctbal", "'BUILDING' as c_mktsegment").write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "customer.parquet")
    got = QUERIES["master_many_files"](spark, str(tmp_path))
    assert difference(got, database(str(tmp_path)), SQL["master_many_files"]) is None


def test_landed_facilities_are_small_and_shuffled_as_lines(spark, monkeypatch):
    pages = []
    plain = landing.landed
    monkeypatch.setattr(landing, "landed", lambda spark, df, schema: (pages.append(df), plain(spark, df, schema))[1])
    before = set(pathlib.Path(shared_folder(spark)).glob("landed-*"))
    n = QUERIES["facility_documents"](spark, "/root/testdata/sf0.001").count()
    made, = set(pathlib.Path(shared_folder(spark)).glob("landed-*")) - before
    assert sum(f.stat().st_size for f in made.glob("part-*")) < 60 * n
    # What is collected, and so shuffled, are the plain columns; texts are made of them afterwards.
    plan = pages[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Center" in plan and "Center" not in plan.split("collect_list(", 1)[1].split(", 0, 0)")[0]


def test_starts_of_documents_are_not_broadcast(spark):
    docs = spark.range(100).select(F.col("id").alias("_ord"), F.array_repeat("id", 3).alias("data"))
    plan = with_room(docs, F.size("data"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_ord" in plan
