"""What the physical plans must and must not hold."""

import pathlib
import re

from pyspark.sql import functions as F

from rosterline.catalog.frame import directory, organizations
from rosterline.operators import aggregate, coerce, filters, merge, resolve
from rosterline.plans import views

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_reads_only_what_it_needs(spark):
    text = plan(aggregate.state_summary(directory(spark, SF_DIR)))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert not any("html" in s or "text:" in s for s in schemas)


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").selectExpr("o_orderkey as _ord", "o_orderstatus as state", "o_totalprice")
    text = plan(orders.filter(filters.FilterSpec(states=("F", "O")).condition(orders)))
    assert "PushedFilters: [In(o_orderstatus" in text


def test_merged_sources_share_one_shuffle_of_the_base(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = organizations(spark, SF_DIR).select("_ord", "ein", "org_name", "data_sources")
        source = base.select("_ord", "ein", "org_name")
        for n in (1, 2, 3):
            text = plan(merge.merge_sources(base, {str(i): source for i in range(n)}, prune=False))
            # One exchange of the base by its key, however many sources; one of each source.
            assert text.count("Exchange hashpartitioning(_k") == 1 + n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_groups_combine_before_their_shuffle(spark):
    df = organizations(spark, SF_DIR).select("_ord", "ein", "org_name", "data_sources")
    assert "partial_min_by" in plan(resolve.merge_exact(df))
    first = plan(merge.first_rows(df, "ein"))
    assert "partial_min" in first and "SortAggregate" not in first and "Window" not in first


def exchanges(text):
    """What each shuffle of a plan carries, as the output of the line below it."""
    return [line for line in text.splitlines() if "Exchange hashpartitioning" in line]


def test_rows_without_a_duplicate_are_not_shuffled(spark):
    """One shuffle in each tier: of the rows that have a duplicate, after their aggregate began."""
    df = spark.range(3000).selectExpr(
        "id as _ord", "string(id - int(id % 100 = 1)) as ein", "concat('Post ', id * 7919, ' ', md5(string(id))) as org_name",
        "'KY' as state", "string(id % 50) as city", "concat('https://h', id - int(id % 90 = 1), '.org') as website", "'s' as data_sources")
    for merged, rows in ((resolve.merge_exact(df), 2970), (resolve.merge_fuzzy(df), 3000), (resolve.merge_domain(df), 2966)):
        text = plan(merged)
        assert len(exchanges(text)) == 1 and "SortMergeJoin" not in text
        assert merged.count() == rows


def test_merges_hold_where_the_duplicates_are_not_broadcast(spark):
    df = spark.range(400).selectExpr(
        "id as _ord", "if(id % 3 = 0, null, string(id div 4)) as ein", "if(id % 2 = 0, null, string(id)) as org_name", "concat('s', id % 5) as data_sources")
    want = sorted(map(str, resolve.merge_exact(df).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, resolve.merge_exact(df).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_tables_have_a_known_size(spark):
    """A dimension given in code is broadcast by its size, without a hint."""
    orgs = organizations(spark, SF_DIR).select("_ord", "state")
    text = plan(aggregate.per_capita(orgs, aggregate.population_table(spark)))
    assert "BroadcastHashJoin" in text and "Scan ExistingRDD" not in text


def test_rows_without_a_key_are_spread(spark):
    rows = spark.range(1000).selectExpr("id", "cast(null as string) as k")
    grouped = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    out = aggregate.attach(rows, grouped, "k")
    assert out.columns == ["id", "k", "v"] and out.filter("v is not null").isEmpty() and out.count() == 1000


def test_dimensions_are_not_hinted(spark):
    """Broadcasts come from Spark's own size estimate."""
    root = pathlib.Path(__file__).resolve().parent.parent / "rosterline"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "broadcast(" in p.read_text()]


def test_written_tables_can_be_removed(tmp_path):
    """One folder for each session, gone when asked; in a process of its own."""
    import subprocess
    import sys

    code = f"""
from rosterline.session import build_session, cut_lineage, remove_written, shared_folder
import pathlib
spark = build_session("t", "local[1]", spark__ui__enabled="false", spark__checkpoint__dir={str(tmp_path)!r})
folder = pathlib.Path(shared_folder(spark))
assert cut_lineage(spark.range(3)).count() == 3 and len(list(folder.iterdir())) == 1
remove_written(spark)
assert not folder.exists()
print("removed")
"""
    root = pathlib.Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert "removed" in done.stdout, done.stderr[-2000:]


def test_report_counts_distinct_values_without_expand(spark):
    text = plan(views.directory_report(directory(spark, SF_DIR)))
    assert "gid#" not in text and "count(distinct" not in text


def test_elements_are_numbered_on_two_columns(spark):
    """Only the documents themselves carry their lists through a shuffle, once."""
    pages = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").selectExpr(
        "l_orderkey * 8 + l_linenumber as _ord", "'x' as facility_type", "array(named_struct('id', l_returnflag)) as data")
    text = plan(coerce.with_room(pages, F.size("data")))
    wide = [line for line in exchanges(text) if "_ord" in line]
    assert "CartesianProduct" not in text and len(wide) <= 3
