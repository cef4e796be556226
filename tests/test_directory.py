"""The whole way from landed tables to a finished directory, and the file stream."""

from pyspark.sql import functions as F

from rosterline.operators.coerce import row_order
from rosterline.plans.directory import Inputs, build_directory
from rosterline.plans import views
from rosterline.sources.stages import Stages
from rosterline.streaming import arrivals

MASTER = "EIN string, NAME string, STREET string, CITY string, STATE string, ZIP string, SUBSECTION string, NTEE_CD string, ASSET_AMT string, REVENUE_AMT string, STATUS string"
ROWS = [
    ("111111111", "VFW POST 1", "1 MAIN ST", "LOUISVILLE", "KY", "40165", "19", "W30", "10", "2000000", "01"),
    ("111111111", "VFW POST ONE", "", "LOUISVILLE", "KY", "40165", "19", "W30", "10", "5", "01"),
    ("222222222", "VETERANS AID FUND", "2 MAIN ST", "LEXINGTON", "KY", "40502", "03", "P20", "", "", "01"),
    ("333333333", "VETERANS AID FUNDS", "2 MAIN ST", "LEXINGTON", "KY", "40502", "03", "P20", "7", "0", "01"),
    ("444444444", "HAPPY VET CLINIC", "3 MAIN ST", "LEXINGTON", "KY", "40502", "03", "W30", "", "", "01"),
    ("555555555", "SOLDIERS HOME", "4 MAIN ST", "CINCINNATI", "OH", "45202", "03", None, "", "", "01"),
    ("666666666", "GARDEN CLUB", "5 MAIN ST", "CINCINNATI", "OH", "45202", "03", "C42", "", "", "01"),
]


def inputs(spark):
    master = spark.createDataFrame(ROWS, MASTER).coalesce(1).withColumn("_ord", row_order())
    ratings = spark.createDataFrame(
        [(0, "111111111", "https://www.vfw1.org/home", 4.0), (1, "555555555", "https://soldiers.org", None)],
        "_ord long, ein string, website string, charity_navigator_rating double")
    listed = spark.createDataFrame([(0, "Vfw Post One Louisville", "https://vfw1.org", "5025551234")],
                                   "_ord long, org_name string, website string, phone string")
    pages = spark.createDataFrame(
        [("https://soldiers.org", 200, "Mail@Soldiers.org"), ("https://www.vfw1.org/home", 200, "post@vfw1.org")],
        "url string, status int, html string")
    return Inputs(master, {"charity_nav": ratings}, {"va_vso": listed}, pages)


def check(rows):
    assert [(r.state, r.org_name) for r in rows] == [
        ("KY", "VFW Post 1"), ("KY", "Veterans Aid Fund"), ("OH", "Soldiers Home")]
    post, fund, home = rows
    assert (post.ein, post.phone, post.website) == ("11-1111111", "(502) 555-1234", "https://www.vfw1.org/home")
    assert post.data_sources == "charity_nav;irs_bmf;va_vso" and post.confidence_grade == "A"
    assert (fund.total_assets, fund.total_revenue, fund.annual_revenue_range) == (7.0, 0.0, "$0")
    assert fund.ein == "22-2222222" and home.email == "mail@soldiers.org"


def test_build(spark):
    rows = build_directory(inputs(spark), "2024-01-01", "2024-01-01T00:00:00").orderBy("state", "org_name").collect()
    check(sorted(rows, key=lambda r: (r.state, r.ein)))


def test_build_with_stages(spark, tmp_path):
    folder = str(tmp_path / "stages")
    build = lambda **o: build_directory(
        inputs(spark), "2024-01-01", "2024-01-01T00:00:00", stages=Stages(spark, folder, **o))
    check(sorted(build().collect(), key=lambda r: (r.state, r.ein)))
    check(sorted(build(resume=True).collect(), key=lambda r: (r.state, r.ein)))
    check(sorted(build(run={"resolved", "enriched"}).collect(), key=lambda r: (r.state, r.ein)))


def test_enrichment_of_one_state(spark):
    rows = build_directory(inputs(spark), "2024-01-01", "2024-01-01T00:00:00", state="ky").collect()
    emails = {r.org_name: r.email for r in rows}
    assert emails == {"VFW Post 1": "post@vfw1.org", "Veterans Aid Fund": None, "Soldiers Home": None}
    rows = build_directory(inputs(spark), "2024-01-01", "2024-01-01T00:00:00", skip_enrichment=True).collect()
    assert {r.email for r in rows} == {None}


def test_reports_read_as_text(spark):
    built = build_directory(inputs(spark), "2024-01-01", "2024-01-01T00:00:00").cache()
    lines = [r.line for r in views.report_lines(views.directory_report(built)).collect()]
    assert "directory  organizations  3.000" in lines and "states  rows  1  KY  2.000" in lines
    lines = [r.line for r in views.report_lines(views.strategy_report(built, "KY")).collect()]
    assert "funders  top  1  VFW Post 1  2000000.000" in lines


def test_stream_takes_what_is_new(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    frame = spark.createDataFrame(ROWS, MASTER)

    def arrive():
        rows = arrivals.arriving_rows(spark, landing, frame.schema)
        scored = arrivals.scored_stream(rows, "2024-01-01", "2024-01-01T00:00:00")
        arrivals.append_new(scored, out, state).awaitTermination(120)
        return spark.read.parquet(out).count()

    frame.filter("STATE = 'KY'").write.parquet(landing)
    assert arrive() == 4
    assert arrive() == 4
    frame.filter("STATE = 'OH'").write.mode("append").parquet(landing)
    assert arrive() == 5
    assert spark.read.parquet(out).filter(F.col("ein") == "55-5555555").first().confidence_grade == "D"


def test_skipped_stages_pass_on_what_they_got(spark, tmp_path):
    """Nothing is saved, so a skipped source adds nothing and a skipped transform changes nothing."""
    every = ("base", "charity_nav", "va_vso", "merged", "resolved", "enriched")

    def build(*left_out):
        run = [s for s in every if s not in left_out]
        stages = Stages(spark, str(tmp_path / "-".join(left_out)), run=run)
        return build_directory(inputs(spark), "2024-01-01", "2024-01-01T00:00:00", stages=stages).collect()

    assert {r.charity_navigator_rating for r in build("charity_nav")} == {None}
    assert all("va_vso" not in r.data_sources for r in build("va_vso"))
    assert {r.data_sources for r in build("merged")} == {"irs_bmf"}
    assert len(build("resolved")) == 4 + 1 and {r.email for r in build("enriched")} == {None}
    assert len(build("charity_nav", "va_vso", "merged", "resolved", "enriched")) == 4


def test_folder_files_come_by_name(spark, tmp_path):
    from rosterline.sources.tabular import read_text_csv

    for name, n in (("d.csv", 1), ("a.csv", 400), ("c.csv", 20), ("b.csv", 4)):
        (tmp_path / name).write_text("EIN,NAME\n" + "".join(f"{i},{name}\n" for i in range(n)))
    rows = read_text_csv(spark, [str(tmp_path)]).orderBy("_ord").collect()
    assert [r.NAME for r in rows] == ["a.csv"] * 400 + ["b.csv"] * 4 + ["c.csv"] * 20 + ["d.csv"]
