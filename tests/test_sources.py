"""Readers and writers on small landed files."""

import json

import pytest
from pyspark.sql import functions as F

from rosterline import fixed
from rosterline.operators.aggregate import group_people
from rosterline.operators.coerce import coerce_schema
from rosterline.sources import documents as docs
from rosterline.sources import export, stages, tabular, web


def test_master_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "EIN, name ,STREET,CITY,STATE,ZIP,SUBSECTION,NTEE_CD,ASSET_AMT,REVENUE_AMT,STATUS\n"
        "001,caf\xe9 o'neil,1 MAIN,ST. LOUIS,ky ,40165-12345,19,W30,12,bad,01\n", encoding="latin-1")
    (tmp_path / "b.csv").write_text(
        "NAME,EIN,SORT_NAME,SUBSECTION,STREET,CITY,STATE,ZIP\n\"A, \"\"B\"\"\",2,alt,7,s,c,KY,1\n", encoding="latin-1")
    df = tabular.read_text_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert set(dict(df.drop("_ord").dtypes).values()) == {"string"}
    first, second = tabular.map_master(df).orderBy("_ord").collect()
    assert (first.org_name, first.ein, first.city, first.state, first.zip_code) == (
        "Café O'Neil", "001", "St. Louis", "KY", "40165-12345")
    assert tabular.map_master(df, zip_length=10).orderBy("_ord").first().zip_code == "40165-1234"
    assert (first.org_type, first.total_assets, first.total_revenue) == ("501(c)(19)", 12.0, None)
    assert first.tax_exempt_status == "Unconditional Exemption"
    assert (second.org_name, second.org_name_alt, second.org_type) == ('A, "B"', "Alt", "501(c)(7)")


def test_many_files_keep_their_order(spark, tmp_path):
    """120 files of three headers and any size, an empty one and hidden ones; two paths; splits within a file."""
    want = []
    for i in range(120):
        folder = tmp_path / "rows" / f"sub {i % 7}"
        folder.mkdir(parents=True, exist_ok=True)
        header, n = (["a", "b"], ["B ", "a"], ["a", "c", "b"])[i % 3], (i * 37) % 90
        lines = [",".join({"a": f"{i}", "b": f"{k}", "c": "x"}[c.strip().lower()] for c in header) for k in range(n)]
        (folder / f"f{i:03d}.csv").write_text("\n".join([",".join(header), *lines]))
    (tmp_path / "rows" / "_hidden.csv").write_text("a\n1\n")
    (tmp_path / "rows" / "empty.csv").write_text("")
    (tmp_path / "big+1.csv").write_text("a,b\n" + "".join(f"big,{k}\n" for k in range(60_000)))
    for folder in sorted((tmp_path / "rows").iterdir()):
        if folder.is_dir():
            for path in sorted(folder.iterdir()):
                i = int(path.stem[1:])
                want += [(str(i), str(k)) for k in range((i * 37) % 90)]
    want = [("big", str(k)) for k in range(60_000)] + want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = tabular.read_text_csv(spark, [str(tmp_path / "big+1.csv"), str(tmp_path / "rows")])
        assert sorted(df.columns) == ["A", "B", "C", "_ord"] and df.rdd.getNumPartitions() > 10
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r._ord for r in got}) == len(got)
    assert [(r.A, r.B) for r in sorted(got, key=lambda r: r._ord)] == want
    with pytest.raises(ValueError):
        tabular.read_text_csv(spark, [str(tmp_path / "rows" / "empty.csv")])


def test_stacked_sources_of_several_files_follow_the_base(spark, tmp_path):
    from rosterline.plans.directory import after_base

    for name in ("base", "more"):
        (tmp_path / name).mkdir()
        for i in range(70):
            (tmp_path / name / f"{i:02d}.csv").write_text(f"a\n{name}{i:02d}\n")
    base, more = (tabular.read_text_csv(spark, [str(tmp_path / n)]) for n in ("base", "more"))
    rows = base.unionByName(after_base(more, 0)).orderBy("_ord").collect()
    assert [r.A for r in rows] == [f"{n}{i:02d}" for n in ("base", "more") for i in range(70)]


def test_filing_extract(spark):
    df = spark.createDataFrame([(0, "1", "m", "9")], "_ord int, ORG_EIN string, MISSION_DESC string, EMPLOYEECNT string")
    out = coerce_schema(tabular.map_filings(df), keep=("_ord",)).first()
    assert (out._ord, out.ein, out.mission_statement, out.num_employees) == (0, "1", "m", 9.0)


def written(tmp_path, name, *documents):
    path = tmp_path / name
    path.write_text("\n".join(json.dumps(d) for d in documents))
    return str(path)


def test_financials(spark, tmp_path):
    officers = [{"name": f"n{i}", "title": None, "compensation": i} for i in range(12)]
    path = written(
        tmp_path, "f.json",
        {"ein": "1", "organization": {"number_of_forms_filed": 3}, "filings_with_data": [
            {"totrevenue": 5, "totassetsend": "x", "officers": officers}, {"totrevenue": 1}]},
        {"ein": "2", "organization": {}, "filings_with_data": []},
        {"ein": "3", "status": 404},
    )
    rows = docs.flatten_financials(docs.read_json(spark, path, docs.FINANCIALS)).orderBy("ein").collect()
    assert [(r.ein, r.num_employees, r.total_revenue, r.total_assets) for r in rows] == [
        ("1", 3.0, 5.0, None), ("2", None, None, None)]
    people = json.loads(rows[0].key_personnel)
    few = docs.flatten_financials(docs.read_json(spark, path, docs.FINANCIALS), officers_limit=10).filter("ein = '1'").first()
    assert json.loads(few.key_personnel) == people[:10]
    assert len(people) == 12 and people[0] == {"name": "n0", "title": "", "compensation": 0.0}
    assert rows[1].key_personnel is None


def test_ratings(spark, tmp_path):
    org = {"mission": "m", "websiteURL": "w", "currentRating": {"score": 88.5, "rating": 4},
           "advisories": [{"severity": "LOW"}, {"severity": "HIGH"}],
           "socialMedia": {"twitterHandle": "tw", "instagramHandle": "", "facebookProfileUrl": "fb"}}
    path = written(tmp_path, "r.json", {"ein": "1", "data": {"organizationByEIN": org}},
                   {"ein": "2", "data": {"organizationByEIN": None}}, {"ein": "3"},
                   {"ein": "4", "data": {"organizationByEIN": {"mission": "only"}}})
    rows = docs.flatten_ratings(docs.read_json(spark, path, docs.RATINGS)).orderBy("ein").collect()
    assert [r.ein for r in rows] == ["1", "4"]
    r = rows[0]
    assert (r.charity_navigator_rating, r.charity_navigator_score, r.cn_alert_level) == (4.0, 88.5, "LOW")
    assert (r.twitter_url, r.instagram_url, r.facebook_url) == ("https://twitter.com/tw", None, "fb")


def test_facilities(spark, tmp_path):
    facility = {"id": "f1", "attributes": {
        "name": " Clinic ", "address": {"physical": {"city": "o'FALLON", "state": "mo", "zip": "1"}},
        "phone": {"main": "5"}, "services": {"health": [{"name": "Dental"}, "Care"]}, "lat": 1.5}}
    path = written(tmp_path, "p.json", {"facility_type": "vet_center", "data": [facility, {"id": "f2"}]})
    rows = docs.flatten_facilities(docs.read_json(spark, path, docs.FACILITIES)).orderBy("_ord").collect()
    r = rows[0]
    assert (r.org_name, r.city, r.state, r.services_offered) == ("Clinic", "O'Fallon", "MO", "Dental; Care")
    assert (r.accreditation_details, r.va_accredited, r.lat, r.website) == ("VA Vet Center", "Yes", 1.5, "")
    assert len(rows) == 2 and rows[1].org_name == "" and rows[0]._ord != rows[1]._ord


def test_resources(spark, tmp_path):
    path = written(tmp_path, "l.json", {
        "resources": [{"title": " One ", "website": "w", "summary": "<p>Hi &amp; <b>you</b></p>"}, {"url": "nameless"}],
        "folders": [{"name": "Jobs", "resources": [{"title": "", "name": "Two", "link": "l", "phoneNumber": "5"}]}]})
    rows = docs.flatten_resources(docs.read_json(spark, path, docs.RESOURCES)).orderBy("org_name").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("One", "w", "", "Hi & you", ""), ("Two", "l", "5", "", "Jobs")]


def test_elements_keep_their_order(spark, tmp_path):
    """However the documents lie in partitions, and also beyond one split of numbers."""
    facility = lambda i, k: {"id": f"{i}-{k}", "attributes": {"name": f"n{k}"}}
    pages = [{"facility_type": "x", "data": [facility(i, k) for k in range(i % 4)] if i % 5 else None} for i in range(40)]
    path = written(tmp_path, "many.json", *pages)
    read = docs.read_json(spark, path, docs.FACILITIES).withColumn("_ord", F.col("_ord") * 2**30)
    want = [f"{i}-{k}" for i in range(40) if i % 5 for k in range(i % 4)]
    for parts in (1, 3, 8):
        rows = docs.flatten_facilities(read.repartition(parts, F.hash("_ord"))).orderBy("_ord").collect()
        assert [r.facility_id for r in rows] == want and [r._ord for r in rows] == list(range(len(want)))
    assert docs.flatten_facilities(read.filter("false")).count() == 0
    lists = [{"resources": [{"title": f"{i}a"}, {"url": "nameless"}, {"name": f"{i}b"}] if i % 3 else None,
              "folders": [{"name": "f", "resources": [{"name": f"{i}c"}]}, {"resources": None}, {"resources": [{"name": f"{i}d"}]}] if i % 2 else None}
             for i in range(12)]
    read = docs.read_json(spark, written(tmp_path, "lists.json", *lists), docs.RESOURCES)
    rows = docs.flatten_resources(read.repartition(5, F.hash("_ord"))).orderBy("_ord").collect()
    assert [r.org_name for r in rows] == [f"{i}{x}" for i in range(12) for x in ("ab" if i % 3 else "") + ("cd" if i % 2 else "")]
    table = "<table><tr><th>h</th></tr>" + "".join(f"<tr><td>{{0}}-{k}</td><td>c</td><td>KY</td></tr>" for k in range(3)) + "</table>"
    html = spark.createDataFrame([(i, table.format(i)) for i in range(9)] + [(9, None), (10, "")], "_ord long, html string")
    for read in (web.accredited_organizations, web.searched_organizations):
        rows = read(html.repartition(4, F.hash("_ord"))).orderBy("_ord").collect()
        assert [r.org_name for r in rows] == [f"{i}-{k}" for i in range(9) for k in range(3)]


def test_documents_without_order_follow_the_scan(spark):
    rows = spark.range(6).select(F.lit("x").alias("facility_type"), F.from_json(F.lit('[{"id":"a"},{"id":"b"}]'), docs.FACILITIES.split("data ")[1]).alias("data"))
    assert [r.facility_id for r in docs.flatten_facilities(rows).orderBy("_ord").collect()] == ["a", "b"] * 6


TABLE = """<html><table border=1><tr><th>Organization Name</th><th>POA</th><th>Org Phone</th><th>Org City</th>
<th>Org State</th><th>Representative</th></tr><tr><td>post &amp; co</td><td>1</td><td>502</td><td>st. paul</td><td>mn</td>
<td>Ann</td></tr><TR><TD><b>post &amp; co</b></TD><TD>2</TD><TD></TD></TR><tr><td>x</td></tr><tr><td></td><td>1</td><td>2</td></tr>
</table><table><tr><td>a</td><td>b</td><td>c</td></tr></table></html>"""


def test_accreditation_table(spark):
    pages = spark.createDataFrame([(1, TABLE), (2, "<p>none</p>")], "page int, html string")
    rows = web.accredited_organizations(pages, ["page"]).orderBy("_ord").collect()
    assert [(r.org_name, r.phone, r.city, r.representative_name) for r in rows] == [
        ("post & co", "502", "st. paul", "Ann"), ("post & co", "", "", "")]
    out = web.map_accredited(web.accredited_organizations(pages)).orderBy("_ord").collect()
    assert [r.key_personnel for r in out] == ['[{"name":"Ann","title":"VSO Representative"}]'] * 2
    assert (out[0].org_name, out[0].city, out[0].state) == ("Post & Co", "St. Paul", "MN")


def test_searched_table(spark):
    pages = spark.createDataFrame([("<table><tr><th>h</th></tr><tr><td>n</td><td>c</td><td>KY</td><td>1</td><td>5</td></tr></table>",)], "html string")
    row = web.searched_organizations(pages).first()
    assert (row.org_name, row.city, row.state, row.zip_code, row.phone) == ("n", "c", "KY", "1", "5")


def test_people_of_a_group(spark):
    df = spark.createDataFrame([(2, "a", "B"), (1, "a", "A"), (3, "a", ""), (4, "b", None)], "_ord int, k string, n string")
    got = {r.k: r.key_personnel for r in group_people(df, "k", "n", "T").collect()}
    assert got == {"a": '[{"name":"A","title":"T"},{"name":"B","title":"T"}]', "b": "[]"}


def test_sitemap(spark, tmp_path):
    path = tmp_path / "sitemap.xml"
    path.write_text("""<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
<url><loc> https://d.org/resource/detail/12/aid-for-vets </loc></url><url><loc>https://d.org/about</loc></url>
<url><loc>https://d.org/resource/detail/12/aid-for-vets</loc></url></urlset>""")
    rows = web.sitemap_resources(web.read_sitemap(spark, str(path))).collect()
    assert [(r.org_name, r.resource_id) for r in rows] == [("AID FOR Vets", "12")]


def test_directory_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(0, "b, \"q\"", "KY", 1.5), (1, "a", "KY", None), (2, "z", None, 2.0)],
        "_ord long, org_name string, state string, total_revenue double")
    path = str(tmp_path / "out")
    export.write_directory(coerce_schema(rows, keep=("_ord",)), path)
    raw = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbforg_name,org_name_alt")
    back = tabular.read_directory(spark, path)
    assert back.columns == [n for n, _ in fixed.COLUMNS]
    got = {r.org_name: (r.state, r.total_revenue) for r in back.collect()}
    assert got == {'b, "q"': ("KY", 1.5), "a": ("KY", None), "z": (None, 2.0)}


def test_views_and_report_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "_ord int, org_name string")
    export.write_views({"one": df, "two": df}, str(tmp_path / "views"))
    assert spark.read.option("header", True).csv(str(tmp_path / "views/two")).count() == 1
    report = spark.createDataFrame([("a", "m", 0, None, 1.0), ("b", "top", 1, "L", 2.5)],
                                   "section string, metric string, rank int, label string, value double")
    export.write_report(report, str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a  m  1.000", "b  top  1  L  2.500"]


def test_stage_follows_its_inputs(spark, tmp_path):
    calls, source, folder = [], str(tmp_path / "in 1 é"), str(tmp_path / "stages")

    def run(rule="v1", memory=1, **options):
        options = {"resume": True} | options
        made = stages.Stages(spark, folder, **options)
        read = spark.read.parquet(source)
        side = spark.range(memory).select(F.map_from_arrays(F.array("id"), F.array("id")).alias("m"))
        first = made.stage("first", lambda: calls.append("first") or read, inputs=[read], rule=rule)
        second = made.stage("second", lambda: calls.append("second") or first.filter("id > 1"), inputs=[first, side])
        return second.count(), [calls.pop(0) for _ in range(len(calls))]

    spark.range(4).write.parquet(source)
    assert run() == (2, ["first", "second"]) and run() == (2, [])
    spark.range(6).write.mode("overwrite").parquet(source)
    assert run() == (4, ["first", "second"]) and run() == (4, [])
    assert run(rule="v2") == (4, ["first", "second"]) and run("v2", memory=2) == (4, ["second"])
    assert run("v2", 2, clean=True) == (4, ["first", "second"])
    assert run("v3", 2, run=("second",)) == (4, [])
    made = stages.Stages(spark, folder, resume=True)
    made._note("second", stages.UNFINISHED)
    assert run("v2", 2) == (4, ["second"])
    read = spark.read.parquet(source)

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        made.stage("second", broken, inputs=[read])
    assert run("v2", 2) == (4, ["second"])


def test_stages(spark, tmp_path):
    calls = []

    def make(n):
        def compute():
            calls.append(n)
            return spark.range(n).select(F.col("id").cast("string").alias("org_name"))
        return compute

    folder = str(tmp_path / "stages")
    assert stages.Stages(spark, folder).stage("a", make(2)).count() == 2
    assert stages.Stages(spark, folder, resume=True).stage("a", make(3)).count() == 2
    assert stages.Stages(spark, folder, run={"b"}).stage("a", make(3)).count() == 2
    assert stages.Stages(spark, folder, run={"b"}).stage("c", make(3)).count() == 0
    assert stages.Stages(spark, folder, resume=True, clean=True).stage("a", make(4)).count() == 4
    with pytest.raises(LookupError):
        stages.Stages(spark, folder, run=set()).stage("d", make(3), required=True)
    assert calls == [2, 4]
