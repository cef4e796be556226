"""Contact extraction on hand-made pages and results."""

import pytest
from pyspark.sql import functions as F

from rosterline import fixed
from rosterline.functions import contact
from rosterline.operators import enrich
from rosterline.operators.coerce import coerce_schema


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "html string").select(column(F.col("html"))).first()[0]


@pytest.mark.parametrize("text,phone", [
    ("call (502) 555-1234 now", "(502) 555-1234"), ("502.555.1234", "502.555.1234"), ("none", None), (None, None),
    ("5025551234567", "5025551234"),
])
def test_phone(spark, text, phone):
    assert one(spark, contact.first_phone, text) == phone


@pytest.mark.parametrize("text,email", [
    ("x@2x.png then Info@Org.org", "info@org.org"), ("sentry@sentry.io", None), ("a@b.com1x@c.org", "a@b.com"),
    ("sentry@sentry.iox@c.org", "sentry@sentry.iox"), ("..@x.org", "..@x.org"), ("a@b", None),
    ("info@wordpress.com1x@c.org", "1x@c.org"),
])
def test_first_email(spark, text, email):
    assert one(spark, contact.first_email, text) == email


def test_site_email_prefers_mailto(spark):
    page = ("first@page.org <a class=x href=\"mailto:noreply@x.org\">n</a>"
            "<A HREF='mailto:Joe@x.org?subject=a'>j</A><a href='/mailto:no'>")
    assert one(spark, lambda h: contact.site_email(h, contact.links(h)), page) == "joe@x.org"
    assert one(spark, lambda h: contact.site_email(h, contact.links(h)), "me@example.com You@Y.org") == "you@y.org"


@pytest.mark.parametrize("page,found", [
    ("""<a href="https://f.com/o'neil">x</a>""", ["https://f.com/o'neil"]), ("<a class=x HREF = '/a\"b'>x</a>", ['/a"b']),
    ("<a href=/bare/x>x</a><a href=y>", ["/bare/x", "y"]), ("<!-- <a href='/gone'> --><a href='/here'>", ["/here"]),
    ("<a href='?a=1&amp;lt;b&#x26;c&#233;'>", ["?a=1&lt;b&cé"]), ("<a name='x'>", []),
])
def test_links(spark, page, found):
    assert one(spark, contact.links, page) == found


@pytest.mark.parametrize("html,text", [
    ("<b> A </b><i> B </i>", "AB"), ("&Eacute;t&eacute; &#8211; &#x1F600; &unknown; &amp;eacute;", "Été – 😀 &unknown; &eacute;"),
    ("a<!-- <td> > -->b", "ab"), ("x&nbsp;", "x"), ("&#0;&#xD800;", "&#0;&#xD800;"),
])
def test_cell_text(spark, html, text):
    assert one(spark, contact.cell_text, html) == text


FB = fixed.SOCIAL_PATTERNS["facebook_url"]


@pytest.mark.parametrize("page,skip,url", [
    ('<a href="https://facebook.com/sharer?u=1">s</a><a href="http://www.Facebook.com/org/">o</a>',
     fixed.SKIP_SOCIAL_PARTS, "http://www.Facebook.com/org"),
    ('<a href="https://facebook.com/sharer?u=1">s</a>', (), "https://facebook.com/sharer"),
    ('<script>"https://facebook.com/org"</script>', fixed.SKIP_SOCIAL_PARTS, "https://facebook.com/org"),
    ('<script>"https://facebook.com/share", "https://facebook.com/org"</script>', fixed.SKIP_SOCIAL_PARTS, None),
    ('<a href="/x">x</a>', fixed.SKIP_SOCIAL_PARTS, None),
])
def test_social(spark, page, skip, url):
    assert one(spark, lambda h: contact.social_url(h, contact.links(h), FB, skip), page) == url


@pytest.mark.parametrize("page,text", [
    ('<meta name="description" content=" Aid\'s &amp; more ">', "Aid's & more"),
    ("<META content='c' name='description'>", "c"), ('<meta name="keywords" content="k">', None),
    ('<meta name="description" content="">', None), ('<meta name="description" content="' + "x" * 600 + '">', "x" * 600),
])
def test_meta(spark, page, text):
    assert one(spark, contact.meta_content, page) == text
    short = one(spark, lambda h: contact.meta_content(h, limit=500), page)
    assert short == (None if text is None else text[:500])


RESULTS = [
    ("1", 1, "https://www.facebook.com/org1/", "t", "call 502-555-1234"),
    ("1", 2, "http://fedex.com/a", "x@example.com real@x.org", None),
    ("1", 3, "https://org1.org/", "later@x.org", "502-555-9999"),
    ("2", 1, "https://maps.google.com/x", None, None), ("2", 2, "https://facebook.com/share", None, None),
]


def test_result_evidence(spark):
    df = spark.createDataFrame(RESULTS, "ein string, rank int, url string, title string, snippet string")
    rows = {r.ein: r for r in enrich.evidence_from_results(df).collect()}
    r = rows["1"]
    assert (r.website, r.phone, r.email, r.facebook_url) == (
        "http://fedex.com/a", "502-555-1234", "later@x.org", "https://www.facebook.com/org1")
    assert (rows["2"].website, rows["2"].facebook_url) == (None, None)
    parts = enrich.evidence_from_results(df, substring_domains=True).filter("ein = '1'").first()
    assert parts.website == "https://org1.org/"


def test_enrich_from_results(spark):
    results = spark.createDataFrame(RESULTS, "ein string, rank int, url string, title string, snippet string")
    pages = spark.createDataFrame(
        [("http://fedex.com/a", 200, '<a href="mailto:p@p.org"><a href="https://x.com/org1">'
          '<meta name="description" content="M">')], "url string, status int, html string")
    df = coerce_schema(spark.createDataFrame([("1", "", "w"), ("3", None, None)], "ein string, phone string, website string"))
    out = {r.ein: r for r in enrich.enrich_from_results(df, results, pages).collect()}
    r = out["1"]
    assert (r.website, r.phone, r.email, r.twitter_url, r.mission_statement, r.fields_updated) == (
        "w", "502-555-1234", "later@x.org", "https://x.com/org1", "M", 5)
    assert out["3"].fields_updated == 0


def test_enrich_from_pages(spark):
    pages = spark.createDataFrame(
        [("w", 200, "a@b.org <a href='https://x.com/o'>"), ("dead", 500, "c@d.org")], "url string, status int, html string")
    rows = [(0, "w", None, None), (1, "w", "", "t"), (2, "dead", None, None), (3, None, None, None), (4, "w", "e", "t")]
    df = coerce_schema(spark.createDataFrame(rows, "_ord long, website string, email string, twitter_url string"), keep=("_ord",))
    out = [(r.email, r.twitter_url) for r in enrich.enrich_from_pages(df, pages).orderBy("_ord").collect()]
    assert out == [("a@b.org", "https://x.com/o"), ("", "t"), (None, None), (None, None), ("e", "t")]
