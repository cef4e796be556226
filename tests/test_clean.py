"""Scalar rules against plain Python on hand-made and random text."""

import random
import re
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from rosterline import fixed
from rosterline.functions import clean
from rosterline.functions.blanks import is_blank, is_filled, to_number
from rosterline.functions.keywords import matches_any, one_pattern, shortest_words


def run(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def noise(alphabet, n=400, longest=24, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_key(spark):
    values = ["123456789", "12-3456789", "012345678", "12345678", "1234567890", "", None, "ein 12 345 6789"]
    assert run(spark, clean.normalize_key, values) == [
        "12-3456789", "12-3456789", "01-2345678", None, None, None, None, "12-3456789"]


def test_phone(spark):
    values = ["(502) 555-1234", "1-502-555-1234", "2-502-555-1234", "5551234", "", None, "502.555.1234 x"]
    good = "(502) 555-1234"
    assert run(spark, clean.normalize_phone, values) == [good, good, None, None, None, None, good]


def test_zip(spark):
    values = ["12345", "123456789", "12345-6789", "123-4567", "1234", "12345--6789", "12345-67", None, ""]
    assert run(spark, clean.normalize_zip, values) == [
        "12345", "12345-6789", "12345-6789", "123-4", None, "12345-6789", "12345", None, None]


def test_state(spark):
    values = [" ky ", "Kentucky", "xx", "Virgin Islands", "U.S. Virgin Islands", "nowhere", "", None]
    assert run(spark, clean.normalize_state, values) == ["KY", "KY", "XX", "VI", None, None, None, None]


def python_url(url):
    url = url.strip()
    if not url:
        return None
    if not re.match("https?://", url):
        url = "https://" + url
    try:
        p = urlparse(url)
    except ValueError:
        return None
    return f"{p.scheme}://{p.netloc.lower()}{p.path}".rstrip("/") if p.netloc else None


def test_url(spark):
    values = [
        "HTTP://X.org/a;b/c;d?x#y", "www.Foo.org:80/", "https://u:P@Host.org//", "http://", "//a", "", "  ",
        "https://www.www.x.org/p?q", "a b.org", "http://[::1]/x", "http://[x", "https://x.org/;v", "HTTPS://X.org",
        "http://x.org\n/y", "http://A.org/B;c=1/d", "?", "https://?x", "mailto:me@x.org",
    ] + noise("hHtps:/?#;.wa1 @", 600) + ["http://" + x for x in noise("/?#;.wAb:", 300, 12)]
    for value, got in zip(values, run(spark, clean.normalize_url, values)):
        assert got == python_url(value), value


def python_domain(url):
    try:
        host = urlparse(url).netloc.lower()
    except ValueError:
        return ""
    return host[4:] if host.startswith("www.") else host


def test_domain(spark):
    values = [
        "https://www.X.org/a", "HTTP://WWW.www.x.org:8080", "x.org", "www.x.org/a", "//y.org/b", "", "ftp://f.org",
        "https://u@h.org?x",
    ] + noise("htps:/?#.wa1W@", 400)
    for value, got in zip(values, run(spark, clean.web_domain, values)):
        assert got == python_domain(value), value


def test_title(spark):
    values = ["o'neil's A.B.", "post-12a", "élan vital", "ßtart", "ǆungla", "中a b", "", "ab\tcd\nef", "VFW POST 1ST"]
    values += noise("abÉß zé'.-1 \tZ", 500)
    assert run(spark, clean.title_case, values) == [v.title() for v in values]


def python_name(name):
    words = re.sub(r"\s+", " ", name.strip()).title().split()
    return " ".join(w.upper() if w.upper() in fixed.NAME_ACRONYMS else w for w in words) or None


def test_name(spark):
    values = ["  vfw   post 12 ", "the usa of VA us", "POW/MIA inc", "o'neil va.", "", "   "]
    values += noise("vafwus po\t'1", 500)
    assert run(spark, clean.normalize_name, values) == [python_name(v) for v in values]


def test_normalizers_are_idempotent(spark):
    for rule, values in (
        (clean.normalize_key, ["12-3456789"]), (clean.normalize_phone, ["5025551234"]),
        (clean.normalize_zip, ["123456789"]), (clean.normalize_url, ["Foo.org/a/"]),
        (clean.normalize_state, ["kentucky"]), (clean.normalize_name, ["the vfw post"]),
    ):
        once = run(spark, rule, values)
        assert run(spark, rule, once) == once


def test_slug(spark):
    values = ["aid-for-vets", "us-navy-1st", "-a--b-", "operation-o2-go"]
    assert run(spark, clean.slug_to_name, values) == ["AID FOR Vets", "US Navy 1St", "A B", "Operation O2 GO"]


def test_numbers(spark):
    values = ["1", " 2.5 ", "1e3", "n/a", "", "NaN", "-.5", "1d", "0x1", None, "7.", "inf"]
    assert run(spark, to_number, values) == [
        1.0, 2.5, 1000.0, None, None, None, -0.5, None, None, None, 7.0, float("inf")]


@pytest.mark.parametrize("value,label", [
    (None, None), (-1.0, None), (0.0, "$0"), (0.5, None), (49_999.0, "Under $50K"), (49_999.5, None),
    (50_000.0, "$50K–$100K"), (1e6, "$1M–$5M"), (1e9, "$100M+"),
])
def test_bucket(spark, value, label):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(clean.bucket_label(F.col("v"))).first()[0] == label


@pytest.mark.parametrize("value,text", [
    (None, "N/A"), (0.0, "$0"), (999.0, "$999"), (1_500.0, "$2K"), (2_500.0, "$2K"), (1_250_000.0, "$1.2M"),
    (3.26e9, "$3.3B"), (-5.0, "$-5"),
])
def test_currency(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(clean.compact_currency(F.col("v"))).first()[0] == text


def test_people(spark):
    many = "[" + ",".join(f'{{"name":"n{i}","title":"t"}}' for i in range(20)) + "]"
    got = run(spark, clean.people_list, ['[{"name":"A","title":"B","compensation":1.5}]', "[]", many, "oops", None, " "])
    assert [None if p is None else len(p) for p in got] == [1, 0, 20, 1, None, None]
    assert got[3][0].asDict() == {"name": "oops", "title": None, "compensation": None}
    assert len(run(spark, lambda c: clean.people_list(c, 15), [many])[0]) == 15
    assert got[0][0].asDict() == {"name": "A", "title": "B", "compensation": 1.5}


def test_split_list(spark):
    assert run(spark, lambda c: clean.split_list(c, limit=2), [" a ;; b;c", "", None]) == [["a", "b"], [], None]


def test_people_json_writes_nulls(spark):
    df = spark.sql(f"select cast(array(named_struct('name','A','title','','compensation',null)) as {clean.PERSON}) p")
    assert df.select(clean.people_json(F.col("p"))).first()[0] == '[{"name":"A","title":"","compensation":null}]'


def test_one_pattern_is_any_of_the_words():
    words = ["vet", "veteran", "v.f.w", "usa", "us army", "a+b", "(x)", "é t", "vet"]
    pattern = re.compile(one_pattern(words))
    assert all(pattern.fullmatch(w) for w in words)
    for text in ("ve", "veter", "vxfxw", "us", "us arm", "aab", "x", ""):
        assert not pattern.fullmatch(text)
    assert one_pattern([]) == "" and one_pattern(["", "a"]) == "(?:a)?" and one_pattern(["ab", "abc"]) == "ab(?:c)?"


def test_keywords_equal_a_plain_search(spark):
    words = ["Vet", "legion", "v.f.w", "us army", "a+b", "$5", "[x]", "café", "^top"]
    texts = ["VETERAN", "le gion", "V.F.W. post", "vxfxw", "US Army", "us  army", "aa+b", "costs $5", "[X]", "x", "CAFÉ noir", "the ^TOP", "", None,
             "long " * 2000 + "legion", "line\nlegion\n"]
    got = run(spark, lambda c: matches_any(c, words), texts)
    assert got == [t is not None and any(w.lower() in t.lower() for w in words) for t in texts]
    assert run(spark, lambda c: matches_any(c, ["", "b"]), ["", "x", None]) == [True, True, False]
    whole = run(spark, lambda c: matches_any(c, ["vet", " us army ", "vet clinic"], word_boundary=True), [
        "a vet.", "veteran", "US ARMY", "us armys", "Vet Clinic", "vet clinics", None])
    assert whole == [True, False, True, False, True, True, False]


def test_keywords(spark):
    names = ["David's Shop", "DAV chapter", "Miami Power", "shoe store", None, "Vet clinic", "heroes"]
    assert run(spark, lambda c: matches_any(c, fixed.INCLUDE_KEYWORDS), names) == [
        True, True, True, False, False, True, False]
    assert run(spark, lambda c: matches_any(c, ["dav"], word_boundary=True), names) == [
        False, True, False, False, False, False, False]
    assert run(spark, lambda c: matches_any(c, ["^d.v", "sto.e"], regex=True), names) == [
        True, True, False, True, False, False, False]


def test_shortest_words_match_the_same():
    kept = shortest_words(fixed.INCLUDE_KEYWORDS)
    assert all(any(k in w for k in kept) for w in fixed.INCLUDE_KEYWORDS)
    assert set(kept) <= set(fixed.INCLUDE_KEYWORDS)


def test_blank_rules(spark):
    values = [None, "", "  ", "x"]
    assert run(spark, is_blank, values) == [True, True, False, False]
    assert run(spark, is_filled, values) == [False, False, False, True]


def test_fixed_values():
    assert len(fixed.COLUMNS) == 52 and len(fixed.INCLUDE_KEYWORDS) == 88
    assert round(sum(fixed.WEIGHTS.values()), 9) == 1.0
    assert len(fixed.STATES) == 51 and len(fixed.REGION_NAMES) == 57 and len(fixed.POPULATION_THOUSANDS) == 50
    assert len(fixed.SKIP_DOMAINS) == 38 and len(fixed.SKIP_SOCIAL_PARTS) == 18
