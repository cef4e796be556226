"""Similarity, greedy clusters and merged records against brute force."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rosterline.operators import resolve
from rosterline.operators import similarity as sim

WORDS = ["legion", "post", "veterans", "vets", "home", "aid", "of", "foreign", "wars", "amvets", "hero"]


def dp_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=70), st.text("abcé ", max_size=70))
def test_bit_lcs_is_the_table_lcs(a, b):
    assert sim.Matcher(a).common(b) == dp_lcs(a, b)


def test_thresholds_are_refused_for_every_size(spark):
    names = spark.createDataFrame([("b", "x y", 0), ("b", "x z", 1)], "block string, name string, ord long")
    for limits in ({}, {"small_block": 1}):
        with pytest.raises(ValueError):
            sim.cluster_names(names, 60.0, **limits)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=30), st.text("ab", max_size=30), st.sampled_from([70, 85, 90.5]))
def test_similar_is_the_ratio_test(a, b, threshold):
    assert sim.Matcher(a).similar(b, threshold) == (200 * dp_lcs(a, b) >= threshold * (len(a) + len(b)))


def brute_clusters(rows, threshold):
    """The plain double loop over each place, on every row."""
    places = {}
    for order, state, city, name in rows:
        if None not in (state, city, name):
            places.setdefault((state.upper(), city.upper()), []).append((order, " ".join(sorted(name.split()))))
    cluster = {}
    for members in places.values():
        members.sort()
        for at, (anchor, text) in enumerate(members):
            if anchor in cluster:
                continue
            for other, name in members[at + 1:]:
                total = len(text) + len(name)
                if other not in cluster and 200 * dp_lcs(text, name) >= threshold * total:
                    cluster[other] = anchor
    return cluster


def random_rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        city = rnd.choice(["X", "X", "X", "x", "Y", "", None])
        name = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 4)))
        name += rnd.choice(["", f" {rnd.randint(1, 40)}", " é"])
        rows.append((i, rnd.choice(["KY", "ky"]), city, rnd.choice([name, name, name, name[:5], None])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [
    {}, {"small_block": 1}, {"small_block": 1, "slice_rows": 60, "finish_below": 20},
    {"small_block": 1, "slice_rows": 100, "max_candidates": 3000},
])
@pytest.mark.parametrize("threshold", [85.0, 72.5])
def test_clusters_are_the_plain_loop(spark, threshold, limits):
    rows = random_rows(300, 11)
    df = spark.createDataFrame(rows, "_ord long, state string, city string, org_name string")
    got = resolve.fuzzy_clusters(df, threshold=threshold, **limits).collect()
    assert {r.ord: r.cluster for r in got if r.ord != r.cluster} == brute_clusters(rows, threshold)


def test_grams_find_every_similar_pair(spark):
    rnd = random.Random(2)
    names = list({"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 16))) for _ in range(150)})
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(names)], "block_id long, ord long, name string")
    got = {(r.i, r.j) for r in sim.similar_pairs(df, df, 80.0).collect()}
    want = {
        (i, j) for i, a in enumerate(names) for j, b in enumerate(names)
        if i < j and 200 * dp_lcs(a, b) >= 80 * (len(a) + len(b))
    }
    assert got == want and len(want) > 50


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=150), st.sampled_from([68, 72.5, 80, 85, 90.5, 100]))
def test_rare_grams_have_no_letter_in_common_and_are_the_rarest(name, threshold):
    cost = lambda gram: sum(map(ord, gram)) % 50 + 1.0
    picks = sim.picks_needed(len(name), threshold)
    found = sim.rare_grams(name, picks, cost)
    used = [i for at, z in found for i in range(at, at + z)]
    assert len(found) == picks and len(used) == len(set(used)) and max(used) < len(name)
    counts = [cost(name[at:at + z]) for at, z in found]
    assert counts == sorted(counts)
    if len(name) <= 9:
        shortest = 1 if len(name) < 2 * picks else 2

        def best(start, left):
            if not left:
                return 0
            ways = [cost(name[i:i + z]) + best(i + z, left - 1) for i in range(start, len(name))
                    for z in range(shortest, 5) if i + z <= len(name)]
            return min(ways, default=float("inf"))

        assert sum(counts) == best(0, picks)


@pytest.mark.parametrize("threshold", [68.0, 75.0, 85.0, 92.0])
def test_rare_grams_find_names_that_differ_everywhere(spark, threshold):
    """Names with letters added, removed and replaced at any place, up to the limit, among common words."""
    rnd = random.Random(int(threshold))
    names = set()
    for _ in range(60):
        base = " ".join(sorted(rnd.choice(WORDS) for _ in range(rnd.randint(1, 5))))
        for _ in range(4):
            text = list(base)
            for _ in range(rnd.randint(0, 6)):
                at = rnd.randrange(len(text) + 1)
                text[at:at + rnd.randint(0, 1)] = rnd.choice(["", "a", "e", "xq", " ", "é", "漢"])
            names.add("".join(text))
    names = sorted(names) + ["x" * 200, "x" * 190 + "yy", "ab" * 90, "ab" * 88 + "c"]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(names)], "block_id long, ord long, name string")
    got = {(r.i, r.j) for r in sim.similar_pairs(df, df, threshold).collect()}
    want = {(i, j) for j, b in enumerate(names) for i, a in enumerate(names[:j]) if sim.Matcher(a).similar(b, threshold)}
    assert got == want and len(want) > 25


def titled(n, seed=3):
    """Names as they come: common words, and rarer ones the more names there are."""
    rnd = random.Random(seed)
    rare = ["".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(4, 9))) for _ in range(int(40 * n**0.6))]
    names = set()
    while len(names) < n:
        names.add(" ".join(sorted([*rnd.sample(WORDS, 2), rnd.choice(rare), rnd.choice(rare)])))
    return sorted(names)


def test_few_pairs_meet_and_fewer_are_looked_at(spark):
    for n in (400, 4000):
        df = spark.createDataFrame([(0, i, x) for i, x in enumerate(titled(n))], "block_id long, ord long, name string")
        pairs = n * (n - 1) / 2
        assert sim.candidates(df, df, 85.0).count() < pairs / 1000
        assert sim.candidate_count(df, df, 85.0, sim.gram_counts(df, 85.0)) < pairs / 2


def test_clusters_are_not_transitive(spark):
    """The second is like the first, the third like the second only: the third stays alone."""
    rows = [(0, "abcdefghijklmnopqrst"), (1, "abcdefghijklmnopqrXY"), (2, "abcdefghijklmnoWVrXY")]
    df = spark.createDataFrame([(o, "KY", "c", n) for o, n in rows], "_ord long, state string, city string, org_name string")
    got = {r.ord: r.cluster for r in resolve.fuzzy_clusters(df).collect()}
    assert got == {1: 0}


def test_word_order_counts_not_case_does(spark):
    rows = [(0, "Post Legion"), (1, "Legion  Post"), (2, "LEGION POST"), (3, "legion post")]
    df = spark.createDataFrame([(o, "KY", "c", n) for o, n in rows], "_ord long, state string, city string, org_name string")
    assert {r.ord: r.cluster for r in resolve.fuzzy_clusters(df).collect()} == {0: 0, 1: 0}


def test_alike_names_never_meet_in_all_pairs(spark, monkeypatch):
    """Numbered names in one place, all alike: the slices shrink until few anchors take the rest."""
    paired = []
    plain = sim.similar_pairs
    monkeypatch.setattr(sim, "similar_pairs", lambda a, b, t, c: (paired.append(plain(a, b, t, c)), paired[-1])[1])
    rows = [(i, "KY", "c", f"Member Club Number {i:05d}") for i in range(1500)]
    df = spark.createDataFrame(rows, "_ord long, state string, city string, org_name string")
    got = resolve.fuzzy_clusters(df, small_block=10, slice_rows=16, max_candidates=20_000).collect()
    assert {r.ord: r.cluster for r in got} == brute_clusters(rows, 85.0)
    assert sum(p.count() for p in paired) < 1500 * 1499 / 2 / 20


def test_a_third_of_the_rows_are_one_name(spark):
    df = spark.range(3000).selectExpr(
        "id as _ord", "'KY' as state", "'c' as city", "if(id % 3 = 0, 'american legion', concat(id, ' home ', id * 7)) as org_name",
        "concat('s', id % 2) as data_sources")
    out = resolve.merge_fuzzy(df, small_block=100)
    first = out.filter("_ord = 0").first()
    assert first.data_sources == "s0;s1"
    assert out.filter("org_name = 'american legion'").count() == 1


def test_merged_record(spark):
    rows = [(2, "k", None, "", "b;a"), (1, "k", None, None, ""), (3, "k", "x", "z", None), (4, "u", None, "y", "z;a;z")]
    df = spark.createDataFrame(rows, "_ord long, ein string, a string, b string, data_sources string")
    got = {r.ein: tuple(r) for r in resolve.merge_exact(df).collect()}
    assert got["k"] == (1, "k", "x", "", "a;b")
    assert got["u"] == (4, "u", None, "y", "z;a;z")  # alone, so its list stays as it is


def test_exact_keeps_rows_without_key_and_is_idempotent(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "a"), (6, "a")]
    df = spark.createDataFrame(rows, "_ord long, ein string").withColumn("data_sources", F.lit("s"))
    once = resolve.merge_exact(df)
    assert sorted(r._ord for r in once.collect()) == [1, 2, 3, 4, 5]
    assert sorted(map(tuple, resolve.merge_exact(once).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_domain(spark):
    rows = [(1, "https://www.x.org/a"), (2, "HTTP://X.org"), (3, "x.org"), (4, ""), (5, None), (6, "https://shop.com/1"),
            (7, "https://shop.com/2"), (8, "x.org")]
    df = spark.createDataFrame(rows, "_ord long, website string").withColumn("data_sources", F.lit("s"))
    ids = lambda **o: sorted(r._ord for r in resolve.merge_domain(df, **o).collect())
    assert ids() == [1, 3, 4, 5, 6, 8]
    assert ids(shared_domains=("shop.com",)) == [1, 3, 4, 5, 6, 7, 8]
    assert ids(drop_unparseable=True) == [1, 4, 5, 6]


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame(random_rows(200, 4), "_ord long, state string, city string, org_name string").withColumn(
        "data_sources", F.concat(F.lit("s"), (F.col("_ord") % 3).cast("string"))
    ).withColumn("ein", F.lit(None).cast("string")).withColumn("website", F.lit(None).cast("string"))
    results = []
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        results.append(sorted(map(str, resolve.deduplicate(df.repartition(int(partitions))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
