"""Exact, near and substring deduplication against brute force."""

import bisect
import random

import numpy as np
import pytest

from rosterline.llm import exact, graph, neardup, suffixes
from tests.llm import plain
from tests.llm.conftest import LOREM, SCHEMA, prose


def check_equal(docs, rows, **options):
    groups = plain.equal_groups([r[:2] for r in rows])
    want = []
    for body, members in groups.items():
        best = min(members)
        for m in members:
            doc_id = rows[m[3]][0]
            want.append((doc_id, rows[best[3]][0], len(members), plain.sha(body)))
    got = exact.group_equal(docs, **options).collect()
    key = repr
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_odd_rows(make, odd_rows):
    check_equal(make(odd_rows), odd_rows)


@pytest.mark.parametrize("options", [
    {"key_bits": 3}, {"bucket_bytes": 500}, {"bucket_bytes": 500, "key_bits": 5, "held_bytes": 1000}, {"held_bytes": 1}])
def test_exact_collisions_and_splits(make, options):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 6))) + " " * r.randint(0, 2), "en", "a", 1) for i in range(300)]
    check_equal(make(rows), rows, **options)


def test_directory_doubles_only_overfull_buckets(spark):
    body = bytearray(100)
    keys = [k << 56 for k in range(256)] + [0] * 300
    entries = spark.createDataFrame([(k - 2**63, body) for k in keys], "key long, body binary")
    buckets = exact.directory(entries, 2_000)
    assert sum(2.0**-d for d, _ in buckets) == 1
    lower = [(p << (64 - d)) for d, p in buckets]
    assert lower == sorted(lower) and lower[0] == 0
    # Key 0 has 301 entries: it is split until it is alone with others that fit, no further.
    assert max(d for d, _ in buckets) <= 8 < len(buckets)


def test_directory_is_bounded(spark, monkeypatch):
    """Buckets grow with the input, and no count is larger than stated."""
    r = random.Random(3)
    keys = [r.getrandbits(64) for _ in range(5000)] + [7 << 40] * 500 + [(7 << 40) + 8 * k for k in range(40)]
    entries = spark.createDataFrame([(k - 2**63, bytearray(36)) for k in keys], "key long, body binary").cache()
    collected = []
    real = type(entries).collect
    monkeypatch.setattr(type(entries), "collect", lambda df: collected.append(0) or (lambda rows: collected.append(len(rows)) or rows)(real(df)))
    for most in (4, 16, 64):
        buckets = exact.directory(entries, 100, most)
        assert sum(2.0**-d for d, _ in buckets) == 1 and max(collected) <= 8 * most
        collected.clear()
        lower = sorted(p << (64 - d) for d, p in buckets)
        held = {}
        for k in keys:
            held.setdefault(bisect.bisect_right(lower, k), []).append(k)
        limit = max(100, -(-len(keys) * 100 // most))
        assert all(len(ks) * 100 <= limit or len(set(ks)) == 1 for ks in held.values())


def test_exact_empty_table_and_clashing_names(make, spark):
    assert exact.group_equal(make([])).collect() == []
    rows = [(1, "x", 5, 6, 7), (2, " x", 5, 6, 7)]
    docs = make(rows, "doc_id long, text string, _row long, kept int, `row` long")
    kept = exact.drop_equal(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, " x", 5, 6, 7)]


def check_near(docs, rows):
    part, sets = plain.near_components([r[:2] for r in rows])
    least = {}
    for k, p in enumerate(part):
        least[p] = min(least.get(p, (True, 0)), (rows[k][0] is None, rows[k][0] or 0))
    want = []
    for k, p in enumerate(part):
        none, doc_id = least[p]
        component = None if none else doc_id
        want.append((rows[k][0], len(sets[k]), component, rows[k][0] == component))
    got = neardup.group_near(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r.first for r in got) == len(set(part))


def test_near_odd_rows(make, odd_rows):
    check_near(make(odd_rows), odd_rows)


def test_near_chains_and_borderline(make):
    """Families whose members are linked through each other, and pairs right at the limit."""
    r = random.Random(7)
    rows, n = [], 0
    for family in range(25):
        words = [r.choice(LOREM) + r.choice(LOREM) for _ in range(r.choice([8, 40, 120]))]
        for _ in range(6):
            rows.append((n, " ".join(words), "en", "a", 1))
            n += 1
            words = list(words)
            for _ in range(r.choice([0, 1, 1, 2])):
                words[r.randrange(len(words))] = r.choice(LOREM) + str(r.randint(0, 9))
    r.shuffle(rows)
    check_near(make(rows), rows)


def test_near_exact_limit(make):
    # 23 words have 19 shingles; one new word at the end leaves 18 in common out of 20: 90 %; three: 16 of 22.
    words = prose(1, 23).split()
    rows = [(1, " ".join(words), "en", "a", 1), (2, " ".join([*words[:-1], "x"]), "en", "a", 1), (3, " ".join([*words[:-3], "x", "y", "z"]), "en", "a", 1)]
    check_near(make(rows), rows)


def test_near_empty_table_and_clashing_names(make):
    assert neardup.group_near(make([])).collect() == []
    docs = make([(1, prose(1, 30), 3, 4), (1, prose(1, 30), 3, 4)], "doc_id long, text string, first int, class int")
    assert [tuple(r) for r in neardup.drop_near(docs).collect()] == [(1, prose(1, 30), 3, 4)]


def test_signature_fills_every_bin():
    for n in (1, 2, 5, 50, 5000):
        hashes = np.unique(neardup.mix64(np.arange(n, dtype=np.uint64)))
        values = neardup.signature(hashes)
        assert len(values) == 128 and set(values.tolist()) <= set(hashes.tolist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 105), (7, 200), (300, 400)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 0, 100: 100, 101: 100, 105: 100, 300: 300, 400: 300}


def check_repeats(docs, rows, **options):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    want = sorted((rows[k][0], len((rows[k][1] or "").encode()), n, runs, plain.sha(kept)) for k, (kept, n, runs) in zip(
        order, plain.without_repeats([rows[k][:2] for k in order])) if rows[k][0] is not None)
    got = suffixes.remove_repeats(docs, **options).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None) == want
    assert all(plain.sha(bytes(r.kept)) == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_repeats_odd_rows(make, odd_rows):
    check_repeats(make(odd_rows), odd_rows)


@pytest.mark.parametrize("options", [{"bucket_anchors": 10}, {"bucket_anchors": 200_000}, {"owner_segments": 0}, {"bucket_anchors": 100, "owner_segments": 20}])
def test_repeats_planted(make, options):
    """Copies of passages at lengths around the limit, periodic texts, and passages with different neighbours."""
    r = random.Random(3)
    passages = [prose(1000 + i, 60)[:n] for i, n in enumerate([98, 99, 100, 101, 130, 167, 168, 169, 300])]
    rows = []
    for i in range(60):
        parts = [prose(i, r.randint(0, 30))]
        for _ in range(r.randint(0, 4)):
            parts += [r.choice(passages), prose(r.randint(0, 10**6), r.randint(0, 5))]
        rows.append((i * 3 % 61, r.choice(["", " ", "é"]).join(parts), "en", "a", 1))
    rows += [(100, "a" * 500, "en", "a", 1), (101, "ab" * 300 + "c", "en", "a", 1), (102, "abcdefg" * 90, "en", "a", 1), (103, "b" + "a" * 150, "en", "a", 1)]
    check_repeats(make(rows), rows, **options)


def test_repeats_of_a_hot_passage(make, monkeypatch):
    """One passage in very many documents, each with other neighbours: no owner gets more than its limit."""
    r = random.Random(4)
    passage = prose(5, 40)[:180]
    rows = [(i, prose(10_000 + i, r.randint(2, 8)) + passage + prose(20_000 + i, r.randint(2, 8)), "en", "a", 1) for i in range(3000)]
    rows += [(None, passage, None, None, None), (5000, passage * 3, "en", "a", 1)]
    spread = []
    real = suffixes.spread_repeats
    monkeypatch.setattr(suffixes, "spread_repeats", lambda segments: spread.append(segments.agg({"n": "sum"}).first()[0]) or real(segments))
    check_repeats(make(rows), rows, owner_segments=500)
    assert spread[0] > 1000


def test_repeats_in_chunks_of_long_texts(make, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_TEXT", 300)
    passages = [prose(1000 + i, 60)[:150] for i in range(4)]
    r = random.Random(6)
    rows = [(i, "".join([prose(i, r.randint(0, 60)), r.choice(passages), prose(i + 999, 3)]), "en", "a", 1) for i in range(80)]
    check_repeats(make(rows), rows, bucket_anchors=50)


def test_repeats_across_block_bounds(make, monkeypatch):
    text = prose(77, 200_000)
    rows = [(1, text, "en", "a", 1), (2, "x" + text[400_000:1_200_000] + "y" + text[:3000], "en", "a", 1), (3, "short", "en", "a", 1)]
    check_repeats(make(rows), rows)


def test_deep_shallow_orders_like_sorted():
    r = np.random.default_rng(1)
    rows = r.integers(0, 3, (500, 40)).astype(np.uint8)
    rows[100:400, :30] = rows[0, :30]
    rows[450:] = rows[449]
    words = suffixes.as_words(rows, np.zeros(500, np.uint64))
    for shallow in (1, 2, 9):
        groups = suffixes.deep_shallow(words, shallow)
        order = sorted(set(bytes(x) for x in rows))
        assert [order.index(bytes(x)) for x in rows] == groups.tolist()


def test_repeats_empty_table(make):
    assert suffixes.remove_repeats(make([], SCHEMA)).collect() == []


def family(seed, members, shared, own, planted):
    """Texts that share ``shared`` shingles or so and have ``own`` words of their own; ``planted`` pairs differ by few."""
    base = [f"t{seed}x{i}" for i in range(shared)]
    texts = [base + [f"o{seed}x{m}x{i}" for i in range(own)] for m in range(members)]
    for k in range(planted):
        a, b = 2 * k, 2 * k + 1
        texts[b] = texts[a][:-planted_words(k)] + [f"p{seed}x{k}x{i}" for i in range(planted_words(k))]
    return [" ".join(words) for words in texts]


def planted_words(k):
    return 4 + k % 8


def test_near_family_just_below_the_limit(make):
    """All of a family resemble each other at 0.80; only planted pairs are linked, and none is lost."""
    texts = family(1, 260, 200, 25, 20) + family(2, 40, 60, 30, 5)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    check_near(make(rows), rows)


def test_near_large_family(make):
    texts = family(3, 3000, 200, 25, 300)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in neardup.group_near(make(rows)).collect()}
    sets = [plain.shingles(t) for t in texts[:600]]
    want = {i: i for i in range(3000)}
    for k in range(300):
        a, b = sets[2 * k], sets[2 * k + 1]
        if 100 * len(a & b) >= 85 * len(a | b):
            want[2 * k + 1] = 2 * k
    assert got == want and sum(a != b for a, b in want.items()) > 100


def test_rare_shingles_find_all_pairs(make):
    """Texts made of few passages, where even the rarest shingles are in many of them."""
    r = random.Random(8)
    passages = [prose(500 + i, 12) for i in range(14)]
    rows = [(i, " ".join(r.sample(passages, 8)), "en", "a", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " " + prose(900 + i, 3), "en", "a", 1) for i in range(0, 60, 3)]
    texts = make(rows).selectExpr("doc_id as _row", "text").cache()
    mixed = texts.selectExpr("_row as class", "_row as root")
    got = {(x.a, x.b) for x in neardup.prefix_pairs(mixed, texts, 60).collect()}
    sets = {i: plain.shingles(t) for i, t, *_ in rows}
    want = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])}
    assert want <= got and len(want) > 15


def test_rare_shingles_pass_few_pairs_of_a_family(make):
    """Copies of one text, each changed in places of its own: all resemble each other at 0.76, few are linked, none of those is lost."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for m in range(400):
        # Every eighth is the one before with one change more.
        words, changes = (texts[-1].split(), 1) if m % 8 == 7 else (list(base), 2)
        for k in range(changes):
            words[r.randrange(150)] = f"m{m}x{k}"
        texts.append(" ".join(words))
    docs = make([(m, t, "en", "a", 1) for m, t in enumerate(texts)]).selectExpr("doc_id as _row", "text").cache()
    got = {(x.a, x.b) for x in neardup.prefix_pairs(docs.selectExpr("_row as class", "_row as root"), docs, 80).collect()}
    sets = [plain.shingles(t) for t in texts]
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(400) for j in range(i + 1, 400)}
    want = {pair for pair, x in alike.items() if x >= 0.8}
    assert want <= got and all((8 * k + 6, 8 * k + 7) in want for k in range(50))
    assert sum(x > 0.7 for x in alike.values()) > 50_000 and len(got) < 2 * len(want) < 20_000


@pytest.mark.parametrize("size", [1, 40, 1000, 30_000])
def test_parities_differ_in_no_more_places_than_sets(size):
    r = np.random.default_rng(size)
    for changed in (0, 1, size // 4, size):
        x = np.unique(r.integers(0, 2**64, size, np.uint64))
        y = np.unique(np.concatenate([x[changed:], r.integers(0, 2**64, changed, np.uint64)]))
        places = np.bitwise_count((neardup.parities(x) ^ neardup.parities(y)).view(np.uint64)).sum()
        differ = len(np.setxor1d(x, y))
        assert places <= differ and (changed > 0 or places == 0)
        assert size != 1000 or changed != 250 or places > 0.6 * differ


def shuffled_texts(texts):
    """Records that the plan of ``texts``, once run, wrote to exchanges that carry the text."""
    plan = texts._jdf.queryExecution().executedPlan()
    texts._jdf.queryExecution().toRdd().count()
    todo, found = [plan.executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if node.nodeName() == "Exchange" and "text#" in node.output().mkString(" "):
            found += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_near_shuffles_few_other_texts(make, spark, monkeypatch):
    """Where the ids of texts that share a bucket are too many to broadcast, the other texts still stay where they are."""
    rows = [(i, prose(i, 40), "en", "a", 1) for i in range(2000)] + [(5000 + i, prose(i, 40) + " x", "en", "a", 1) for i in range(0, 2000, 40)]
    plans = []
    real = neardup.written
    monkeypatch.setattr(neardup, "written", lambda df: (df.columns == ["_row", "text"] and plans.append(df)) or real(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check_near(make(rows), rows)
        assert 100 <= shuffled_texts(plans[0]) < 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bits, piece", [(15, 15), (16, 15), (25, 15), (3, 2)])
def test_marked_loses_no_row(make, monkeypatch, bits, piece):
    """At any size of the bitmap all ids pass, and the exact join leaves them alone."""
    monkeypatch.setattr(neardup, "FILTER_BITS", bits)
    monkeypatch.setattr(neardup, "PIECE_BITS", piece)
    rows = make([(i, f"t{i}") for i in range(-3000, 3000)], "_row long, text string")
    ids = rows.filter("_row % 7 = 0").select("_row")
    want = {i for i in range(-3000, 3000) if i % 7 == 0}
    passed = {r._row for r in neardup._marked(rows, ids).collect()}
    assert want <= passed and (bits < 25 or len(passed) < len(want) + 50)
    assert sorted(tuple(r) for r in neardup._texts_of(rows, ids).collect()) == sorted((i, f"t{i}") for i in want)
    assert neardup._texts_of(rows, ids.limit(0)).count() == 0
