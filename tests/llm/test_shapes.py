"""Mixing, packing, chats and quality rules; the pipeline and the SQL counterparts."""

import inspect
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rosterline.llm import chats, mixing, outliers, packing
from rosterline.llm.queries import QUERIES, SQL
from tests.compare import database, difference
from tests.llm import plain
from tests.llm.conftest import prose

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), database(SF), SQL[name]) is None


def plain_targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), share * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return goal | {s: level * weight[s] for s in open_}
        for s in over:
            goal[s] = cap * sizes[s]
            left -= goal[s]
        open_ -= over


def test_mixing_odd_rows(make, odd_rows):
    rows = [*odd_rows, *((100 + i, prose(i, 5 + i % 40), "en", f"s{i % 7}", 1) for i in range(300))]
    docs = make(rows)
    got = mixing.mix(docs, range_rows=20).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(plain.WORD.findall(text or ""))
    goals = plain_targets(sizes)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken.setdefault((r.source_size, round(r.target, 6)), 0)
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert {k: v for k, v in taken.items()} == {
        (sizes[s], round(goals[s], 6)): sum(int(goals[x] + 1e-9) for x in sizes if (sizes[x], round(goals[x], 6)) == (sizes[s], round(goals[s], 6)))
        for s in sizes}
    again = mixing.mix(docs, range_rows=7).collect()
    key = lambda rows: sorted((repr(r.doc_id), r.size, r.taken) for r in rows if r.doc_id != 2)
    assert key(got) == key(again)
    out = mixing.take(docs)
    assert out.columns == docs.columns
    assert sum(len(plain.WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in got)


def test_mixing_spreads_missing_and_repeated_ids(make):
    """No range, and so no window's task, holds more than a few times its share of rows."""
    rows = [(None, f"a b {i}", "en", "x", 1) for i in range(400)] + [(7, "c d e", "en", "x", 1)] * 300
    rows += [(i, "one", "en", "x" if i % 2 else "y", 1) for i in range(1000, 1300)]
    docs = make(rows)
    sized = docs.select("doc_id", "source", F.length("text").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("n")).cast("binary")).alias("key"),
                        F.monotonically_increasing_id().alias("_row"))
    ranged = mixing.spread(sized, 50, 20)
    assert ranged.count() == len(rows) and max(r["count"] for r in ranged.groupBy("range").count().collect()) <= 80
    assert ranged.select("_row").distinct().count() == len(rows)
    calm = sized.filter("doc_id >= 1000")
    assert mixing.spread(calm, 15, 20).drop("range").exceptAll(calm).isEmpty()
    got = mixing.mix(docs, range_rows=20).collect()
    again = mixing.mix(docs, range_rows=20).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, again))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for target in {r.target for r in got}:
        assert sum(r.taken for r in got if r.target == target) == int(target + 1e-9)


def test_mixing_empty_and_wordless(make):
    assert mixing.mix(make([])).collect() == [] and mixing.take(make([])).collect() == []
    got = mixing.mix(make([(1, "", "en", "a", 0), (2, None, "en", None, 0)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2
    clash = make([(1, "a b c", "s", 1, 2, 3)], "doc_id long, text string, source string, taken int, size int, `row` int")
    assert mixing.take(clash).columns == clash.columns


def check_pieces(pieces, rows, capacity=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_row, by_sequence = {}, {}
    for p in pieces:
        by_row.setdefault((p.doc_id, p._row), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    got, want = [], []
    for (doc_id, _), own in by_row.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        ids = b"".join(bytes(p.ids) for p in own)
        assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length and p.doc_tokens == len(ids) // 4 for p in own)
        got.append((repr(doc_id), ids))
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((repr(doc_id), np.array(ids, "<u4").tobytes()))
    assert sorted(got) == sorted(want)
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        filled = sum(p.length for p in own)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist() and filled <= capacity
        padding += 0 if filled & (filled - 1) == 0 else capacity - filled
    return padding


def test_packing_odd_rows(make, odd_rows):
    assert check_pieces(packing.pack(make(odd_rows)).collect(), odd_rows) == 0
    assert packing.pack(make([])).collect() == []


def test_packing_round_trip_of_strange_texts(make):
    import random

    r = random.Random(1)
    letters = "abcXYZ 0123'sS'LLéÉßñÑ\t\n.,#$%&|<>!½²ªº×÷ÆŒœĲŉǅ\xa0\x85\x1cİΣσς漢字é­_-"
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 60))), "en", "a", 1) for i in range(400)]
    assert check_pieces(packing.pack(make(rows)).collect(), rows) == 0


def test_cuts():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000, 10**6 + 1):
        pieces = packing.cuts(n, 2048)
        assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 2048 for p in pieces) and len(pieces) <= n // 2048 + 11


def test_chats(make):
    schema = "conv_id long, turn long, role string, text string, extra int"
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", None)
    turns = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [("user", "hi"), ("assistant", "")], 6: [("user", "hihello")], 7: [(None, "hi")], None: [b]}
    rows = [(i, t, role, text, 0) for i, said in turns.items() for t, (role, text) in enumerate(said)]
    rows += [rows[0], (8, None, "user", "x", 0), (8, 1, "user", "y", 0), (9, None, "user", "x", 0)]
    got = {r.conv_id: (r.n_turns, r.text) for r in chats.render(make(rows, schema)).collect()}
    assert sorted(map(repr, got)) == sorted(map(repr, [3, 5, 6, 7, 8, None]))
    assert got[3] == (3, "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\n\n") and got[7] == (1, "<|unknown|>\nhi\n")
    assert chats.render(make([], schema)).collect() == []


def test_chats_without_id_stay_apart(make):
    """Rows without an id are conversations of one turn: equal ones collapse, none mix, none gather."""
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 1, "user", "yes"), (None, None, "user", "yes"), (None, 2, "user", "no"), (None, None, None, None)]
    rows += [(None, i, "user", f"t{i % 50}") for i in range(300)]
    rows += [(1, 1, "user", "no"), (1, 2, "user", "x"), (2, 1, "user", "t3")]
    got = chats.render(make(rows, schema)).collect()
    # "no" begins conversation 1, and "t3" is conversation 2.
    want = [(1, 2, "no"), (2, 1, "t3"), (None, 1, "yes"), (None, 1, "")] + [(None, 1, f"t{i}") for i in range(50) if i != 3]
    assert sorted((repr(r.conv_id), r.n_turns, r.text.split("\n")[1]) for r in got) == sorted((repr(i), n, t) for i, n, t in want)


def test_quality_counts(make, odd_rows):
    rows = [*odd_rows, *((200 + i, " ".join(prose(i % 3, 12 + i).split() * (1 + i % 3)) + "\n# x | <b>\n# x | <b>\n \n", "en", "a", 1) for i in range(60))]
    got = outliers.judge(make(rows)).collect()
    key = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((repr(r.doc_id), *(r[k] for k in key)) for r in got) == sorted((repr(r[0]), *plain.base_counts(r[1])) for r in rows)
    assert not any(r.kept for r in got if r.base_failed)
    assert outliers.judge(make([])).collect() == []


def plain_distances(x, core=0.75, steps=3):
    """The same estimate for one group in numpy."""
    floor = np.array(outliers.FLOOR) * outliers.SCALE
    bin_ = outliers.SCALE // 64

    def quantile(v, share):
        v = np.sort(v)
        return v[int(np.ceil(len(v) * share)) - 1]

    binned = x // bin_ * bin_
    m = np.array([quantile(binned[:, d], 0.5) for d in range(x.shape[1])], float)
    off = np.floor(np.abs(x - m) / bin_) * bin_
    s = np.maximum(np.array([quantile(off[:, d], 0.5) for d in range(x.shape[1])]) * 1.4826, floor)
    distance = (((x - m) / s) ** 2).sum(axis=1)
    for _ in range(steps):
        place = np.floor(np.log2(distance + 1e-3) * 32)
        near = x[place <= quantile(place, core)]
        cov = near.T @ near / len(near) - np.outer(near.mean(0), near.mean(0)) + np.diag(floor**2)
        y = np.linalg.solve(np.linalg.cholesky(cov), (x - near.mean(0)).T)
        distance = (y**2).sum(axis=0)
    return distance


def test_outliers_equal_numpy_and_reject_junk(make):
    rows = [(i, prose(i, 60 + i % 90), "en", f"s{i % 2}", 1) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(i, 80).split()), "en", f"s{i % 2}", 1) for i in range(40)]
    rows += [(2000 + i, prose(i, 70), "de", "rare", 1) for i in range(5)]
    docs = make(rows)
    got = {r.doc_id: r for r in outliers.judge(docs).collect()}
    assert all(not got[1000 + i].kept for i in range(40)) and all(got[i].kept for i in range(400))
    # Too few rows for an estimate: they stay.
    assert all(got[2000 + i].kept and got[2000 + i].distance2 is None for i in range(5))
    moved = outliers.transformed(outliers.measure(docs)).filter("source = 's0' and not base_failed").collect()
    want = plain_distances(np.array([[r[c] for c in outliers.STATISTICS] for r in moved], float))
    assert np.allclose([got[r.doc_id].distance2 for r in moved], want, rtol=1e-6, atol=1e-6)


def test_outliers_of_a_lone_small_source(make):
    """A source under the least group size is held against its whole language, and changes no other's estimate."""
    rows = [(i, prose(i, 60 + i % 90), "en", "large", 1) for i in range(300)]
    junk = " ".join(w + "###" for w in prose(7, 80).split())
    rare = [(1000 + i, prose(500 + i, 70), "en", "rare", 1) for i in range(9)] + [(2000, junk, "en", "rare", 1)]
    alone = {r.doc_id: r.distance2 for r in outliers.judge(make(rows)).collect()}
    docs = make([*rows, *rare])
    got = {r.doc_id: r for r in outliers.judge(docs).collect()}
    assert not got[2000].kept and all(got[1000 + i].kept for i in range(9)) and all(got[i].kept for i in range(300))
    assert all(np.isclose(got[i].distance2, alone[i]) for i in range(300))
    moved = outliers.transformed(outliers.measure(docs)).filter("not base_failed").collect()
    want = plain_distances(np.array([[r[c] for c in outliers.STATISTICS] for r in moved], float))
    assert all(np.isclose(got[r.doc_id].distance2, d) for r, d in zip(moved, want) if r.source == "rare")


def test_native_operators_run_no_python(spark):
    for name in ("op8_chat_format", "op10_quality_rules"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def plain_pipeline(spark, sf_dir):
    """The rows each stage keeps, from the plain versions and the operators' own models."""
    from rosterline.llm import language

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vectors = language.profiles(docs)[1]
    least = inspect.signature(language.drop_unknown).parameters["least"].default
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    rows = [r for r in rows if language.resembles(r[1], vectors, least)]
    best = {min(m)[3] for m in plain.equal_groups([r[:2] for r in rows]).values()}
    rows = [r for k, r in enumerate(rows) if k in best]
    part, _ = plain.near_components([r[:2] for r in rows], 80)
    least = {}
    for k, p in enumerate(part):
        least.setdefault(p, k)
    return [rows[k] for k in sorted(least.values())]


def test_pipeline(spark):
    from rosterline.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        outs[name] = docs
        assert name == "pack" or docs.columns == columns
    want = plain_pipeline(spark, SF)
    assert sorted(r.doc_id for r in outs["near_dedup"].collect()) == sorted(r[0] for r in want)
    sizes = {}
    for r in want:
        sizes[r[3]] = sizes.get(r[3], 0) + len(plain.WORD.findall(r[1]))
    mixed = outs["mix_sources"].collect()
    taken = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(plain.WORD.findall(r.text))
    assert taken == {s: int(t + 1e-6) for s, t in plain_targets(sizes).items()}
    tokens = {r.doc_id: 0 for r in mixed}
    pieces = outs["pack"].collect()
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert all(tokens.values())
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_odd_rows_and_empty_tables(spark, make, odd_rows, stage):
    docs = make([(*r, 1, "x") for r in odd_rows], "doc_id long, text string, lang string, source string, n_chars long, kept int, size string")
    assert stage(spark, docs, SF).count() > 0
    assert stage(spark, docs.limit(0), SF).count() == 0
