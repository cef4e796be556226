"""Classifiers: held-out accuracy on the supplied tables, and defined results for odd rows."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterline.llm import language, quality, toxicity
from rosterline.llm.queries import QUERIES
from tests.llm import plain
from tests.llm.conftest import prose

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op1_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97
    assert got.filter("score < 0 or score > 1").isEmpty()


def test_language_odd_rows(make, odd_rows):
    got = language.identify(make(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by_id[i].lang_pred for i in (3, 4, 5, 8)] == ["und"] * 4 and by_id[9].lang_pred != "und"
    assert all(r.held_out for r in got if r.doc_id is None)
    assert language.identify(make([])).collect() == []
    kept = language.drop_unknown(make(odd_rows))
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 6, 7} and {3, 4, 5, 8}.isdisjoint(r.doc_id for r in kept.collect())


def test_language_rejects_what_no_row_teaches(spark, make):
    rng = np.random.default_rng(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    clean = {r[0] for r in rows if r[2] != "fr" and len(r[1]) > 600}
    unlearned = {r[0] for r in rows if r[2] == "fr" and len(r[1]) > 600}
    gibberish = {10**6 + k for k in range(50)}
    planted = [(k, " ".join("".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 10, 80)), None, "x", 1) for k in gibberish]
    script = [(10**7, "Вчера вечером мы долго гуляли по берегу реки и говорили о том, что будет завтра с нашим городом. " * 3, None, "x", 1)]
    rows = [(*r[:2], None if r[2] == "fr" else r[2], *r[3:]) for r in rows]
    kept = {r.doc_id for r in language.drop_unknown(make([*rows, *planted, *script])).select("doc_id").collect()}
    assert not kept & gibberish and 10**7 not in kept
    assert len(kept & unlearned) <= 0.05 * len(unlearned) and len(unlearned) > 50
    assert len(kept & clean) >= 0.995 * len(clean)


def test_language_equals_plain_version(spark, make, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 400").orderBy("doc_id").limit(60)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [r if len(r[1] or "") < 2000 else (r[0], r[1][:500], *r[2:]) for r in odd_rows]
    letters = np.random.default_rng(20240229).integers(0, 2, (language.ALPHABET, language.DIMENSIONS), np.int8) * 2 - 1
    want = plain.languages([r[:3] for r in rows], letters.tolist(), lambda c: int(language.symbols()[ord(c)]))
    got = language.identify(make(rows, files=1)).collect()
    assert len(got) == len(rows) and len({w[0] for w in want}) > 3
    for r, row, (name, cosine) in zip(got, rows, want):
        assert r.doc_id == row[0] and abs(r.score - (1 + cosine) / 2) < 1e-5 and r.lang_pred == name


def test_language_without_labels(make):
    docs = make([(1, "some text", None, "a", 1), (2, "12", None, "a", 1)])
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"und"}
    assert [r.doc_id for r in language.drop_unknown(docs).collect()] == [1]
    # What a learner's fold would teach is not a prediction's input: same text, other language column.
    again = make([(1, "some text", "en", "a", 1), (1, "some text", "de", "b", 1)])
    assert len({(r.lang_pred, r.score) for r in language.identify(again).collect()}) == 1


def test_language_vectors_are_bound_and_permuted():
    table = language.grams()
    a, b, c = 3, 7, 9
    code = (a * language.ALPHABET + b) * language.ALPHABET + c
    swapped = (b * language.ALPHABET + a) * language.ALPHABET + c
    assert set(np.unique(table[code])) == {-1, 1}
    assert abs(int(table[code].astype(int) @ table[swapped].astype(int))) < language.DIMENSIONS // 4
    assert language.codes("Ab, c").tolist() == language.codes("ab c").tolist() != language.codes("a bc").tolist()


def test_language_workers_hold_no_table_of_all_grams():
    """Vectors of a text's n-grams are the table's; neither learning nor judging keeps or makes the 54 MB of all."""
    some = np.array([0, 1, 47, 48, 2303, 2304, 7001, language.ALPHABET**language.N - 1])
    assert np.array_equal(language.grams(some), language.grams()[some])
    texts = [prose(k, 300) for k in range(40)] + ["".join(map(chr, range(0x4E00 + k, 0x6E00, 7))) for k in range(7)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    language._halves.cache_clear()
    language.symbols()
    tracemalloc.start()
    try:
        bundle = np.array(next(language._bundles(iter([batch])))["bundle"].to_pylist(), float)
        assert language.resembles(texts[0], language._units(bundle), 0.35)
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 4 << 20 and most < 24 << 20


def test_pipeline_stages_ask_for_small_batches(spark, make):
    """A worker gets a few MB at a time; a size that the session names is kept."""
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = make([(k, prose(k % 7, 400), "en", "a", 1) for k in range(4000)], files=1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    for stage in (corpus_pipeline.identify_language, corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup, corpus_pipeline.pack_sequences):
        spark.conf.unset(key)
        stage(spark, docs.limit(0), "")
        seen = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(seen) > 10 << 20 and max(seen) < 6 << 20
    spark.conf.set(key, "2m")
    try:
        corpus_pipeline.identify_language(spark, docs, "")
        assert spark.conf.get(key) == "2m"
    finally:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def model():
    counts = np.zeros(toxicity.SIZE**3, np.int64)
    text = " ".join([prose(1, 5000), *["idiot worthless stupid trash clown pathetic"] * 50])
    counts += np.bincount(toxicity.letter_codes(text), minlength=toxicity.SIZE**3)
    three = counts.reshape((toxicity.SIZE,) * 3) + 0.01
    return np.log(three / three.sum(axis=2, keepdims=True))


@pytest.mark.parametrize("hidden, word", [
    ("1d10t", "idiot"), ("!d!0t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("i-d-i-o-t", "idiot"), ("idiooooot", "idiot"),
    ("STUPID!!", "stupid"), ("$tup1d", "stupid"), ("tr@sh###", "trash"), ("ttrraasshh", "trash"), ("cl0wn,", "clown"), ("p_a_t_h_e_t_i_c", "pathetic"),
    ("worthless", "worthless")])
def test_restores(model, hidden, word):
    assert word in toxicity.Restorer(model).words(f"Of the {hidden} and that")


@pytest.mark.parametrize("hidden, word", [
    ("iddiot", "idiot"), ("sstupid", "stupid"), ("trassh", "trash"), ("id iot", "idiot"), ("stu pid", "stupid"), ("i. d. i. o. t.", "idiot"),
    ("1d 10t", "idiot"), ("worthless", "worthless")])
def test_restores_one_repeat_and_pieces(model, hidden, word):
    assert word in toxicity.Restorer(model).words(f"Therefore {hidden} notwithstanding")
    assert word in toxicity.Restorer(model).words(f"Of the {hidden} and that")


def test_viterbi_finds_the_best_path(model):
    """Against all paths of a small lattice."""
    import itertools

    slots = toxicity.lattice("1d!ot", toxicity.REPEATS[0])
    best = None
    for path in itertools.product(*slots):
        a = b = 0
        score, out = 0.0, ""
        for symbol, cost in path:
            score -= cost
            if symbol is None or symbol == b == 0:
                continue
            score += model[a][b][symbol]
            a, b, out = b, symbol, out + toxicity._LETTERS[symbol]
        score += model[a][b][0] if b else 0
        best = max(best or (score, out), (score, out))
    assert toxicity.viterbi(slots, model.tolist()) == best[1]


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out and toxic is not null")
    counts = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((0, 1), 0) / (counts[0, 0] + counts.get((0, 1), 0)) < 0.01
    # Some labels are noise: no marker of any kind in the text.
    assert counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0)) > 0.8


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op9_quality"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out and quality is not null")
    right, good = got.agg(
        F.avg((F.col("quality") == F.col("predicted")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("predicted")))).first()
    assert right > 0.97 and good > 0.99


def test_quality_equals_plain_version(spark, make, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 1500").orderBy("doc_id").limit(150)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    known = {r[0] for r in rows}
    rows += [r for r in odd_rows if r[0] not in known and r[0] != 2]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect() if r[0] in known]
    labels += [(labels[0][0], 0, 0), (labels[0][0], 1, 0), (None, 1, 1), (10**9, 1, 0), (rows[1][0], None, None)]
    want = plain.quality_scores([r[:2] for r in rows], [x[:2] for x in labels], quality.BITS)
    got = quality.classify(make(rows, files=1), make(labels, "doc_id long, quality int, toxic int")).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows] and max(want) - min(want) > 0.3
    assert max(abs(r.score - w) for r, w in zip(got, want)) < 1e-4


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifiers_odd_rows(make, odd_rows, classify):
    docs = make(odd_rows)
    labels = make([(1, 1, 0), (2, 0, 1), (2, None, None), (6, 1, 1), (6, 1, 1), (None, 1, 1), (10, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    none = make([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classify(docs, none).collect()} == {0.5}
    assert classify(make([]), labels).collect() == []


def test_ftrl_separates():
    r = np.random.default_rng(0)
    examples = [(np.sort(r.choice(np.arange(y * 50, y * 50 + 60), 8, replace=False)), np.ones(8), float(y)) for y in r.integers(0, 2, 300)]
    w = quality.ftrl(examples, 120)
    assert np.mean([((w[i] @ x + w[-1]) > 0) == y for i, x, y in examples]) > 0.95
    sparse = quality.ftrl(examples, 120, l1=20.0)
    assert np.count_nonzero(sparse) < np.count_nonzero(w)
