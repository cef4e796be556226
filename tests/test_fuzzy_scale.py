"""Names of large blocks: how often they are worked on, and how many slices they are settled in."""

from rosterline.operators import resolve, similarity as sim
from tests.test_resolve import brute_clusters, titled


def _rows(n):
    return [(i, "KY", "c", name) for i, name in enumerate(sorted(titled(n), key=hash_of))]


def hash_of(name):
    return sum(ord(ch) * 31**i for i, ch in enumerate(name)) % 1_000_003


def test_names_that_are_seldom_alike_are_not_halved(spark, monkeypatch):
    """A small budget: the slices are those of their order, and a name's grams are chosen once."""
    paired, chosen = [], []
    plain, prepare = sim.similar_pairs, sim._prepared
    monkeypatch.setattr(sim, "similar_pairs", lambda a, b, t, c: (paired.append(1), plain(a, b, t, c))[1])
    monkeypatch.setattr(sim, "_prepared", lambda t, c: (chosen.append(1), prepare(t, c))[1])
    rows = _rows(300)
    df = spark.createDataFrame(rows, "_ord long, state string, city string, org_name string")
    got = resolve.fuzzy_clusters(df, small_block=4, slice_rows=30, max_candidates=1e3, finish_below=20).collect()
    assert {r.ord: r.cluster for r in got if r.ord != r.cluster} == brute_clusters(rows, 85.0)
    # Slices up to 30, 120 and 300 rows: each with itself, the later ones with the anchors in both directions.
    assert len(paired) <= 7 and len(chosen) == 1


def test_tiles_give_each_pair_once(spark, monkeypatch):
    """Several tiles a block, blocks of other sizes on the two sides, and pairs in one block only."""
    monkeypatch.setattr(sim, "TILE", 50)
    names = [(i % 3, i, f"{name[:14]} {i % 7}") for i, name in enumerate(titled(400))]
    df = spark.createDataFrame(names, "block_id long, ord long, name string").dropDuplicates(["block_id", "name"])
    rows = [tuple(r) for r in df.orderBy("ord").collect()]
    want = sorted((i, j) for x, i, a in rows for y, j, b in rows if x == y and i < j and sim.Matcher(a).similar(b, 75.0))
    assert sorted(map(tuple, sim.similar_pairs(df, df, 75.0).collect())) == want and len(want) > 20
    part, rest = df.filter("ord < 100"), df.filter("ord >= 100 and block_id < 2")
    both = sim.similar_pairs(part, rest, 75.0).unionByName(sim.similar_pairs(rest, part, 75.0))
    kept = {r.ord for r in rest.collect()}
    assert sorted(map(tuple, both.collect())) == [(i, j) for i, j in want if i < 100 and j in kept]
