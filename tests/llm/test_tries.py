"""Centroids, Huffman files and the prefix trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from contextlib import contextmanager

import numpy as np
import pytest

from rosterline.llm import centroids, huffman, prefixes
from rosterline.session import shared_folder

VECTORS = "vec_id long, embedding array<float>, label int"


@contextmanager
def setting(spark, key, value):
    was = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def plain_clusters(rows, k, rounds, dimensions):
    kept = []
    for vec_id, vec in rows:
        if vec is not None and len(vec) == dimensions and all(x is not None and math.isfinite(x) for x in vec):
            whole = tuple(math.floor(256 * float(np.float32(x))) for x in vec)
            if all(abs(float(np.float32(x)) * 256) < centroids.LARGEST for x in vec):
                kept.append((vec_id, whole))
    seeds = sorted((hashlib.sha256(f"2:{'null' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in seeds[:k]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
                if own:
                    centres[j] = tuple(sum(x) // len(own) for x in zip(*own))
    whole = sum(d for d, _ in found) if kept else 0
    return sorted((
        (i if i is not None else -1, j, d, sum(e for e, c in found if c == j), whole,
         hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
        for (i, _), (d, j) in zip(kept, found)), key=repr)


def odd_vectors(dimensions, count, seed, scale=1.0):
    r = random.Random(seed)
    middles = [[r.gauss(0, scale) for _ in range(dimensions)] for _ in range(5)]
    rows = [(i, [m + r.gauss(0, scale / 4) for m in r.choice(middles)]) for i in range(count)]
    same = [scale] * dimensions
    rows += [(count + i, same) for i in range(30)] + [(3, rows[3][1]), (None, rows[4][1]), (None, same)]
    rows += [(900, None), (901, same[1:]), (902, [*same[1:], None]), (903, [*same[1:], float("nan")])]
    return rows + [(904, [*same[1:], float("inf")]), (905, [*same[1:], 1e30]), (906, [])]


@pytest.mark.parametrize("dimensions,count,scale", [(3, 400, 1.0), (8, 300, 1.0), (5, 200, 100_000.0)])
def test_clusters_equal_the_double_loop(make, dimensions, count, scale):
    rows = odd_vectors(dimensions, count, dimensions, scale)
    report = []
    vectors = make([(i, v, 0) for i, v in rows], VECTORS)
    for k in (1, 12):
        got = centroids.cluster(vectors, k=k, rounds=4, dimensions=dimensions, rows=50, report=report).collect()
        got = sorted(((r[0] if r[0] is not None else -1, *r[1:]) for r in got), key=repr)
        assert got == plain_clusters(rows, k, 4, dimensions)
    # After the first pass bounds spare most scans; with one centroid all of them.
    assert report[0] == len(got) and report[1:5] == [0] * 4
    assert report[5] == len(got) and report[9] < len(got) // 2


def test_clusters_of_few_and_no_vectors(make):
    rows = [(i, [float(i), 0.0]) for i in range(3)]
    got = centroids.cluster(make([(i, v, 0) for i, v in rows], VECTORS), dimensions=2).collect()
    assert sorted(map(tuple, got), key=repr) == plain_clusters(rows, 40, 5, 2)
    empty = centroids.cluster(make([], VECTORS), dimensions=2)
    assert empty.collect() == [] and empty.columns[0] == "vec_id"


def test_loosening_covers_every_member_and_is_less_than_the_drift():
    r = np.random.default_rng(5)
    saved = 0
    for _ in range(60):
        old = r.integers(-300, 300, (6, 4))
        new = old + r.integers(-40, 40, (6, 4))
        far = r.integers(0, 200, 6) ** 2
        found = centroids.loosening(old, new, far)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(6):
            way = r.normal(size=(400, 4))
            points = old[i] + way / np.linalg.norm(way, axis=1)[:, None] * np.sqrt(far[i]) * r.random((400, 1)) ** 0.25
            others = [j for j in range(6) if j != i]
            gain = np.linalg.norm(points[:, None] - old[others], axis=2) - np.linalg.norm(points[:, None] - new[others], axis=2)
            assert gain.max() <= found[i]
            saved += found[i] < 0.9 * drift[others].max()
    assert saved > 60


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(rows):
    """Rows as (doc_id, text) in order of position."""
    encode, out, start = tokenizer(), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, 0]
        data = np.array(ids, "<u4").tobytes()
        out.append((doc_id, start, len(ids), zlib.crc32(data), data))
        start += len(ids)
    return out


def test_ids_come_back_from_files(spark, make, odd_rows):
    rows = odd_rows + [(3 * i, f"text {i} " * (i % 40), "en", "a", 1) for i in range(400)]
    docs = make(rows)
    placed = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    path = f"{shared_folder(spark)}/ids-test"
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        huffman.write_ids(docs, path)
    # Several range parts of several blocks each hold all of it.
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 3
    got = sorted(huffman.read_ids(spark, path).collect(), key=lambda r: r["start"])
    want = plain_ids(placed)
    assert [(*r[:1], *r[2:]) for r in got] == want
    lengths = {r["id"]: r["length"] for r in spark.read.parquet(f"{path}/lengths").collect()}
    assert sum(2.0 ** -n for n in lengths.values()) == 1 and max(lengths.values()) <= huffman.LIMIT
    whole, bits = sum(w[2] for w in want), sum(8 * len(r["payload"]) for r in spark.read.parquet(f"{path}/blocks").collect())
    assert bits < 16 * whole


def test_no_documents_and_one_kind_of_id(spark, make):
    assert huffman.through_files(make([])).collect() == []
    got = huffman.through_files(make([(1, None, "en", "a", 0), (2, "", "en", "a", 0)])).drop("_row").collect()
    zero = zlib.crc32(b"\0\0\0\0")
    assert sorted(map(tuple, got)) == [(1, 0, 1, zero), (2, 1, 1, zero)]


def test_ids_equal_the_tokenizer_on_every_character_and_on_long_runs():
    ours, theirs = huffman.text_ids("byte_bpe_50k.json"), tokenizer()
    r = random.Random(1)
    texts = [f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)}  {chr(c)}x\n{chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    texts += [" " * 100_000, "x" * 200_000, "\n \t" * 50_000, "<|endoftext|>", "a <|endoftext|>b", "漢" * 5000, "don't we'll I'M"]
    texts += ["".join(r.choice(" \n\t'aZé漢1.<|>🎉  ") for _ in range(60)) for _ in range(2000)]
    for text, found in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert ours.encode(text).tolist() == found.ids, repr(text[:60])


def best_cost(counts, limit):
    """The least total length over all length choices that satisfy Kraft's inequality."""
    counts = sorted(counts, reverse=True)
    best = {1 << limit: 0}
    for n in counts:
        step = {}
        for room, cost in best.items():
            for length in range(1, limit + 1):
                left = room - (1 << (limit - length))
                if left >= 0 and cost + n * length < step.get(left, math.inf):
                    step[left] = cost + n * length
        best = step
    return min(best.values())


def test_code_lengths_are_the_best_of_limited_length():
    r = random.Random(7)
    for _ in range(40):
        counts = [r.choice([1, 1, 2, 5, 100, 10_000]) * r.randint(1, 9) for _ in range(r.randint(2, 12))]
        for limit in (4, 5, 8):
            lengths = huffman.code_lengths(np.array(counts), limit)
            assert lengths.max() <= limit and sum(2.0 ** -n for n in lengths) <= 1
            assert sum(a * b for a, b in zip(counts, lengths.tolist())) == best_cost(counts, limit)
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(17, np.int64), 4)
    ids = np.arange(3, 60_003, 2)
    counts = (10**9 // np.arange(1, len(ids) + 1)).astype(np.int64)
    book = huffman.Codebook(ids, huffman.code_lengths(counts, 18))
    data = [np.random.default_rng(n).choice(ids, n).astype(np.uint32) for n in (1, 511, 512, 513, 5000)]
    coded = [book.encode(d) for d in data]
    back = book.decode([c[0] for c in coded], [c[1] for c in coded], [len(d) for d in data])
    assert all((a == b).all() for a, b in zip(data, back))


def plain_trie(rows, family=20, heads=4):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    nodes = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(math.fmod(c, family))
        said = own.get(base, [])[:h] + said[h:]
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), []).append((c, len(said) == d))
    kids = {}
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path, members in nodes.items():
        mine = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += mine
            leaves[path[:d]] += path not in kids
    return sorted((
        min(m)[0], len(path), min(nodes[path[:-1]])[0] if path else None, len(m), kids.get(path, 0), leaves[path], saved[path],
        hashlib.sha256(",".join(str(c) for c, end in sorted(m) if end).encode()).hexdigest()) for path, m in nodes.items())


TURNS = "conv_id long, turn long, role string, text string, words string, place int"


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie_equals_brute_force(spark, make, block):
    r = random.Random(block)
    rows = []
    for c in [*range(-25, 260), 2**40]:
        if c % 20 == 0 and c % 60:
            continue
        like = r.choice([0, 0, 1, 2, 3, c])
        for t in range(r.choice([0, 1, 2, 3, 6, 9, 14])):
            said = f"say {like} {t // r.choice([1, 1, 1, 5])} more words" if r.random() < 0.95 else r.choice([None, "", "\n "])
            rows.append((c, r.choice([t, t, t, t, None, 1]), r.choice(["user", "user", "user", None]), said, "x", 1))
    rows += [rows[5], rows[5], (None, 1, "user", "alone", "x", 1), (None, 1, "user", "alone", "x", 1), (7, None, None, None, None, None)]
    rows += [(c, t, "user", f"turn {t}", "x", 1) for c in (401, 402) for t in range(300)]
    rows += [(403, t, "user", f"turn {t}" if t != 200 else "other", "x", 1) for t in range(300)]
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        got = prefixes.trie(make(rows, TURNS), block=block).collect()
    want = plain_trie([row[:4] for row in rows])
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_long_conversation_is_spread_and_empty_table(spark, make):
    rows = [(c, t, "user", f"turn {t}", "x", 1) for c in (1, 2) for t in range(4000)]
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        got = prefixes.trie(make(rows, TURNS)).collect()
    # Without conversation 0 both lose their heads, each as many turns as its own h.
    assert sorted(map(tuple, got), key=repr) == sorted(plain_trie_of_chains(rows), key=repr)
    empty = prefixes.trie(make([], TURNS))
    assert empty.collect() == [] and len(empty.columns) == 8


def plain_trie_of_chains(rows):
    """As ``plain_trie`` for two long conversations, whose nodes are told by depth and member only."""
    own = {c: [x[3] for x in rows if x[0] == c] for c in (1, 2)}
    own = {c: said[zlib.crc32(str(c).encode()) % 4:] for c, said in own.items()}
    shared = next((d for d, (a, b) in enumerate(zip(own[1], own[2])) if a != b), min(map(len, own.values())))
    ends = {c: len(said) for c, said in own.items()}
    none, out = hashlib.sha256(b"").hexdigest(), []
    for d in range(shared + 1):
        here = [c for c in (1, 2) if ends[c] == d]
        on = [c for c in (1, 2) if ends[c] > d]
        kids = len({own[c][d] for c in on})
        leaves = len({tuple(own[c][shared:shared + 1]) for c in (1, 2) if ends[c] > shared}) or 1
        saved = 2 * (shared - d + (1 if d else 0))
        out.append((1, d, 1 if d else None, 2, kids, leaves, saved, hashlib.sha256(",".join(map(str, here)).encode()).hexdigest()))
    for c in (1, 2):
        for d in range(shared + 1, ends[c] + 1):
            last = d == ends[c]
            out.append((c, d, 1 if d == shared + 1 else c, 1, 0 if last else 1, 1, 0, hashlib.sha256(str(c).encode()).hexdigest() if last else none))
    return out
