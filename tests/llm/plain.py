"""Brute-force versions of the operators, on lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]")


def no_space(text):
    return BLANK.sub("", text or "")


def equal_groups(rows):
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        groups.setdefault(no_space(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, k))
    return groups


def shingles(text, width=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def near_components(rows, percent=85):
    """Component number of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                part[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], sets


def without_repeats(rows, length=100):
    """(kept bytes, removed, runs) of each row; rows in order of position."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p:p + length]
            if window in seen:
                covered[p:p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, c in zip(data, covered) if not c)
        out.append((kept, sum(covered), len(re.findall(b"\1+", bytes(covered)))))
    return out


def base_counts(text):
    words = WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if counts[g] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
        n < 50 or 100 * len(covered) > 50 * n)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def _cosine(x, y):
    return sum(a * b for a, b in zip(x, y)) / ((math.hypot(*x) * math.hypot(*y)) or 1)


def languages(rows, letters, symbol, folds=3):
    """(language, cosine) of each (doc_id, text, lang): letter by letter, product by product.

    ``letters`` are the symbols' random vectors, ``symbol`` gives a character's number, 0 for no letter.
    """
    size = len(letters[0])

    def bundle(text):
        line = [0]
        for c in [*(symbol(c) for c in (text or "").lower()), 0]:
            if c or line[-1]:
                line.append(c)
        total = [0] * size
        for a, b, c in zip(line, line[1:], line[2:]):
            for i in range(size):
                total[i] += letters[a][i - 2] * letters[b][i - 1] * letters[c][i]
        return total if any(line) else None

    sums = {}
    for doc_id, text, lang in rows:
        if doc_id is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % folds != 1:
            old = sums.setdefault(lang, [0] * size)
            sums[lang] = [x + y for x, y in zip(old, bundle(text) or [0] * size)]
    names = sorted(sums)
    units = [[x / (math.hypot(*sums[n]) or 1) for x in sums[n]] for n in names]
    if len(names) > 1:
        mean = [sum(u[i] for u in units) / len(units) for i in range(size)]
        units = [[x - m for x, m in zip(u, mean)] for u in units]
    out = []
    for _, text, _ in rows:
        mine = bundle(text)
        near = [(_cosine(u, mine), -k) for k, u in enumerate(units)] if mine else []
        best = max(near) if near else None
        out.append((names[-best[1]], best[0]) if best else ("und", -1.0))
    return out


def mixed_bits(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def quality_features(text, bits):
    """Slot to count of one text: word and shape n-grams, one by one."""
    def shape(word):
        kinds = []
        for b in word:
            kind = "0" if 48 <= b <= 57 else "A" if 65 <= b <= 90 else "a" if b >= 128 or 97 <= b <= 122 else chr(b)
            if not kinds or kinds[-1] != kind:
                kinds.append(kind)
        return "".join(kinds).encode()

    words = text.encode().split()
    h = [xxhash.xxh64_intdigest(w) for w in words]
    s = [xxhash.xxh64_intdigest(shape(w), seed=1) for w in words]
    odd, top = 0x9E3779B97F4A7C15, 2**64
    grams = [*h, *s]
    for i in range(1, len(h)):
        grams += [((h[i - 1] * odd + h[i]) % top) ^ 11, ((s[i - 1] * odd + s[i]) % top) ^ 12, 21 + (h[i] == h[i - 1])]
        if i > 1:
            grams += [(((s[i - 2] * odd + s[i - 1]) * odd + s[i]) % top) ^ 13, 31 + (h[i] == h[i - 2])]
    return Counter(mixed_bits(g) >> (64 - bits) for g in grams)


def quality_scores(rows, labels, bits, folds=5, epochs=3, alpha=1.0, beta=1.0, l2=0.01):
    """Score of each (doc_id, text): FTRL-proximal, one weight at a time."""
    marks = {}
    for doc_id, label in labels:
        if doc_id is not None and label is not None and zlib.crc32(str(doc_id).encode()) % folds:
            marks.setdefault(doc_id, []).append(label)
    texts = dict(rows)
    known = sorted((i for i in marks if i in texts), key=lambda i: xxhash.xxh64_intdigest(str(i)))
    z, n = Counter(), Counter()

    def inputs(text):
        found = quality_features(text or "", bits)
        whole = max(1, sum(found.values()))
        return {**{k: math.sqrt(c / whole) for k, c in found.items()}, "bias": 1.0}

    def weight(k):
        return -z[k] / ((beta + math.sqrt(n[k])) / alpha + l2)

    def chance(x):
        return 1 / (1 + math.exp(-max(-35, min(35, sum(weight(k) * v for k, v in x.items())))))

    for _ in range(epochs):
        for i in known:
            x = inputs(texts[i])
            error = chance(x) - (sum(marks[i]) / len(marks[i]) >= 0.5)
            steps = {k: (error * v, weight(k)) for k, v in x.items()}
            for k, (g, w) in steps.items():
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w
                n[k] += g * g
    return [chance(inputs(text)) for _, text in rows]
