import math
import random

import numpy as np
import pytest

from cdsloom.llm import near_dedup
from cdsloom.llm.components import components


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= percent * len(sets[a] | sets[b]) and rows[a][0] is not None and rows[b][0] is not None:
                up[find(a)] = find(b)
    out = {}
    for a, (d, _) in enumerate(rows):
        same = [rows[b][0] for b in range(len(rows)) if find(b) == find(a)]
        out[a] = (d, len(sets[a]), min(same) if d is not None else None)
    return sorted(out.values(), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéX") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " \n\t", "one", "ONE", "two words", "Two  words"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 25])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 9))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    base = [word() for _ in range(120)]
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 30)):
            w[rng.randrange(len(w))] = word()
        texts.append("\n".join(w))
    texts += ["long " * 20_000, texts[20], texts[20]]
    rng.shuffle(texts)
    return [(k * 7 + 3, t) for k, t in enumerate(texts)] + [(None, texts[5]), (None, None)]


@pytest.mark.parametrize("words", [2, 5])
def test_against_all_pairs(spark, rows, words):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, node string").repartition(3)
    got = near_dedup.linked(docs, words=words, percent=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, words, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nothing(spark):
    assert near_dedup.linked(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_parts_of_groups_and_alike_names(spark, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 400)
    monkeypatch.setattr(near_dedup, "LEAST", 50)
    monkeypatch.setattr(near_dedup, "NAME_BITS", 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.linked(docs, words=2, percent=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 2, 80)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 900, np.uint64), rng.integers(0, 2**63, 1000, np.uint64)
    b[:800] = a[:800]
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    assert (near_dedup.registers(np.union1d(a, b)) == np.maximum(ra, rb)).all()
    j = near_dedup.likeliest(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([900.0]), np.array([1000.0]))
    assert abs(j[0] - 800 / 1100) < 0.12


def test_estimates_seldom_miss():
    n = near_dedup.REGISTERS
    factorial = np.array([math.lgamma(k + 1) for k in range(n + 1)])
    larger, smaller = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
    larger, smaller = larger[larger + smaller <= n], smaller[larger + smaller <= n]
    equal = n - larger - smaller
    # Sets of similarity 0.8 with these shares of both sizes: each count of registers with its probability.
    for u in (0.5, 0.48, 0.46):
        got = near_dedup.likeliest(larger, smaller, np.full(len(larger), u), np.full(len(larger), 1 - u))
        p = lambda x: -math.log1p(-x * (near_dedup.BASE - 1) / near_dedup.BASE) / math.log(near_dedup.BASE)
        up, down = p(u - (1 - u) * 0.8), p(1 - u - u * 0.8)
        share = np.exp(factorial[n] - factorial[larger] - factorial[smaller] - factorial[equal] + larger * math.log(up) + smaller * math.log(down) + equal * math.log(1 - up - down))
        assert abs(share.sum() - 1) < 1e-9 and share[got < 0.8 - near_dedup.SLACK].sum() < 1e-7


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7), (-5, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 103: 100, 900: -5}
