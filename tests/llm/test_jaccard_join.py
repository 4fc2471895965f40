import random
import re

import numpy as np
import pytest

from stagewise.llm import exchange, jaccard_join
from stagewise.llm.components import components
from stagewise.llm.jaccard_join import choose_matches, near_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, percent=80):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=repr)


def corpus(seed, n=150):
    r = random.Random(seed)
    words = lambda k: [f"w{r.randrange(400)}" for _ in range(k)]
    shared = words(60)
    bases = [words(r.choice([3, 6, 20, 60, 200])) for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(r.choice(bases)) if r.random() < 0.8 else words(r.randrange(90))
        for _ in range(r.randrange(4)):
            if w and r.random() < 0.7:
                w[r.randrange(len(w))] = f"e{r.randrange(1000)}"
        if r.random() < 0.2:
            w += shared
        docs.append((r.randrange(10 * n), " ".join(w).upper() if r.random() < 0.1 else "  ".join(w)))
    return docs


@pytest.mark.parametrize("seed,chunk,price", [(1, 2_000, 0.02), (2, 4 << 20, 5.0), (3, 500, 0.5)])
def test_against_brute_force(spark, monkeypatch, seed, chunk, price):
    monkeypatch.setattr(exchange.chunked, "__defaults__", ("doc_id", "text", chunk))
    docs = corpus(seed)
    got = near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), price=price).drop("node")
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(docs)


def test_chain_of_links_beyond_the_centre(spark):
    # each text is near the next one only
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(12):
        base = base[:]
        for k in range(8 * i, 8 * i + 8, 8):
            base[k] = f"x{r.randrange(10**6)}"
        docs.append((100 - i, " ".join(base)))
    got = near_copies(spark.createDataFrame(docs, "doc_id long, text string")).drop("node")
    want = brute(docs)
    assert len({c for *_, c in want}) < 12
    assert sorted((tuple(x) for x in got.collect()), key=repr) == want


def test_odd(odd, empty):
    got = near_copies(odd).drop("node").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert near_copies(empty).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 70), (70, 60), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((50, 60, 70, 100), 50)}


def test_matches_follow_cost():
    cheap_then_dear = np.array([0.0] * 10 + [1000.0] * 30)
    assert choose_matches(cheap_then_dear, 5, 40, 8, 0.02) == 1
    assert choose_matches(np.full(100, 3.0), 21, 100, 8, 1.0) > 4


def test_a_group_of_near_copies_asks_for_one_match():
    # postings of one group are not thinned out by more matches, those of other documents are
    assert choose_matches(np.array([0.0] * 15 + [1400.0] * 131), 30, 146, 8, 0.02) == 1
    assert choose_matches(np.array([0.0] * 15 + [90.0] * 131), 30, 146, 8, 0.5) > 4


def test_pairs_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Members with edits of their own are not paired with each other: few pairs are formed beyond those with a centre."""
    r = random.Random(21)
    base, docs = [f"w{i}" for i in range(150)], []
    for i in range(700):
        words = base[:]
        for at in r.sample(range(0, 150, 5), r.choice([1, 1, 2, 2, 3, 3, 4])):
            words[at] = f"x{r.randrange(10**9)}"
        docs.append((i, " ".join(words)))
    formed = []

    def counted(pairs, profiles, percent, old=jaccard_join.verified):
        formed.append(pairs.count())
        return old(pairs, profiles, percent)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    got = near_copies(spark.createDataFrame(docs, "doc_id long, text string")).drop("node")
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(docs)
    # every pair would be 244,650
    assert len(formed) == 2 and formed[1] < 5_000, formed
