import hashlib
import random
import re

import pytest

from stagewise.llm.substring_dedup import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62


def brute(docs, window):
    least = {}
    split = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in docs]
    for i, w in split:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            least[k] = min(least.get(k, LAST), i)
    out = []
    for (i, w), (raw, _) in zip(split, docs):
        dead = set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < i:
                dead.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in dead)
        spans = sum(k - 1 not in dead for k in dead)
        out.append((raw, len(w), len(dead), spans, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["ä" + str(i) for i in range(12)] + list("abcdefgh")
    passages = [[r.choice(vocabulary) for _ in range(r.randrange(5, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(6)):
            words += r.choice(passages)[r.randrange(4) :] if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randrange(20))]
        rows.append((r.randrange(n), r.choice([" ", "\n", "\t\x0b "]).join(words)))
    return rows


@pytest.mark.parametrize("window,chunk", [(13, 300), (13, 4 << 20), (4, 800)])
def test_against_brute_force(spark, monkeypatch, window, chunk):
    from stagewise.llm import exchange

    monkeypatch.setattr(exchange, "CHUNK", chunk)
    monkeypatch.setattr(exchange.chunked, "__defaults__", ("doc_id", "text", chunk))
    rows = corpus(window + chunk)
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, window)
    assert any(r.n_removed for r in got)


def test_odd(odd, empty):
    got = dedup_substrings(odd).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([(r.doc_id, r.text) for r in odd.collect()], 13)
    assert dedup_substrings(empty).collect() == []
