import random
import re
from collections import Counter

import numpy as np
import pytest

from stagewise.llm import collocations as C


def brute(rows, least, longest=5, top=2000, covered=100):
    count, total = {}, Counter()
    for lang, text in rows:
        f = count.setdefault(lang or "und", Counter())
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = {}
        for p, a in found.items():
            for k in range(2, len(p)):
                for s in range(len(p) - k + 1):
                    inside[p[s : s + k]] = max(a, inside.get(p[s : s + k], 0))
        rows_ = []
        for p, a in found.items():
            if 100 * inside.get(p, 0) >= covered * a:
                continue
            score, _, l, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def corpus(seed, n=120, size=60):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "ÉTÉ", "日本", "a-b", "x"]
    glue = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", " !"]
    stock = ["once upon a time there", "New York City", "of the"]
    def text():
        return "".join((r.choice(stock) if r.random() < 0.2 else r.choice(words)) + r.choice(glue) for _ in range(r.randrange(size)))
    return [(r.choice(["en", "en", "de", None]), text()) for _ in range(n)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least,slack,chunk,covered", [(5, 1, 500, 100), (20, 4, 3000, 100), (5, 2, 1 << 22, 60)])
def test_as_by_brute_force(spark, least, slack, chunk, covered):
    rows = corpus(least)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert got(C.collocations(df, least, slack=slack, chunk=chunk, covered=covered)) == brute(rows, least, covered=covered)


def test_top_and_ties(spark):
    rows = [("en", "a b. c d. e f. a x. b y")] * 6 + [(None, "p q")] * 6
    df = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows, 5, top=3)
    assert got(C.collocations(df, 5, top=3)) == want and len(want) == 4


def test_one_very_common_phrase_in_one_long_text(spark):
    # a third of all words, in one text that is cut into parts
    rows = [("en", "once upon a time. " * 3000)] + corpus(1, 60)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got(C.collocations(df, 10, chunk=2000)) == brute(rows, 10)


def test_odd_rows(spark, odd, empty):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert got(C.collocations(odd, 2)) == brute(rows, 2)
    assert got(C.collocations(empty, 2)) == []
    assert got(C.collocations(odd, 10**6)) == []
    clash = odd.withColumnRenamed("lang", "n").withColumnRenamed("text", "phrase").withColumnRenamed("key", "lang_key")
    assert got(C.collocations(clash, 2, lang_col="n", text_col="phrase")) == brute(rows, 2)


@pytest.mark.parametrize("seed", range(5))
def test_summaries_keep_all_that_is_frequent(seed):
    r = np.random.default_rng(seed)
    stream = np.concatenate([r.zipf(1.3, 20_000) % 5000, np.repeat(np.arange(9000, 9020), 100)]).astype(np.uint32)
    r.shuffle(stream)
    parts = [np.unique(p, return_counts=True) for p in np.array_split(stream, 37)]
    parts = [(k, n.astype(np.int64)) for k, n in parts]
    least, every = 100, Counter(stream.tolist())
    for slack in (1, 4):
        capacity = slack * len(stream) // least + 1
        keys, n, lost = C.merged(parts, capacity)
        assert len(keys) <= capacity and lost * slack < least
        told = dict(zip(keys.tolist(), n.tolist()))
        assert all(every[k] - lost <= told.get(k, 0) <= every[k] for k in every)
        assert {k for k, f in every.items() if f >= least} <= {k for k, c in told.items() if c + lost >= least}
        # and summaries of summaries
        halves = [C.merged(parts[:20], capacity), C.merged(parts[20:], capacity)]
        keys, n, again = C.merged([h[:2] for h in halves], capacity)
        lost = again + sum(h[2] for h in halves)
        assert lost * slack < least
        told = dict(zip(keys.tolist(), n.tolist()))
        assert all(every[k] - lost <= told.get(k, 0) for k in every)


def test_exact_products(spark):
    big = 10**15
    rows = [(1, "a b", big), (1, "a", big), (1, "b", big + 1), (1, "", 9 * 10**16)]
    df = spark.createDataFrame(rows, "lang_key long, phrase string, n long")
    assert C.scored(df).collect()[0].score == 1000 * big * 9 * 10**16 // (big * (big + 1))
