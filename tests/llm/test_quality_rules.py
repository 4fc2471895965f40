import random
import re
from collections import Counter

import pytest

from stagewise.llm.quality_rules import FEW, judge, learn, quality, statistics, training_rows
from stagewise.llm.toxicity import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), failed


def corpus(seed, n):
    r = random.Random(seed)
    docs = []
    for _ in range(n):
        v = [f"wö{k}" for k in range(r.choice([2, 5, 40, 400]))]
        w = [r.choice(v) + r.choice(["", "", "", "*", "||", "𝔘"]) for _ in range(r.randrange(150))]
        text = "".join(x + r.choice([" ", "  ", "\n", "\n\n", "\t", "\x0b", " "]) for x in w)
        docs.append(text + (text[:60] * r.choice([0, 0, 3])))
    return docs


def test_statistics_against_brute_force(spark, odd):
    docs = list(enumerate(corpus(1, 400))) + [(1000, " "), (1001, "\n\n"), (1002, "a b a b a b"), (1003, "a b c " * (FEW + 60) + " ".join(f"x{i} y{i} z{i} " * 2 for i in range(FEW * 2)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: brute(t) for i, t in docs}
    for r in statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id], docs[r.doc_id]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_repeat_words) for r in statistics(odd).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, brute(r.text)[0], brute(r.text)[4]) for r in odd.collect())


@pytest.fixture
def labelled(spark):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        w = [f"w{r.randrange(500)}" for _ in range(r.randrange(55, 120))]
        bad = i % 4 == 0
        if bad and i % 8 == 0:
            w = [x + r.choice(["***", "%%%"]) for x in w]
        elif bad:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    stats = statistics(docs)
    rules = learn(training_rows(stats, labels))
    assert 1 <= len(rules) <= 6 and all(1 <= len(r.conditions) <= 3 for r in rules)
    got = judge(stats, rules).join(labels, "doc_id").withColumn("held_out", held_out("doc_id")).collect()
    test = [r for r in got if r.held_out]
    assert sum(r.kept == (r.quality == 1) for r in test) / len(test) >= 0.98


def test_no_labels_and_odd_rows(labelled, odd, empty):
    docs, labels = labelled
    got = quality(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in got)
    rows = quality(odd, labels).collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows)
    assert quality(empty, labels).collect() == []
