import random
import re

from stagewise.llm import decontamination
from stagewise.llm.decontamination import MISS, contained_items, hashes_needed, size_class

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(docs, items):
    out = []
    own = [(i, shingles(t)) for i, t in docs]
    for item, text in items:
        s = shingles(text)
        for i, d in own:
            n = len(s & d)
            if s and n >= 0.8 * len(s):
                out.append((i, item, n, len(s)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"Wört{i}" for i in range(80)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(r.choice([3, 4, 5, 9, 30, 60])))) for i in range(40)] + [(40, None), (41, "  "), (42, "a a a a a a a a a"), (None, "x y z")]
    docs = []
    for i in range(300):
        parts = words(r.randrange(900))
        for _ in range(r.randrange(3)):
            item = (r.choice(items)[1] or "").replace("W", "w").split()
            if r.random() < 0.5 and len(item) > 8:
                item[r.randrange(len(item))] = "CHANGED"
            at = r.randrange(len(parts) + 1)
            parts[at:at] = item
        docs.append((r.randrange(250), " ".join(parts)))
    docs += [(900, items[3][1]), (901, "A a a A a a a a b"), (902, "x y z")]
    got = contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert len(want) > 100
    assert sorted((tuple(x) for x in got.collect()), key=repr) == want


def test_repeated_lines_and_scattered_pieces(spark):
    """Items of few distinct shingles, and items in pieces far apart, are found in every document that holds them."""
    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    lines, docs, items = [words(9) for _ in range(300)], [], []
    for i, line in enumerate(lines):
        items.append((i, " ".join(line * 13)))
        kept = line * 13
        docs.append((i, " ".join(words(400) + kept[: 9 + 4] + words(400))))
    for i in range(300, 330):
        item = words(60)
        items.append((i, " ".join(item)))
        # 17 + 17 + 14 of its 56 shingles, at places far apart; and one shingle less
        pieces = [item[:21], item[19:40], item[40:58]]
        docs.append((i, " ".join(w for p in pieces for w in p + words(2000))))
        docs.append((i + 1000, " ".join(w for p in [*pieces[:2], pieces[2][1:][:13]] for w in p + words(2000))))
    want = brute(docs, items)
    assert {x[0] for x in want} == {*range(330)}
    got = contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(x) for x in got.collect()), key=repr) == want


def test_recall_of_minhash_alone(spark):
    """Without the search for scattered pieces: edited items of all sizes inside long documents."""
    r = random.Random(10)
    words = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    items, docs = [], []
    for i in range(400):
        item = words(r.choice([4, 6, 11, 20, 37, 65, 130, 300]))
        items.append((i, " ".join(item)))
        item[r.randrange(len(item))] = "edit"
        docs.append((i, " ".join(words(r.randrange(3000)) + item + words(r.randrange(3000)))))
    want = brute(docs, items)
    assert len(want) > 200
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(x) for x in contained_items(docs, items, scattered=False).collect()}
    assert got <= set(want) and len(got) >= 0.99 * len(want)
    assert sorted((tuple(x) for x in contained_items(docs, items).collect()), key=repr) == want


def test_items_in_parts(spark, monkeypatch):
    items = [(i % 3, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(20)]
    docs = spark.createDataFrame([(i, f"a b c {t} d e") for i, (_, t) in enumerate(items)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(x) for x in contained_items(docs, table).collect())
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 100)
    assert sorted(tuple(x) for x in contained_items(docs, table).collect()) == whole and len(whole) == 20


def test_hashes_keep_the_chance_of_a_miss():
    assert [size_class(n) for n in (1, 2, 3, 4, 5, 64, 65)] == [1, 2, 4, 4, 8, 64, 128]
    for raw in (1, 2, 3, 9, 33, 64, 500):
        size = size_class(raw)
        k = hashes_needed(raw, size, 0.8)
        shared = -(-raw * 4 // 5)
        assert (1 - shared / (2 * size + raw - shared)) ** k <= MISS and k <= decontamination.HASHES
    assert hashes_needed(5, size_class(60), 0.8) > decontamination.HASHES


def test_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "Two three four five six"), (1, "two three four five six"), (2, None)], "item_id long, text string")
    assert sorted(tuple(r) for r in contained_items(odd, items).collect()) == [(4, 1, 1, 1)] * 4
    assert contained_items(empty, items).collect() == []
    assert contained_items(odd, items.limit(0)).collect() == []
