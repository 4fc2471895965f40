import hashlib
import random
import re
import zlib

import pytest

from stagewise.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, level int, q int"


def brute(rows, every=0, below=4):
    talks = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            talks.setdefault(c, []).append((turn is not None, turn or 0, key, (role, text)))
    talks = {c: [x[3] for x in sorted(t, key=lambda x: x[:3])] for c, t in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % below if every else 0
        built[c] = talks.get(c - c % every, [])[:h] + own[h:] if every else own
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for node, m in members.items():
        sub = [x for x in members if x[: len(node)] == node]
        child = [x for x in sub if len(x) == len(node) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in sub) for x in sub)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in sub if x)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(child), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def talks(seed, n=60, most=11, texts=("a b", "c", "", "d e f")):
    r = random.Random(seed)
    return [(c, i, r.choice(["user", "user", "bot"]), r.choice(texts), 1, 2, 3) for c in range(n) for i in range(r.randrange(1, most))]


@pytest.mark.parametrize("every", [0, 20])
def test_nodes_as_by_brute_force(spark, every):
    rows = talks(every)
    assert got(T.conversation_trie(spark.createDataFrame(rows, SCHEMA), every)) == brute(rows, every)


def test_long_conversations_and_copies(spark, monkeypatch):
    # running values pass from span to span, ends of one node from batch to batch
    monkeypatch.setattr(T, "SPAN", 2)
    long = [(0, i, "user", f"w{i // 9} x", 1, 2, 3) for i in range(70)]
    same = [(c, i, "user", f"w{i // 9} x", 1, 2, 3) for c in range(1, 30) for i in range(c % 3 * 9 + 3)]
    rows = long + same
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert got(T.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("every", [0, 20])
def test_odd_rows(spark, every):
    rows = [
        (None, 1, "user", "no conversation", 1, 2, 3),
        (1, None, "user", "first", 1, 2, 3),
        (1, 0, None, "second", 1, 2, 3),
        (1, 0, "user", None, 1, 2, 3),
        (1, 0, "user", None, 1, 2, 3),
        (2, 5, "u", "ser a", 1, 2, 3),
        (3, 5, "us", "er a", 1, 2, 3),
        (4, 5, "user", "x " * 3000, 1, 2, 3),
        (5, 5, "user", "x " * 3000, 1, 2, 3),
        (-7, 5, "user", "below zero", 1, 2, 3),
        *[(c, 0, "a", "b", 1, 2, 3) for c in range(40, 60)],
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if every:
        # a conversation without turns is a member of the root alone: its first turns go, and it has no donor
        rows = [r for r in rows if r[0] is None or r[0] >= 0]
        df = df.filter("conv_id IS NULL OR conv_id >= 0")
        rows += [(c, 0, "a", "b", 1, 2, 3) for c in range(61, 70)]
        df = spark.createDataFrame(rows, SCHEMA)
    found = got(T.conversation_trie(df, every))
    assert found == brute(rows, every)
    assert got(T.conversation_trie(df.limit(0), every)) == []


def test_other_column_names(spark):
    rows = talks(3, 10)
    df = spark.createDataFrame(rows, SCHEMA).toDF("conv.id", "turn", "conv_id", "text", "a", "b", "k1")
    assert got(T.conversation_trie(df, conv_col="conv.id", role_col="conv_id")) == brute(rows)
