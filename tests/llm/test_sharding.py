import zlib

import numpy as np

from stagewise.llm.sharding import shard_documents


def check(rows, docs):
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == want
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 24) for r in rows)


def test_odd_rows(odd):
    rows = shard_documents(odd).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert len({r.shard for r in rows if r.doc_id == 4}) == 1


def test_empty(empty):
    assert shard_documents(empty).collect() == []


def test_shares_and_moves(spark):
    docs = spark.range(24_000).selectExpr("id AS doc_id", "'t' AS text")
    rows = shard_documents(docs, weights=[2.0] + [1.0] * 23).collect()
    check(rows, [(i, "t") for i in range(24_000)])
    counts = np.bincount([r.shard for r in rows], minlength=24)
    assert abs(counts[0] - 1920) < 200 and all(abs(c - 960) < 150 for c in counts[1:])
    moved = sum(r.grown_shard == 24 for r in rows)
    assert abs(moved - 24_000 / 26) < 150


def test_fewer_shards_keep_the_rest(spark):
    docs = spark.range(2_000).selectExpr("id AS doc_id", "'t' AS text")
    a = {r.doc_id: r.shard for r in shard_documents(docs, [1.0] * 5).collect()}
    b = {r.doc_id: r.shard for r in shard_documents(docs, [1.0] * 4 + [0.0]).collect()}
    assert all(b[i] == s for i, s in a.items() if s != 4)
