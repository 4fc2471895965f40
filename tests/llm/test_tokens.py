import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from stagewise.llm.packing import Rounds, _cut, pack, windows
from stagewise.llm.token_counts import count_tokens
from stagewise.llm.tokens import Encoder, encoder, vocabulary

PIECES = ["the", "œuvre", "ıſ", "\x85", "²½", "ǅ", "  ", " ", "\n", "\t", "a'll", "don't", "1234", "...", "日本", "naïve", " ", "\x1c", "<|endoftext|>", "<|endof", "é", "!", "'", "x" * 70]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def texts(n, size, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) + r.choice(["", " ", " "]) for _ in range(r.randrange(size))) for _ in range(n)]


def test_segments_encode_as_whole_texts(library):
    batch = [*texts(400, 30), "", " ", " a", "a ", "a  b", "a\n b"]
    e = Encoder(vocabulary())
    for _ in range(2):
        for text, got in zip(batch, e.encode(batch)):
            assert np.frombuffer(got, e.type).tolist() == library(text), repr(text)


@pytest.mark.parametrize("step,overlap", [(40, 8), (200, 30), (64_000, 1_000)])
def test_counts(spark, odd, library, step, overlap):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, t) for i, t in enumerate(texts(20, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = count_tokens(docs, step=step, overlap=overlap, guard=20).collect()
    want = sorted(((i, len((t or "").encode()), len(library(t))) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_counts_of_nothing(empty):
    assert count_tokens(empty).collect() == []


def check_pieces(pieces, docs, library):
    streams = {}
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        streams.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for seq, spans in streams.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or seq == max(streams)
    assert sorted(streams) == list(range(len(streams)))
    assert by_doc.keys() == docs.keys()
    for i, text in docs.items():
        ids = [*library(text), 1]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            part = np.array(ids[p.start : p.start + p.length], "<u4")
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids)


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.3, "c": 0.2}])
def test_pack(spark, library, targets):
    r = random.Random(3)
    rows = [(i, t, r.choice("aaaabc")) for i, t in enumerate(texts(300, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    pieces = pack(docs, targets).collect()
    check_pieces(pieces, {i: t for i, t, _ in rows}, library)
    # while no queue is dry, every window has the targets' shares to a quantum or two
    shares = targets or {k: sum(len(library(t)) + 1 for _, t, s in rows if s == k) for k in "abc"}
    total = sum(shares.values())
    sent = {}
    for p in pieces:
        sent.setdefault(p.sequence_id, {}).setdefault(p.queue, []).append(p.length)
    for seq in range(3):
        for q, k in enumerate("abc"):
            assert abs(sum(sent[seq].get(q, [0])) - 2048 * shares[k] / total) <= 4 * 32


def test_pack_many_sources(spark, library):
    rows = [(i, "some words " * (i % 7), f"s{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_pieces(pack(docs, max_queues=8).collect(), {i: t for i, t, _ in rows}, library)


def test_pack_targets_of_many_sources(spark, library):
    """With more sources than queues, named sources keep their targets and the others the mean one each."""
    rows = [(i, "some words " * 40, k) for i, k in enumerate(["a"] * 90 + ["b"] * 90 + [f"s{i % 30}" for i in range(600)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {"a": 40.0, "b": 10.0}
    pieces = pack(docs, targets, max_queues=8).collect()
    check_pieces(pieces, {i: t for i, t, _ in rows}, library)
    source = {i: k for i, _, k in rows}
    total = 40 + 10 + 30 * 25
    # three windows in which no queue is dry yet
    first = [p for p in pieces if p.sequence_id < 3]
    for k, share in targets.items():
        assert abs(sum(p.length for p in first if source[p.doc_id] == k) - 3 * 2048 * share / total) <= 4 * 32
    assert len({p.queue for p in pieces}) <= 8 and len({p.queue for p in pieces if source[p.doc_id] in targets}) == 2
    # more named sources than queues
    named = {f"s{i}": 1.0 + i for i in range(20)}
    pieces = pack(docs, named, max_queues=4).collect()
    check_pieces(pieces, {i: t for i, t, _ in rows}, library)
    assert len({p.queue for p in pieces}) == 21


def test_pack_odd(odd, empty, library):
    pieces = pack(odd.filter("doc_id IS NULL OR doc_id <> 4"))
    check_pieces(pieces.collect(), {r.doc_id: r.text for r in odd.collect() if r.doc_id != 4}, library)
    assert sum(r.length for r in pack(odd).collect()) == sum(len(library(r.text)) + 1 for r in odd.collect())
    assert pack(empty).collect() == []
    for w in windows(pieces).collect():
        power = w.tokens & (w.tokens - 1) == 0
        assert w.padding == (0 if power else 2048 - w.tokens)


def test_rounds_carry_deficits():
    r = Rounds([10_000, 3_000, 500], [0.6, 0.3, 0.1], 2048, 32)
    j = np.arange(1, 60)
    sent = r.sent(j)
    assert (np.diff(sent, axis=0) >= 0).all() and (sent[-1] == r.totals).all()
    free = np.outer(j, r.step) * 32
    assert (np.abs(np.minimum(free, r.totals) - sent) <= 32).all()
    for q in range(3):
        x = np.arange(r.totals[q])
        at = r.round_of(np.full(len(x), q), x)
        assert (r._sent(np.full(len(x), q), at) > x).all() and (r._sent(np.full(len(x), q), at - 1) <= x).all()


def cut_documents(rounds, docs):
    """Pieces of documents of (queue, first, n), by columns."""
    blobs = [zstandard.ZstdCompressor().compress(np.zeros(n, "<u4").astype(encoder(vocabulary()).type).tobytes()) for _, _, n in docs]
    columns = [pa.array(x, pa.int64()) for x in (range(len(docs)), *zip(*docs))]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], ["doc_id", "queue", "first", "n", "ids"])
    return [r for b in _cut(rounds, vocabulary(), 2048)([batch]) for r in b.to_pylist()]


def test_pieces_of_rounds_in_slabs(monkeypatch):
    """Pieces are where the rounds one by one put the tokens, also if a slab holds a few rounds."""
    monkeypatch.setattr("stagewise.llm.packing.SLAB", 40)
    rounds = Rounds([20_000, 3_000, 50, 700], [0.9, 0.08, 0.001, 0.019], 2048, 32)
    docs = [(q, at, min(n, total - at)) for q, (n, total) in enumerate([(900, 20_000), (77, 3_000), (20, 50), (700, 700)]) for at in range(0, total, n)]
    want = [np.zeros(t, int) for t in rounds.totals]
    at = 0
    before = rounds.sent(np.array([0]))[0]
    for j in range(1, 2000):
        after = rounds.sent(np.array([j]))[0]
        for q in range(4):
            want[q][before[q] : after[q]] = np.arange(at, at + after[q] - before[q])
            at += after[q] - before[q]
        before = after
    assert at == rounds.totals.sum()
    got = [np.full(t, -1) for t in rounds.totals]
    for r in cut_documents(rounds, docs):
        q, first, _ = docs[r["doc_id"]]
        place = r["sequence_id"] * 2048 + r["offset"]
        got[q][first + r["start"] :][: r["length"]] = np.arange(place, place + r["length"])
    assert all((g == w).all() for g, w in zip(got, want))


def test_small_source_beside_a_large_one():
    """A document of a rare source takes no memory for the rounds that its queue waits in."""
    rounds = Rounds([10**10] + [10_000] * 7, [10.0**10] + [10_000.0] * 7, 2048, 32)
    encoder(vocabulary())  # not part of what is measured
    tracemalloc.start()
    try:
        got = cut_documents(rounds, [(q, 4_000, 1_000) for q in range(1, 8)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [sum(r["length"] for r in got if r["doc_id"] == d) for d in range(7)] == [1_000] * 7
    assert peak < 32e6
