"""Repeated word sequences by fixed-block anchors."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stagewise.llm import exchange as X
from stagewise.llm.common import read
from stagewise.llm.words import Words, rolling, slabs

#: Words of a window. Any window holds a whole block when blocks have half as many.
WINDOW = 13


def _parts(chunk: X.Chunk):
    """The chunk's texts some MB at a time, with the ids of their words' documents."""
    for a, z in slabs([len(t) for t in chunk.texts]):
        w = Words(chunk.texts[a:z])
        yield a, z, w, chunk.ids[a:z][w.doc]


def _distinct(keys: np.ndarray, ids: np.ndarray, flag: np.ndarray | None = None):
    """Sorted distinct keys, their smallest and largest id, whether any has the flag."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if not len(at):
        return keys, ids, ids, np.zeros(0, bool)
    some = np.logical_or.reduceat(flag[order], at) if flag is not None else None
    return keys[at], np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at), some


def _grams(chunk: X.Chunk, block: int):
    """All rolling windows of block length: the distinct ones, and which are an aligned block."""
    keys, ids, flags = [], [], []
    for _, _, w, doc in _parts(chunk):
        h, ok = rolling(w.hash, w.doc, block)
        place = np.arange(len(h)) - w.first[w.doc]
        keys.append(h[ok])
        ids.append(doc[ok])
        flags.append(place[ok] % block == 0)
    return _distinct(np.concatenate(keys), np.concatenate(ids), np.concatenate(flags))


def _probe(block: int, buckets: int):
    """Send rolling windows, marked as reference blocks and as shared inside the chunk."""

    def emit(chunk, _):
        keys, low, high, anchor = _grams(chunk, block)
        for b, part in X.spread(keys, buckets):
            yield b, X.pickle.dumps((X.pack_sorted(X.short(keys[part], b, buckets)), X.bits(anchor[part]), X.bits(low[part] != high[part])))

    return emit


def _hits(messages: list[bytes]) -> list[bytes]:
    """Which of a chunk's windows equal a reference block and occur in two documents or more."""
    loaded = []
    for m in messages:
        keys, anchor, shared = X.pickle.loads(m)
        keys = X.unpack_sorted(keys, "uint32")
        loaded.append((keys, X.unbits(anchor, len(keys)), X.unbits(shared, len(keys))))
    every = np.sort(np.concatenate([k for k, _, _ in loaded]))
    blocks = np.unique(np.concatenate([k[a] for k, a, _ in loaded]))
    inside = np.unique(np.concatenate([k[s] for k, _, s in loaded]))
    out = []
    for keys, _, _ in loaded:
        often = np.searchsorted(every, keys, "right") - np.searchsorted(every, keys, "left") > 1
        out.append(X.bits((often | X.member(keys, inside)) & X.member(keys, blocks)))
    return out


def _near(chunk: X.Chunk, replies: dict, buckets: int, window: int, block: int):
    """Per slab: windows that hold a hit, as (first word, hash, id), to be extended."""
    keys, _, _, _ = _grams(chunk, block)
    useful = keys[X.gathered(keys, replies, buckets, X.unbits, bool)]
    for a, z, w, doc in _parts(chunk):
        h, ok = rolling(w.hash, w.doc, block)
        hit = ok & X.member(h, useful)
        # a window's first aligned block starts at one of its first `block` words
        n = np.cumsum(np.r_[0, hit])
        full, good = rolling(w.hash, w.doc, window)
        upto = np.minimum(np.arange(len(hit)) + block, len(hit))
        first = np.flatnonzero(good & (n[upto] > n[: len(hit)]))
        yield a, z, w, first, full[first], doc[first]


def _extend(window: int, block: int, buckets: int):
    """Send the windows around hits, each with the smallest id that has it in the chunk."""

    def emit(chunk, replies):
        found = [(h, i) for *_, h, i in _near(chunk, replies["hits"], buckets, window, block)]
        keys, low, _, _ = _distinct(np.concatenate([h for h, _ in found]), np.concatenate([i for _, i in found]))
        for b, part in X.spread(keys, buckets):
            yield b, X.pickle.dumps((X.pack_sorted(keys[part]), X.squeeze(low[part].tobytes())))

    return emit


def _earlier(messages: list[bytes]) -> list[bytes]:
    """Which of a chunk's windows start in a document of another chunk with a smaller id."""
    loaded = []
    for m in messages:
        keys, low = X.pickle.loads(m)
        loaded.append((X.unpack_sorted(keys, "uint64"), np.frombuffer(X.stretch(low), np.int64)))
    every, least, _, _ = _distinct(np.concatenate([k for k, _ in loaded]), np.concatenate([i for _, i in loaded]))
    return [X.bits(least[np.searchsorted(every, k)] < i) for k, i in loaded]


def _remove(window: int, block: int, buckets: int):
    """Documents without the words that extended windows cover."""

    def work(chunk, replies):
        slabs_ = list(_near(chunk, replies["hits"], buckets, window, block))
        keys, low, _, _ = _distinct(np.concatenate([x[4] for x in slabs_]), np.concatenate([x[5] for x in slabs_]))
        gone = X.gathered(keys, replies["earlier"], buckets, X.unbits, bool)
        rows = {"doc_id": [], "n_words": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for a, z, w, first, h, ids in slabs_:
            at = np.searchsorted(keys, h)
            first = first[gone[at] | (low[at] < ids)]
            cover = np.zeros(len(w.hash) + window, np.int32)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + window, -1)
            dead = np.cumsum(cover)[: len(w.hash)] > 0
            starts = dead & np.r_[True, ~dead[:-1] | (w.doc[1:] != w.doc[:-1])] if len(dead) else dead
            removed = np.bincount(w.doc[dead], minlength=z - a)
            runs = np.bincount(w.doc[starts], minlength=z - a)
            for k, text in enumerate(chunk.texts[a:z]):
                parts = text.split()
                if removed[k]:
                    parts = compress(parts, ~dead[w.first[k] : w.first[k] + w.count[k]])
                rows["kept_sha256"].append(hashlib.sha256(b" ".join(parts)).hexdigest())
            rows["doc_id"] += chunk.raw_ids[a:z]
            rows["n_words"] += w.count.tolist()
            rows["n_removed"] += removed.tolist()
            rows["n_spans"] += runs.tolist()
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))

    return work


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document what is left without word windows that start in a document of smaller id.

    Documents are cut into non-overlapping blocks of (window + 1) // 2 words, so that
    every window holds a whole block of each document it occurs in. All rolling
    windows of block length probe these blocks; only around hits are full windows
    hashed and looked up, which extends the hits to maximal repeats.

    `kept_sha256` is of the kept words joined by one space. Null, empty and blank texts
    have no words. Rows of equal id do not remove each other's words; a null id counts
    as larger than all others. An empty table gives no rows. Windows are told apart by
    64-bit hashes.
    """
    block = (window + 1) // 2
    chunks = X.chunked(docs, id_col, text_col)
    buckets = X.bucket_count(chunks)
    chunks = X.exchange(chunks, "hits", _probe(block, buckets), _hits)
    chunks = X.exchange(chunks, "earlier", _extend(window, block, buckets), _earlier)
    schema = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"
    return X.per_chunk(chunks, _remove(window, block, buckets), schema)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without repeated sequences of 13 words."""
    return dedup_substrings(read(spark, sf_dir, "documents"))
