"""Benchmark items inside documents: MinHash over windows of each size class, exact shingle containment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import cut, deal, read, texts
from stagewise.llm.words import Words, mix, slabs

#: Words of a shingle, and least share of an item's shingles.
SHINGLE, CONTAINED = 5, 0.8
#: Distinct shingles of items that are broadcast at a time.
BROADCAST_SHINGLES = 2_000_000
#: Chance that MinHash misses a containing window, and the most hashes a size class may need for it.
MISS, HASHES = 1e-5, 64
#: Shingles of windows that are hashed at a time.
_AT_ONCE = 1 << 18


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per item its distinct shingles, and how many it has with repeats."""
    schema = pa.schema([("item", pa.int64()), ("raw", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for b in batches:
        w = Words([(t or "").encode() for t in b.column("text").to_pylist()], lower=True)
        h, d = w.shingles(SHINGLE)
        by = np.argsort(d, kind="stable")
        h, ends = h[by], np.cumsum(np.bincount(d, minlength=b.num_rows)) if len(d) else np.zeros(b.num_rows, np.int64)
        rows = []
        for item, all_of in zip(b.column("doc_id").to_pylist(), np.split(h, ends[:-1])):
            if len(own := np.unique(all_of)):
                rows.append({"item": item, "raw": len(all_of), "n": len(own), "shingles": own.view(np.int64).tolist()})
        yield pa.RecordBatch.from_pylist(rows, schema)


def _wanted(n: int, contained: float) -> int:
    """Least number of an item's n distinct shingles that a containing text has."""
    return math.ceil(contained * n - 1e-9)


def sketch_size(n: int, contained: float) -> int:
    """Shingles of an item of n that a text cannot all lack if it has a share of `contained` of them."""
    return min(n, n - _wanted(n, contained) + 1)


def size_class(raw: int) -> int:
    """Items of more than half as many shingles, repeats counted, up to this many share a class."""
    return 1 << max(0, raw - 1).bit_length()


def hashes_needed(n: int, size: int, contained: float) -> int:
    """Hashes by which a window of a class that contains an item of n distinct shingles is missed with chance MISS.

    The window has 2 * size shingles at most, so the least Jaccard similarity of both follows
    from the share of the item it must have; each hash agrees with that chance.
    """
    shared = _wanted(n, contained)
    least = shared / (2 * size + n - shared)
    return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log1p(-least))


def _salts(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class SizeClass:
    """MinHash signatures of the items of one size, against windows of twice that size.

    Windows start at every multiple of the size, so a stretch of `size` shingles lies whole
    in one of them.
    """

    def __init__(self, size: int, who: list[int], sets: list[np.ndarray], contained: float):
        self.size = size
        self.salts = _salts(max(hashes_needed(len(x), size, contained) for x in sets))
        n = [len(x) for x in sets]
        flat, first = np.concatenate(sets), np.cumsum(n) - n
        keys, owner, chosen = [], [], []
        for j, salt in enumerate(self.salts):
            hashed = mix(flat ^ salt)
            least = np.minimum.reduceat(hashed, first)
            keys.append(self._key(least, j))
            owner.append(np.array(who))
            chosen.append(flat[hashed == np.repeat(least, n)])
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        by = np.argsort(keys, kind="stable")
        self.who = owner[by]
        self.keys, self.first, self.count = np.unique(keys[by], return_index=True, return_counts=True)
        self.minima = np.unique(np.concatenate(chosen))

    @staticmethod
    def _key(least: np.ndarray, j: int) -> np.ndarray:
        """A signature's value together with its place in the signature."""
        return mix(least + np.uint64(j + 1))

    def find(self, h: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Pairs (document, item) with an equal value in the signatures of a window and the item.

        A value of an item's signature stands for one of its shingles, so signatures are
        worked out only for windows that hold such a shingle; no other window can agree.
        """
        hit = np.flatnonzero(_among(self.minima, h))
        if not len(hit):
            return np.zeros((2, 0), np.int64)
        inside = (hit - first[doc[hit]]) // self.size
        start = np.r_[hit - (hit - first[doc[hit]]) % self.size, (first[doc[hit]] + (inside - 1) * self.size)[inside > 0]]
        start = np.unique(start)
        end = np.minimum(start + 2 * self.size, (first + count)[doc[start]])
        out = []
        step = max(1, _AT_ONCE // (2 * self.size))
        for a in range(0, len(start), step):
            lo, hi = start[a : a + step], end[a : a + step]
            # a window that the text's end cuts short repeats its last shingle
            values = h[np.minimum(lo[:, None] + np.arange(2 * self.size), hi[:, None] - 1)]
            for j, salt in enumerate(self.salts):
                key = self._key(mix(values ^ salt).min(axis=1), j)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                same = np.flatnonzero(self.keys[at] == key)
                if len(same):
                    out.append(_expand(doc[lo[same]], at[same], self))
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


class Sketches:
    """Items by the rarest of their shingles, as many as no containing text can all lack."""

    def __init__(self, sets: list[np.ndarray], contained: float, who: list[int]):
        known, often = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
        sketches = []
        for own in (sets[i] for i in who):
            # the rarest among the items, then the smallest hashes: what many items share makes few candidates
            rare = np.lexsort((own, often[np.searchsorted(known, own)]))
            sketches.append(own[rare[: sketch_size(len(own), contained)]])
        owner = np.repeat(np.array(who, np.int64), [len(x) for x in sketches])
        keys = np.concatenate([np.zeros(0, np.uint64), *sketches])
        by = np.argsort(keys, kind="stable")
        self.who = owner[by]
        self.keys, self.first, self.count = np.unique(keys[by], return_index=True, return_counts=True)

    def find(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Pairs (document, item) where a document has a shingle of an item's sketch."""
        if not len(self.keys):
            return np.zeros((2, 0), np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == h)
        found, key = np.unique(np.stack([doc[hit], at[hit]]), axis=1)
        return _expand(found, key, self)


def _among(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _expand(doc: np.ndarray, key: np.ndarray, table: SizeClass | Sketches) -> np.ndarray:
    """Each document with all items of its key."""
    n = table.count[key]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.stack([np.repeat(doc, n), table.who[np.repeat(table.first[key], n) + inside]])


class Index:
    """Items by size class, their sketches, and all their shingles for the exact test."""

    def __init__(self, rows: list, contained: float, scattered: bool = True):
        self.contained = contained
        self.items = [r["item"] for r in rows]
        self.sets = [np.array(r["shingles"], np.int64).view(np.uint64) for r in rows]
        classes, unmet = {}, []
        for i, r in enumerate(rows):
            size = size_class(r["raw"])
            if hashes_needed(r["n"], size, contained) <= HASHES:
                classes.setdefault(size, []).append(i)
            else:
                unmet.append(i)
        self.classes = [SizeClass(size, who, [self.sets[i] for i in who], contained) for size, who in sorted(classes.items())]
        self.rest = Sketches(self.sets, contained, list(range(len(rows))) if scattered else unmet)

    def find(self, h: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[tuple[int, int]]:
        """Candidates (document, item), in order; `h` has the shingles of each document in their order."""
        if not len(h):
            return []
        pairs = [c.find(h, doc, first, count) for c in self.classes] + [self.rest.find(h, doc)]
        return list(zip(*np.unique(np.concatenate(pairs, axis=1), axis=1).tolist()))


def _search(index):
    """Per document its items, verified on the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Index = index.value
        names = ["row", "doc_id", "item", "shared", "n"]
        for b in batches:
            rows, ids = b.column("row"), b.column("doc_id")
            data = [(t or "").encode() for t in b.column("text").to_pylist()]
            for a, z in slabs([len(t) for t in data]):
                w = Words(data[a:z], lower=True)
                h, d = w.shingles(SHINGLE)
                by = np.argsort(d, kind="stable")
                h, d = h[by], d[by]
                count = np.bincount(d, minlength=z - a) if len(d) else np.zeros(z - a, np.int64)
                first = np.cumsum(count) - count
                out = []
                sets = {}
                for doc, item in items.find(h, d, first, count):
                    if doc not in sets:
                        sets[doc] = np.unique(h[first[doc] : first[doc] + count[doc]])
                    own, other = sets[doc], items.sets[item]
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    shared = int((own[at] == other).sum())
                    if shared >= items.contained * len(other) - 1e-9:
                        out.append((doc, items.items[item], shared, len(other)))
                where = pa.array([a + o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.take(where), ids.take(where)] + [pa.array([o[k] for o in out], pa.int64()) for k in (1, 2, 3)], names)

    return run


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    contained: float = CONTAINED,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    scattered: bool = True,
) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles) of items that a document contains.

    A document contains an item if it has at least `contained` of the item's distinct
    shingles: 5 words, A-Z in lower case; the whole text where it has fewer words.

    Items are parted by size, repeats counted, into classes of one power of two each. A
    document is cut into overlapping windows of twice the class's size, and a window whose
    MinHash signature agrees with an item's in one value makes the item a candidate of its
    document. Signatures of a class have as many values as its items' distinct shingles ask
    for: a window that contains an item is missed with a chance of MISS. Candidates are
    verified on the whole document, exactly.

    Two kinds of items lie outside that bound: those that repeat their shingles so often that
    more than HASHES values would be needed, and those whose pieces lie in different
    windows of a document (looked for with `scattered`). They become candidates by sketches:
    a document with a share of `contained` of an item's n shingles has one of any
    n - ceil(contained * n) + 1 of them, wherever they stand. So many, the rarest among the
    items, are its sketch; a document with one of them is a candidate. With `scattered` no
    item is missed.

    Items are broadcast in parts of about BROADCAST_SHINGLES shingles. Null, empty and blank
    items or texts match nothing; equal items and repeated rows each give their rows; a null
    id stays null; empty tables give no rows.
    """
    rows = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    found = _found(rows, benchmark, contained, item_col, item_text_col, scattered)
    return found.select("doc_id", F.col("item").alias("item_id"), "shared", F.col("n").alias("item_shingles"))


def _found(rows: DataFrame, benchmark: DataFrame, contained: float, item_col: str, item_text_col: str, scattered: bool) -> DataFrame:
    spark = rows.sparkSession
    schema = "item long, raw long, n long, shingles array<long>"
    items = deal(texts(benchmark, item_col, item_text_col), "doc_id", least=1).mapInArrow(_items, schema)
    items = cut(items.withColumn("row", F.monotonically_increasing_id()))
    parts = -(-(items.agg(F.sum("n")).first()[0] or 0) // BROADCAST_SHINGLES)
    out = None
    for p in range(max(parts, 1)):
        some = items if parts <= 1 else items.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == p)
        index = spark.sparkContext.broadcast(Index(some.collect(), contained, scattered))
        got = rows.select("row", "doc_id", "text").mapInArrow(_search(index), "row long, doc_id long, item long, shared long, n long")
        out = got if out is None else out.unionByName(got)
    return out


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
