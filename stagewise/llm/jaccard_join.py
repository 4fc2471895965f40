"""Near copies by word shingles: a Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm import exchange as X
from stagewise.llm.common import cut, read
from stagewise.llm.components import components
from stagewise.llm.words import Words, mix, slabs

#: Words of a shingle; a link needs 100 * common >= PERCENT * united shingles.
SHINGLE, PERCENT = 5, 80
#: Matches asked for at most; price of verifying a candidate, in postings per shingle.
MATCHES, PRICE = 8, 0.02
#: Other documents from which on a posting may be that of a group of near copies.
LARGE = 199


def _sets(chunk: X.Chunk, shingle: int):
    """Per slab the distinct shingles of its documents: (document in the chunk, hash), sorted."""
    for a, z in slabs([len(t) for t in chunk.texts]):
        w = Words(chunk.texts[a:z], lower=True)
        h, d = w.shingles(shingle)
        by = np.lexsort((h, d))
        h, d = h[by], d[by]
        new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
        yield a, z, d[new] + a, h[new]


def _digests(shingle: int):
    """Per document the size of its set, and 128 bits that tell sets apart."""

    def work(chunk, _):
        for a, z, d, h in _sets(chunk, shingle):
            n = np.bincount(d - a, minlength=z - a)
            sums = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                total = np.cumsum(np.r_[np.uint64(0), mix(h ^ np.uint64(salt))], dtype=np.uint64)
                end = np.cumsum(n)
                sums.append((total[end] - total[end - n]).view(np.int64))
            node = (chunk.number << X.PLACE) + np.arange(a, z)
            ids = pa.array(chunk.raw_ids[a:z], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node), ids, pa.array(n), *map(pa.array, sums)], ["node", "doc_id", "n", "d1", "d2"])

    return work


def _own(chunk: X.Chunk, replies: X.Replies, shingle: int):
    """Sets of the documents that represent a class of equal sets."""
    mine = np.zeros(len(chunk.texts), bool)
    mine[list(replies["chosen"])] = True
    for _, _, d, h in _sets(chunk, shingle):
        keep = mine[d]
        yield d[keep], h[keep]


def _counted(chunk: X.Chunk, replies: X.Replies, shingle: int):
    h = np.concatenate([h for _, h in _own(chunk, replies, shingle)])
    return np.unique(h, return_counts=True)


def _ask_frequency(shingle: int, buckets: int):
    def emit(chunk, replies):
        keys, n = _counted(chunk, replies, shingle)
        n = np.minimum(n, 60_000).astype(np.uint16)
        for b, part in X.spread(keys, buckets):
            yield b, pickle.dumps((X.pack_sorted(X.short(keys[part], b, buckets)), X.squeeze(n[part].tobytes())))

    return emit


def _frequency(messages: list[bytes]) -> list[bytes]:
    """In how many documents a shingle is: 1 to 199, or 200 and more by powers of two."""
    loaded = []
    for m in messages:
        keys, n = pickle.loads(m)
        loaded.append((X.unpack_sorted(keys, "uint32"), np.frombuffer(X.stretch(n), np.uint16).astype(np.int64)))
    keys, n = (np.concatenate(x) for x in zip(*loaded))
    every, where = np.unique(keys, return_inverse=True)
    total = np.bincount(where, n).astype(np.int64)
    class_ = np.where(total < 200, total, np.minimum(193 + np.floor(np.log2(np.maximum(total, 1))), 255)).astype(np.uint8)
    return [X.squeeze(class_[np.searchsorted(every, k)].tobytes()) for k, _ in loaded]


def _read_classes(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(X.stretch(data), np.uint8, count=n)


def choose_matches(cost: np.ndarray, p: int, n: int, most: int, price: float) -> int:
    """How many common prefix shingles to ask of a document's candidates.

    `cost[i]` is the number of other documents with the i-th rarest shingle. To ask for
    l matches the prefix takes p + l - 1 shingles, whose postings are read; a candidate
    uses up l of them, so that about a l-th part as many are verified, at the price of
    their n shingles. Not so for postings of LARGE and more: these may all hold the same
    group of near copies, which is thinned out only if there are fewer than l of them.
    """
    large = cost >= LARGE
    read_, thin = np.cumsum(cost), np.cumsum(np.where(large, 0, cost))
    count, group = np.cumsum(large), np.maximum.accumulate(np.where(large, cost, 0)) if len(cost) else cost
    best, least = 1, None
    for l in range(1, min(most, n - p + 1) + 1):  # noqa: E741
        at = p + l - 2
        postings = float(read_[at])
        held = group[at] if count[at] >= l else (postings - thin[at]) / l
        total = postings + price * n * (thin[at] / l + held)
        if least is None or total < least:
            best, least = l, total
    return best


def _profiles(shingle: int, percent: int, buckets: int, most: int, price: float):
    """Documents whose prefix holds a shingle of another: prefix with places, and shared shingles."""

    def work(chunk, replies):
        keys, _ = _counted(chunk, replies, shingle)
        classes = X.gathered(keys, replies["frequency"], buckets, _read_classes, np.uint8)
        rows = []
        for d, h in _own(chunk, replies, shingle):
            if not len(d):
                continue
            class_ = classes[np.searchsorted(keys, h)]
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            n = np.diff(np.r_[first, len(d)])
            alone = np.add.reduceat(class_ == 1, first, dtype=np.int64)
            p = n - -(-percent * n // 100) + 1
            # with p shingles or more that no other document has, too few are left to share
            for k in np.flatnonzero(alone < p).tolist():
                part = slice(first[k], first[k] + n[k])
                c, own = class_[part], h[part]
                order = np.lexsort((own, c))
                cost = np.where(c < 200, c - 1.0, 2.0 ** (c.astype(float) - 193))[order]
                l = choose_matches(cost, int(p[k]), int(n[k]), most, price)  # noqa: E741
                take = order[: p[k] + l - 1]
                place = np.arange(len(take))
                shared = c[take] > 1
                if not shared.any():
                    continue
                rows.append(
                    {
                        "node": (chunk.number << X.PLACE) + int(d[first[k]]),
                        "n": int(n[k]),
                        "open": int(n[k] - alone[k]),
                        "matches": l,
                        "tokens": own[take[shared]].view(np.int64).tolist(),
                        "places": place[shared].tolist(),
                        "shared": np.sort(own[c > 1]).tobytes(),
                    }
                )
        yield pa.RecordBatch.from_pylist(rows, PROFILE)

    return work


PROFILE = pa.schema(
    [("node", pa.int64()), ("n", pa.int64()), ("open", pa.int64()), ("matches", pa.int32()), ("tokens", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("shared", pa.binary())]
)


def _verify(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            columns = [b.column(c) for c in ("left", "right", "n", "m")]
            for i, (x, y, n, m) in enumerate(zip(*columns)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                common = int(X.member(x, y).sum())
                keep.append(100 * common >= percent * (n.as_py() + m.as_py() - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

    return run


def verified(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that are links, by their whole sets."""
    sets = profiles.select("node", "n", "shared")
    left = sets.select(F.col("node").alias("a"), "n", F.col("shared").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("shared").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    return both.mapInArrow(_verify(percent), "a long, b long")


def _least(percent: int, n: str, m: str) -> str:
    """Shingles that linked sets of n and m have in common at the fewest."""
    return f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}"


def _reached(matches: str, percent: int) -> F.Column:
    """Whether a common shingle counts for a pair that must share `matches` of them.

    Linked sets of n and m shingles have o = percent (n + m) / (100 + percent) in
    common, or more, so they share l of the first n - o + l and m - o + l. Neither has
    fewer than o that are `open`, shingles of other documents too.
    """
    o = _least(percent, "n", "n_")
    return F.expr(f"least(open, open_) >= {o} AND place < n - {o} + {matches} AND place_ < n_ - {o} + {matches}")


def _links(profiles: DataFrame, percent: int) -> DataFrame:
    """(node, root) of linked documents.

    First every posting is checked against one of its documents, the one with the
    smallest share of shingles of its own, which joins what belongs together without
    forming the pairs of a posting. After that only pairs of different components remain: all of
    them that share enough shingles of the prefixes that their sizes ask for are
    formed and verified. Members with too many shingles of their own for any partner
    are left out before; the others of the posting's largest component meet the members
    of other ones only, not each other.
    """
    postings = profiles.select("node", "n", "open", "matches", F.explode(F.arrays_zip("tokens", "places")).alias("p"))
    postings = postings.select("node", "n", "open", "matches", F.col("p.tokens").alias("token"), F.col("p.places").alias("place"))
    alone = (1 - F.col("open") / F.col("n")).alias("alone")
    centre = postings.groupBy("token").agg(F.min(F.struct(alone, "node", "n", "open", "place")).alias("c"), F.count("*").alias("size")).filter("size > 1")
    centre = centre.select("token", *[F.col(f"c.{x}").alias(f"{x}_") for x in ("node", "n", "open", "place")])
    stars = postings.join(centre, "token").filter("node <> node_").filter(_reached("1", percent))
    stars = cut(stars.select(F.col("node").alias("a"), F.col("node_").alias("b")).distinct())
    links = cut(verified(stars, profiles, percent))
    roots = components(links)

    placed = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = placed.groupBy("token", "root").agg(F.count("*").alias("members"), F.min("n").alias("n"))
    mixed = held.groupBy("token").agg(F.max(F.struct("members", "root")).alias("g"), F.count("*").alias("roots"), F.min("n").alias("smallest")).filter("roots > 1")
    placed = placed.join(mixed.select("token", "smallest", F.col("g.root").alias("largest")), "token")
    # the fewest are asked of a pair with the smallest set, which has `percent` of this one at least
    partner = f"greatest(smallest, ({percent} * n + 99) div 100)"
    right = cut(placed.filter(f"open >= {_least(percent, 'n', partner)}").drop("smallest"))
    left = right.filter("root <> largest")
    right = right.select(*[F.col(c).alias(f"{c}_" if c != "token" else c) for c in right.columns if c != "largest"])
    # two members of smaller components meet twice, once is enough
    apart = "root <> root_ AND (root_ = largest OR node < node_)"
    pairs = left.join(right, "token").filter(apart).filter(_reached("least(matches, matches_)", percent))
    pairs = pairs.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"), F.least("matches", "matches_").alias("least"))
    pairs = pairs.groupBy("a", "b", "least").agg(F.count("*").alias("common")).filter("common >= least").select("a", "b")
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(verified(pairs.join(known, ["a", "b"], "left_anti"), profiles, percent))
    if more.isEmpty():
        return roots
    return components(links.unionByName(more))


def near_copies(
    docs: DataFrame,
    percent: int = PERCENT,
    shingle: int = SHINGLE,
    most: int = MATCHES,
    price: float = PRICE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document the size of its shingle set and the smallest id reachable by links.

    Shingles are of A-Z in lower case; a text of fewer words has its whole sequence as
    one. Documents of equal sets are one class, only one of which is compared.
    Shingles are ordered from rare to frequent. Two documents that are similar enough
    share l of the first n - 0.8 n + l of their shingles; each document chooses the l
    that costs least by the frequencies in its prefix, and two documents need the
    smaller of their numbers.

    Documents without words have no shingles and link with nothing. Rows of equal id
    are documents of their own; `component_id` is null where no member has an id. An
    empty table gives no rows. Shingles are told apart by 64-bit hashes, sets by 128.
    """
    chunks = X.chunked(docs, id_col, text_col)
    buckets = X.bucket_count(chunks)
    all_ = cut(X.per_chunk(chunks, _digests(shingle), "node long, doc_id long, n long, d1 long, d2 long"))
    classes = all_.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("node").alias("chosen"), F.min("doc_id").alias("least"))
    classes = cut(classes)
    chosen = classes.select(F.expr(f"chosen >> {X.PLACE}").alias("chunk"), F.expr(f"cast(chosen & {(1 << X.PLACE) - 1} as int)").alias("bucket"))
    chosen = chosen.groupBy("chunk").agg(F.collect_list(F.struct("bucket", F.lit(None).cast("binary").alias("reply"))).alias("chosen"))
    chunks = chunks.join(chosen, "chunk")
    chunks = X.exchange(chunks, "frequency", _ask_frequency(shingle, buckets), _frequency)
    fields = "node long, n long, open long, matches int, tokens array<long>, places array<int>, shared binary"
    profiles = cut(X.per_chunk(chunks, _profiles(shingle, percent, buckets, most, price), fields))
    roots = _links(profiles, percent)

    placed = classes.join(roots, classes["chosen"] == roots["node"], "left").withColumn("root", F.coalesce("root", "chosen"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = placed.join(smallest, "root").select("n", "d1", "d2", "component_id")
    linked = all_.filter("n > 0").join(by_class, ["n", "d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "node")
    alone = all_.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "node")
    return linked.unionByName(alone)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by shingles in common."""
    return near_copies(read(spark, sf_dir, "documents")).drop("node")
