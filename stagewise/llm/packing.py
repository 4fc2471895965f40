"""Mixture-controlled packing: weighted deficit round-robin over source queues."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import column, cut, read, running_starts
from stagewise.llm.tokens import encoder, vocabulary

WINDOW, END_ID = 2048, 1
#: Tokens a queue gains or waits for at a time, and queues at most.
QUANTUM, QUEUES = 32, 256
#: Numbers of rounds times queues that are worked out at a time.
SLAB = 1 << 20


class Rounds:
    """What each queue has sent after any round, in closed form.

    A round gives queue s its share w[s] of a window of credit. It sends whole quanta
    of its credit and carries the rest, its deficit, to the next round; so after j
    rounds it has sent floor(w[s] * window * j / quantum + phase) quanta, until it is
    empty. Any task can start at any round from this, with the deficits that all
    rounds before have left, in whatever partition they were.
    """

    def __init__(self, totals: list[int], weights: list[float], window: int, quantum: int):
        n = len(totals)
        self.totals = np.array(totals, "int64")
        self.quantum = quantum
        share = np.array(weights, "float64")
        self.step = share / share.sum() * window / quantum
        self.phase = (np.arange(n) + 0.5) / max(n, 1)

    def sent(self, j: np.ndarray) -> np.ndarray:
        """Tokens each queue has sent after rounds j: one row per round."""
        quanta = np.floor(np.multiply.outer(j.astype("float64"), self.step) + self.phase).astype("int64")
        quanta[j <= 0] = 0
        return np.minimum(quanta * self.quantum, self.totals)

    def _sent(self, q: np.ndarray, j: np.ndarray) -> np.ndarray:
        quanta = np.floor(j * self.step[q] + self.phase[q]).astype("int64")
        return np.where(j <= 0, 0, np.minimum(quanta * self.quantum, self.totals[q]))

    def round_of(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Round in which token x of queue q is sent."""
        j = np.maximum(np.ceil((x // self.quantum + 1 - self.phase[q]) / self.step[q]).astype("int64"), 1)
        while (late := (j > 1) & (self._sent(q, j - 1) > x)).any():
            j = j - late
        while (soon := self._sent(q, j) <= x).any():
            j = j + soon
        return j


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        e, zip_ = encoder(path), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], e.type).tobytes()
        for b in batches:
            got = [x + end for x in e.encode([t or "" for t in b.column("text").to_pylist()])]
            n = np.array([len(x) for x in got], "int64") // e.type.itemsize
            blob = pa.array([zip_.compress(x) for x in got], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("queue"), pa.array(n), blob], ["doc_id", "queue", "n", "ids"])

    return run


def _cut(rounds: Rounds, path: str, window: int):
    """Pieces of each document: between rounds, and at every end of a window."""

    def turns(queue: np.ndarray, first: np.ndarray, n: np.ndarray):
        """Document, first token in its queue, length and place of what each round sends of it, a slab at a time."""
        # rounds in which the queue sends a quantum that has tokens of the document, not those it waits in
        low = first // rounds.quantum
        count = (first + n - 1) // rounds.quantum - low + 1
        before = np.cumsum(count) - count
        slab = max(SLAB // len(rounds.totals), 1)
        last = (-1, -1)
        for lo in range(0, int(count.sum()), slab):
            k = np.arange(lo, min(lo + slab, int(count.sum())))
            doc = np.searchsorted(before, k, "right") - 1
            j = rounds.round_of(queue[doc], (low[doc] + k - before[doc]) * rounds.quantum)
            # several quanta of a document may go in one round
            new = np.r_[(doc[0], j[0]) != last, (doc[1:] != doc[:-1]) | (j[1:] != j[:-1])]
            last = (doc[-1], j[-1])
            doc, j = doc[new], j[new]
            q = queue[doc]
            every, where = np.unique(j, return_inverse=True)
            sent, then = rounds.sent(every - 1), rounds.sent(every)
            turn = then - sent
            place = sent.sum(1)[:, None] + np.cumsum(turn, 1) - turn
            opened, closed = sent[where, q], then[where, q]
            a, z = np.maximum(opened, first[doc]), np.minimum(closed, (first + n)[doc])
            yield doc, a, z - a, place[where, q] + a - opened

    def pieces(queue: np.ndarray, first: np.ndarray, n: np.ndarray):
        doc, a, m, at = (np.concatenate(x) for x in zip(*turns(queue, first, n)))
        # cut at the ends of windows
        parts = (at + m - 1) // window - at // window + 1
        piece = np.repeat(np.arange(len(doc)), parts)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        seq = at[piece] // window + k
        begin = np.maximum(at[piece], seq * window)
        stop = np.minimum((at + m)[piece], (seq + 1) * window)
        start = a[piece] - first[doc[piece]] + begin - at[piece]
        return doc[piece], start, stop - begin, seq, begin - seq * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip, kind = zstandard.ZstdDecompressor(), encoder(path).type
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                n = b.column("n").to_numpy()
                doc, start, length, seq, offset = pieces(b.column("queue").to_numpy(), b.column("first").to_numpy(), n)
                ids = [np.frombuffer(unzip.decompress(x), kind).astype("<u4") for x in b.column("ids").to_pylist()]
                crc = [zlib.crc32(ids[d][s : s + m]) for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist())]
                arrays = [b.column("doc_id").take(pa.array(doc)), start, length, pa.array(crc, pa.int64()), n[doc], seq, offset, b.column("queue").to_numpy()[doc]]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in arrays], PIECES)

    return run


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]


def pack(
    docs: DataFrame,
    targets: Mapping[str, float] | None = None,
    path: str | None = None,
    window: int = WINDOW,
    quantum: int = QUANTUM,
    end_id: int = END_ID,
    max_queues: int = QUEUES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of all documents in windows of `window` tokens, mixed by source.

    Each source is a queue of its documents' ids, `end_id` after each document. Every
    window is filled in rounds (`Rounds`) to the target token shares; without targets
    these are the sources' own shares of all tokens, so all queues run dry together.
    A source without a target gets the mean one. When a queue runs dry the rounds go
    on with the others. Windows are cut from the one stream of all rounds, so all but
    the last are full.

    Only the totals of the queues reach the driver. With more sources than `max_queues`
    each source in `targets` still has its queue. The others share the queues left, one
    at least, by their hashes: such a queue weighs the mean target times the number of
    its sources, or without targets all their tokens, and only its whole share is kept.
    A null source is a queue of its own, null and empty texts hold `end_id` alone,
    repeated rows and null ids are packed as any, an empty table gives no pieces.
    """
    path = path or vocabulary()
    source = F.coalesce(column(source_col).cast("string"), F.lit("\x00null"))
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"), source.alias("queue"))
    rows = cut(rows.mapInArrow(_encode(path, end_id), "doc_id long, queue string, n long, ids binary"))
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())

    totals = {r["queue"]: r["n"] for r in rows.groupBy("queue").agg(F.sum("n").alias("n")).limit(max_queues + 1).collect()}
    sources = dict.fromkeys(totals, 1)
    if len(totals) > max_queues:
        # named sources keep their queues, and the others share what is left of them
        named = rows.groupBy("queue").agg(F.sum("n").alias("n")).filter(F.col("queue").isin(list(targets or {}))).collect()
        own = {r["queue"] for r in named}
        shared = F.format_string("\x00%012d", F.pmod(F.xxhash64("queue"), F.lit(max(max_queues - len(own), 1))))
        rows = rows.withColumn("source", F.col("queue")).withColumn("queue", F.when(F.col("queue").isin(list(own)), F.col("queue")).otherwise(shared))
        by_source = rows.groupBy("queue", "source").agg(F.sum("n").alias("n"))
        found = by_source.groupBy("queue").agg(F.sum("n").alias("n"), F.count("*").alias("sources")).collect()
        totals, sources = {r["queue"]: r["n"] for r in found}, {r["queue"]: r["sources"] for r in found}
    names = sorted(totals)
    if targets:
        mean = sum(targets.values()) / len(targets)
        weights = [max(float(targets.get(k, mean * sources[k])), 1e-9) for k in names]
    else:
        weights = [float(totals[k]) for k in names]
    if names:
        # the queue's number, by a literal table of one entry for each
        number = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (k, i)]), F.col("queue"))
    else:
        number, weights = F.lit(0), [1.0]
    rows = rows.withColumn("queue", number.cast("long"))
    rounds = Rounds([totals[k] for k in names] or [0], weights, window, quantum)

    firsts = running_starts(rows.select("queue", "part", "row", "n"), ["queue"], "part", ["row"], "n", "first")
    joined = rows.select("row", "doc_id", "n", "queue", "ids").join(firsts.select("row", "first"), "row")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue long"
    return joined.mapInArrow(_cut(rounds, path, window), schema)


def windows(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per sequence its tokens and the padding up to the window, none at a power of two."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return filled.withColumn("padding", F.when(power, 0).otherwise(window - F.col("tokens")))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows that keep the sources' token shares."""
    return pack(read(spark, sf_dir, "documents"))
