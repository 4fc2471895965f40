"""Chunks of documents that ask a question about their keys and get an answer for each.

Operators that compare every piece of every document with all others would shuffle a
row for each piece. Here a chunk, some MB of whole documents, sorts its distinct keys,
cuts them by key into buckets and sends each bucket one packed array. A bucket sees
the arrays of all chunks, and answers each with one small value per key. A key that a
third of all documents share is sent once per chunk, so no bucket grows with a group.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import cut, deal, texts

#: Bytes of text in a chunk; chunks whose keys share a bucket.
CHUNK, SHARE = 4 << 20, 3
#: Bits of a key that filters send.
CODE = 28
#: Bits of a document's place in its chunk, whose number takes the others.
PLACE = 21
#: Order of rows without an id: behind all others.
NO_ID = np.iinfo(np.int64).max


def squeeze(data: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def stretch(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


class Chunk:
    """Whole documents: ids (NO_ID for null) and texts as UTF-8 bytes."""

    def __init__(self, ids: list[int | None], data: list[bytes]):
        self.raw_ids, self.texts, self.number = ids, data, 0
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)

    def dump(self) -> bytes:
        return squeeze(pickle.dumps((self.raw_ids, self.texts), protocol=5), 6)

    @staticmethod
    def load(blob: bytes) -> Chunk:
        return Chunk(*pickle.loads(stretch(blob)))


def _gather(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, data, size = TaskContext.get().partitionId() << 20, [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([Chunk(ids, data).dump()], pa.binary())], ["chunk", "blob"])

        for b in batches:
            column = b.column("text").cast(pa.large_binary())
            for i, t in zip(b.column("doc_id").to_pylist(), column):
                t = t.as_py() or b""
                ids.append(i)
                data.append(t)
                size += len(t) + 16
                if size >= limit or len(ids) >= 1 << 20:
                    yield out()
                    number, ids, data, size = number + 1, [], [], 0
        if ids:
            yield out()

    return run


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = CHUNK) -> DataFrame:
    """(chunk, blob), written once to the checkpoint folder and dealt out by chunk.

    The partitioning by chunk stays known, so answers join without moving the texts.
    """
    rows = texts(docs, id_col, text_col).mapInArrow(_gather(limit), "chunk long, blob binary")
    return cut(deal(rows, "chunk"))


def bucket_count(chunks: DataFrame) -> int:
    """Buckets for the keys of these chunks: as many as a bucket's share of all keys stays the same."""
    return max(12, chunks.select("chunk").count() // SHARE)


def spread(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """Bucket numbers and slices of sorted 64-bit keys, for buckets that get any."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    at = [0, *np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]
    return [(b, slice(at[b], at[b + 1])) for b in range(buckets) if at[b] < at[b + 1]]


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted integers as differences, byte plane by byte plane."""
    d = np.diff(values, prepend=values.dtype.type(0))
    return squeeze(d.view(np.uint8).reshape(len(d), -1).T.tobytes())


def unpack_sorted(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(stretch(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    d = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(d, dtype=kind)


def short(keys: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """The keys of a bucket in CODE bits, in the same order.

    For filters: different keys may meet, about one in 200 of them at any size, as
    buckets do not grow.
    """
    low = np.uint64((bucket << 64) // buckets)
    width = ((1 << 64) + buckets - 1) // buckets + 1
    shift = max(0, (width - 1).bit_length() - CODE)
    return ((keys - low) >> np.uint64(shift)).astype(np.uint32)


Replies = dict[str, dict[int, bytes]]


def exchange(
    chunks: DataFrame,
    name: str,
    emit: Callable[[Chunk, Replies], Iterator[tuple[int, bytes]]],
    answer: Callable[[list[bytes]], list[bytes]],
) -> DataFrame:
    """The chunks with one more column, `name`: what the buckets answer to what the chunks emit.

    `emit(chunk, replies)` yields (bucket, message); `replies` are those of earlier
    exchanges by their name and bucket. `answer` gets the messages of one bucket and
    gives one reply each.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, replies in _rows(batches):
            got = list(emit(chunk, replies))
            if got:
                buckets, messages = zip(*got)
                arrays = [pa.array(buckets, pa.int32()), pa.array([number] * len(got), pa.int64()), pa.array(messages, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "chunk", "message"])

    def reply(table: pa.Table) -> pa.Table:
        out = answer(table.column("message").to_pylist())
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "reply": pa.array(out, pa.binary())})

    asked = chunks.mapInArrow(ask, "bucket int, chunk long, message binary")
    replied = asked.groupBy("bucket").applyInArrow(reply, "chunk long, bucket int, reply binary")
    replies = replied.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias(name))
    return chunks.join(cut(replies), "chunk", "left")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, Replies]]:
    for b in batches:
        names = [n for n in b.schema.names if n not in ("chunk", "blob")]
        for i in range(b.num_rows):
            replies = {n: {x["bucket"]: x["reply"] for x in b.column(n)[i].as_py() or []} for n in names}
            yield b.column("chunk")[i].as_py(), Chunk.load(b.column("blob")[i].as_py()), replies


def per_chunk(chunks: DataFrame, work: Callable[[Chunk, Replies], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows that `work` makes of each chunk, with its number, and its replies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, replies in _rows(batches):
            chunk.number = number
            for out in work(chunk, replies):
                if out.num_rows:
                    yield out

    return chunks.mapInArrow(run, schema)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def bits(flags: np.ndarray) -> bytes:
    return squeeze(np.packbits(flags).tobytes())


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(stretch(data), np.uint8), count=n).astype(bool)


def gathered(keys: np.ndarray, replies: dict, buckets: int, read: Callable[[bytes, int], np.ndarray], kind) -> np.ndarray:
    """Answers in the order of the sorted keys that were sent."""
    out = np.zeros(len(keys), kind)
    for b, part in spread(keys, buckets):
        out[part] = read(replies[b], part.stop - part.start)
    return out
