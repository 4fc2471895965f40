"""Token ids in Parquet: list columns of chosen encoding, bounded rows, row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.llm.common import read, ready, texts
from stagewise.llm.tokens import encoder, vocabulary
from stagewise.session import Workspace

END_ID = 2
#: Ids in one row at most; bytes of a row group and of a page; rows of a page.
PIECE, ROW_GROUP, PAGE, PAGE_ROWS = 1 << 15, 16 << 20, 128 << 10, 512
ENCODINGS = ("dictionary", "delta")
META = ("doc", "doc_id", "at", "piece", "n", "doc_tokens")
ROWS = "shard int, doc long, doc_id long, at long, piece long, n int, doc_tokens long, ids array<int>"


def _encoded(path: str, end_id: int, piece: int):
    """Rows of at most `piece` ids, in the order of the documents of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, e, doc, at = TaskContext.get().partitionId(), encoder(path), 0, 0
        end = np.array([end_id], e.type).tobytes()
        for b in batches:
            if not b.num_rows:
                continue
            got = [x + end for x in e.encode([t or "" for t in b.column("text").to_pylist()])]
            size = np.array([len(x) for x in got], np.int64) // e.type.itemsize
            ids = np.frombuffer(b"".join(got), e.type).astype(np.int32)
            parts = -(-size // piece)
            of = np.repeat(np.arange(len(got)), parts)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * piece
            n = np.minimum(size[of] - start, piece)
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32()))
            arrays = [pa.array(np.full(len(of), shard), pa.int32()), pa.array(doc + of), b.column("doc_id").take(pa.array(of)), pa.array(at + ends - n), pa.array(start), pa.array(n, pa.int32()), pa.array(size[of]), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["shard", *META, "ids"])
            doc, at = doc + len(got), at + int(size.sum())

    return run


def write_tokens(
    docs: DataFrame,
    to: str,
    path: str | None = None,
    end_id: int = END_ID,
    encoding: str = "dictionary",
    shards: int | None = None,
    piece: int = PIECE,
    row_group: int = ROW_GROUP,
    page: int = PAGE,
    page_rows: int = PAGE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of all texts to the folder `to`, in the order of their document ids.

    `to/tokens` holds a folder per shard, a range of documents. A row holds up to `piece`
    ids of one document, so a row group stays bounded whatever the texts are:

    doc (number in the shard), doc_id, at (ids of the shard before the row), piece (ids
    of the document before it), n, doc_tokens (ids of the document, end id included), ids.

    Ids are dictionary or delta encoded; the other columns, which rise, are delta encoded.
    Row groups and pages have statistics and page indexes, by which a reader skips what
    it does not ask for. `to/index` has a row per shard: its documents, its ids, and the
    ids of all shards before it. Whole texts are encoded, each followed by `end_id`.

    A null or empty text has the end id alone. Rows without a document id come last; equal
    document ids in the order of a hash of the text. An empty table gives no rows. `to`
    must not exist; texts move once, ids only into the files.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    n = shards or max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ready(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    rows = texts(docs, id_col, text_col).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = rows.mapInArrow(_encoded(path or vocabulary(), end_id, piece), ROWS)
    writer = rows.sortWithinPartitions("shard", "at").write.partitionBy("shard").option("compression", "zstd")
    # the second version of pages is the one with delta encodings
    options = {"parquet.writer.version": "v2", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in META}
    options["parquet.enable.dictionary#ids.list.element"] = str(encoding == "dictionary").lower()
    writer.options(**options).parquet(f"{to}/tokens")

    spark = docs.sparkSession
    each = _files(spark, to).groupBy("shard").agg(F.countDistinct("doc").alias("n_docs"), F.sum("n").alias("n_tokens"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
    # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    index = each.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    index.coalesce(1).write.parquet(f"{to}/index")


def _files(spark: SparkSession, to: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{to}/tokens")


def index_of(spark: SparkSession, to: str) -> DataFrame:
    """Per shard: n_docs, n_tokens, first_doc_id, last_doc_id, base (ids of all shards before)."""
    return spark.read.schema("shard int, n_docs long, n_tokens long, first_doc_id long, last_doc_id long, base long").parquet(f"{to}/index")


def token_rows(spark: SparkSession, to: str) -> DataFrame:
    """All rows of the files, with `start`, the ids of all rows before. The index, a row per shard, is broadcast."""
    bases = F.broadcast(index_of(spark, to).select("shard", "base"))
    return _files(spark, to).join(bases, "shard").withColumn("start", F.col("base") + F.col("at")).drop("base")


def document_table(spark: SparkSession, to: str) -> DataFrame:
    """doc_id, start and n_tokens of every document, from the metadata columns alone."""
    return token_rows(spark, to).filter("piece = 0").select("doc_id", "start", F.col("doc_tokens").alias("n_tokens"))


def tokens_of(spark: SparkSession, to: str, doc_ids: Sequence[int]) -> DataFrame:
    """Rows of a few documents; the ids reach the scan as a filter."""
    return token_rows(spark, to).filter(F.col("doc_id").isin(list(doc_ids)))


def tokens_between(spark: SparkSession, to: str, lo: int, hi: int, piece: int = PIECE) -> DataFrame:
    """(start, ids): the ids at places lo to hi of the whole corpus, in rows.

    Shards are chosen by the index, pages by the bounds of `at`; `piece` is that of writing.
    """
    ends = index_of(spark, to).filter((F.col("base") < hi) & (F.col("base") + F.col("n_tokens") > lo))
    ends = ends.agg(F.min(F.struct("shard", "base")).alias("a"), F.max(F.struct("shard", "base")).alias("z")).head()
    rows, shard, at = token_rows(spark, to), F.col("shard"), F.col("at")
    if ends["a"] is None:
        rows = rows.filter("false")
    else:
        # a scan each for the first shard, the last and those between, so that plain bounds reach the pages
        a, z = ends["a"]["shard"], ends["z"]["shard"]
        from_, to_ = at > lo - ends["a"]["base"] - piece, at < hi - ends["z"]["base"]
        if a == z:
            rows = rows.filter((shard == a) & from_ & to_)
        else:
            inner = rows.filter((shard > a) & (shard < z))
            rows = rows.filter((shard == a) & from_).unionByName(inner).unionByName(rows.filter((shard == z) & to_))
    first = F.greatest(F.lit(lo) - F.col("start"), F.lit(0))
    last = F.least(F.lit(hi) - F.col("start"), F.col("n").cast("long"))
    taken = rows.filter(last > first).select((F.col("start") + first).alias("start"), F.slice("ids", (first + 1).cast("int"), (last - first).cast("int")).alias("ids"))
    return taken.orderBy("start")


# --- checksums ----------------------------------------------------------------

_POLYNOMIAL, _ONE, _BYTE = 0xEDB88320, 1 << 31, 1 << 23


def _product(a: int, b: int) -> int:
    """Product of two polynomials over bits, modulo that of crc32; the highest bit is the constant term."""
    out = 0
    while a:
        if a & _ONE:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def crc_of_both(first: int, second: int, size: int) -> int:
    """crc32 of two byte strings, from that of each and the size of the second."""
    shift, power = _ONE, _BYTE
    while size:
        if size & 1:
            shift = _product(shift, power)
        power, size = _product(power, power), size >> 1
    return _product(shift, first) ^ second


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "doc", "doc_id", "start", "piece", "n"]
    for b in batches:
        ids = b.column("ids")
        at = ids.offsets.to_numpy()
        values = ids.values.to_numpy().astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(crc, pa.int64())], [*names, "crc"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for parts in b.column("parts").to_pylist():
            crc = parts[0]["crc"]
            for p in parts[1:]:
                crc = crc_of_both(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, to: str) -> DataFrame:
    """Per document of the files: start, n_tokens and the crc32 of its ids as little-endian unsigned 32-bit integers.

    Each row is summed where it is read; only sums move to put a document's rows together.
    """
    sums = token_rows(spark, to).select("shard", "doc", "doc_id", "start", "piece", "n", "ids")
    sums = sums.mapInArrow(_sums, "shard int, doc long, doc_id long, start long, piece long, n int, crc long")
    parts = F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("parts")
    whole = sums.groupBy("shard", "doc").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), parts)
    return whole.mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to files and read from them."""
    to = f"{Workspace(spark).root}/corpus"
    write_tokens(read(spark, sf_dir, "documents"), to)
    return digests(spark, to)
