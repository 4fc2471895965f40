"""Token counts, with long documents encoded in overlapping slices and spliced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import cut, deal, read, texts
from stagewise.llm.tokens import encoder, vocabulary

LIMIT = 1024
#: Characters of a slice, of the first overlap, and at a slice's end where its cuts are not trusted.
SLICE, OVERLAP, GUARD = 64_000, 1_000, 64


def _count_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            got = e.encode([t or "" for t in b.column("text").to_pylist()])
            n = np.array([len(x) for x in got], "int64") // e.type.itemsize
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _edges(path: str, text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Tokens of a slice; where its pre-tokens start, and the tokens before each start."""
    e = encoder(path).tokenizer.encode(text, add_special_tokens=False)
    words, offsets = e.word_ids, e.offsets
    at = [i for i in range(len(words)) if words[i] is not None and (i == 0 or words[i] != words[i - 1])]
    starts = np.array([offsets[i][0] for i in at], "int64")
    # a start counts only where pre-tokens really begin anew: offsets must rise
    keep = np.r_[True, starts[1:] > starts[:-1]] if len(starts) else np.zeros(0, bool)
    return len(words), starts[keep], np.array(at, "int64")[keep]


def _count_slices(path: str, step: int, overlap: int, guard: int):
    """Per slice its tokens, and its trusted cuts in the overlaps with its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, i, text in zip(b.column("key").to_pylist(), b.column("slice").to_pylist(), b.column("text").to_pylist()):
                n, starts, before = _edges(path, text)
                if len(starts):
                    # the last pre-token, and what a cut-off special string or suffix may touch, may change
                    sure = (starts < len(text) - guard) & (starts < starts[-1])
                else:
                    sure = np.zeros(0, bool)
                head, tail = sure & (starts < overlap) & (starts > 0), sure & (starts >= step)
                out.append(
                    {
                        "key": key, "slice": i, "n": n,
                        "head": (starts[head] + i * step).tolist(), "head_n": before[head].tolist(),
                        "tail": (starts[tail] + i * step).tolist(), "tail_n": before[tail].tolist(),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, SLICES)

    return run


_LONGS = pa.list_(pa.int64())
SLICES = pa.schema([("key", pa.int64()), ("slice", pa.int64()), ("n", pa.int64()), ("head", _LONGS), ("head_n", _LONGS), ("tail", _LONGS), ("tail_n", _LONGS)])


def splice(slices: DataFrame) -> DataFrame:
    """Tokens per key, null where two neighbours share no cut."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("slice")
    pairs = slices.select(
        "key", "n", "tail", "tail_n",
        F.lead("head").over(w).alias("next"), F.lead("head_n").over(w).alias("next_n"),
    )
    common = F.array_min(F.array_intersect("tail", "next"))
    place = lambda at, n: F.expr(f"element_at({n}, cast(array_position({at}, common) as int))")
    own = pairs.withColumn("common", common).select(
        "key",
        F.when(F.col("next").isNull(), F.col("n"))
        .when(F.col("common").isNotNull(), place("tail", "tail_n") - place("next", "next_n"))
        .alias("n"),
    )
    bad = F.max(F.col("n").isNull())
    return own.groupBy("key").agg(F.when(~bad, F.sum("n")).alias("n_tokens"))


def count_long(docs: DataFrame, path: str, step: int, overlap: int, guard: int) -> DataFrame:
    """Tokens of long texts (key, text): slices are spread over tasks and spliced.

    Slice i holds the characters from i * step, `overlap` more than a step. Both
    neighbours encode the overlap. A pre-token start that both see there is a proven
    cut: from a start on, the split depends only on the text behind it. Documents
    without a common start go into another round with twice the overlap, until a
    slice holds the whole text.
    """
    done, todo, schema = [], docs, "key long, slice long, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>"
    while True:
        size = F.char_length("text")
        last = F.greatest(F.lit(0), F.ceil((size - overlap) / F.lit(step)) - 1)
        cuts = todo.select("key", "text", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("slice"))
        cuts = cuts.select("key", "slice", F.expr(f"substring(text, cast(slice * {step} + 1 as int), {step + overlap})").alias("text"))
        spread = deal(cuts, "key", "slice")
        counted = cut(splice(spread.mapInArrow(_count_slices(path, step, overlap, guard), schema)))
        done.append(counted.filter(F.col("n_tokens").isNotNull()))
        failed = counted.filter(F.col("n_tokens").isNull())
        if failed.isEmpty():
            break
        todo, overlap = todo.join(failed.select("key"), "key", "left_semi"), overlap * 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def count_tokens(
    docs: DataFrame,
    path: str | None = None,
    limit: int = LIMIT,
    step: int = SLICE,
    overlap: int = OVERLAP,
    guard: int = GUARD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Bytes and tokens of every whole text, as the vocabulary's library counts them.

    Texts longer than a slice and its overlap are cut into slices that are encoded
    apart and spliced (`count_long`). Null and empty texts have no tokens; every input
    row, repeated ones and those with a null id included, gives one row; an empty
    table gives no rows.
    """
    path = path or vocabulary()
    rows = texts(docs, id_col, text_col).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    # bytes bound characters: what is short in bytes needs no count of characters
    is_long = (F.col("n_bytes") > step) & (F.char_length("text") > step + overlap)
    schema = "doc_id long, n_bytes long, n_tokens long"
    short = rows.filter(~F.coalesce(is_long, F.lit(False))).mapInArrow(_count_whole(path), schema)
    long = cut(rows.filter(is_long).withColumn("key", F.monotonically_increasing_id()))
    counted = count_long(long.select("key", "text"), path, step, overlap, guard)
    long = long.join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents."""
    return count_tokens(read(spark, sf_dir, "documents"))
