"""Prefixes that conversations share: one node per distinct beginning, by ROLLUP over columns of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import WORD, column, cut, deal, read

#: Turns in one block of columns; blocks of a conversation whose running values one window takes.
WIDTH, SPAN = 4, 1024
#: Conversations that share a donor of first turns, and the bound of turns that are taken over.
DONOR_EVERY, GIVEN_BELOW = 20, 4
SLOTS = range(1, WIDTH + 1)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, inner, a, b, words): every turn with its place inside one stretch of its conversation.

    Turns come in the order of their number, null first, then of the MD5 of role and
    text; equal turns are interchangeable. Rows are cut into stretches by range, so a
    conversation of any length is numbered by many tasks. (a, b) are 128 bits that
    tell role and text apart; the texts themselves go no further. Null role or text
    is empty; rows without a conversation belong to none and are left out.
    """
    role, text = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = talks.select(column(conv_col).cast("long").alias("conv_id"), column(turn_col).alias("turn"), digest.alias("id"), words.alias("words"))
    rows = rows.filter("conv_id IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("id"), F.col("row")]
    n = max(12, int(talks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(rows.repartitionByRange(n, "conv_id", *order).withColumn("part", F.spark_partition_id()))
    inner = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return rows.select("conv_id", "part", inner.alias("inner"), F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"), "words")


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, base, own): rows before each stretch, and per conversation its length."""
    sizes = turns.groupBy("conv_id", "part").agg(F.count("*").alias("here"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"))
    return starts, sizes.groupBy("conv_id").agg(F.sum("here").alias("own"))


TURN = ["conv_id", "n", "q", "a", "b", "words"]


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place q, and the lengths n, of conversations as given."""
    starts, lengths = placed(turns)
    lengths = lengths.withColumnRenamed("own", "n")
    at = starts.join(lengths, "conv_id")
    return turns.join(at, ["conv_id", "part"]).withColumn("q", F.col("base") + F.col("inner")).select(*TURN), lengths


def with_given_starts(turns: DataFrame, every: int = DONOR_EVERY, below: int = GIVEN_BELOW) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations whose first turns come from another one.

    Conversation c takes the first h = crc32(c) % below turns of its donor c - c % every,
    all where there are fewer, and goes on with its own turns after its first h.
    """
    starts, lengths = placed(turns)
    lengths = lengths.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % below, "donor": F.col("conv_id") - F.col("conv_id") % every})
    donors = lengths.select(F.col("conv_id").alias("donor"), F.col("own").alias("donor_own"))
    plan = lengths.join(donors, "donor", "left").withColumn("given", F.least("h", F.coalesce("donor_own", F.lit(0))))
    plan = plan.withColumn("n", F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    at = starts.join(plan.select("conv_id", "h", "given", "n"), "conv_id")
    own = turns.join(at, ["conv_id", "part"]).withColumn("p", F.col("base") + F.col("inner")).filter("p > h")
    own = own.withColumn("q", F.col("p") - F.col("h") + F.col("given")).select(*TURN)
    # the first turns of donors: fewer than `below` each, for `every` conversations at most
    first = turns.filter(F.col("conv_id") % every == 0).join(starts, ["conv_id", "part"]).withColumn("q", F.col("base") + F.col("inner"))
    first = first.filter(F.col("q") < below).select(F.col("conv_id").alias("donor"), "q", "a", "b", "words")
    given = first.join(plan.select("donor", "conv_id", "n", "given"), "donor").filter("q <= given").select(*TURN)
    return own.unionByName(given), plan.select("conv_id", "n")


def _others(blocks: DataFrame, values: dict[str, str], total, add, after: bool) -> DataFrame:
    """Add per name the total of a column over all earlier, or later, blocks of the conversation.

    One window takes SPAN blocks; what the other spans hold travels as one row each.
    """
    spans = blocks.withColumn("span", F.expr(f"block div {SPAN}"))
    frame = (1, Window.unboundedFollowing) if after else (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(*frame)
    across = Window.partitionBy("conv_id").orderBy("span").rowsBetween(*frame)
    sums = spans.groupBy("conv_id", "span").agg(*[total(c).alias(f"_{o}") for o, c in values.items()])
    sums = sums.select("conv_id", "span", *[F.coalesce(total(f"_{o}").over(across), F.lit(0)).alias(f"_{o}") for o in values])
    rows = spans.withColumns({o: F.coalesce(total(c).over(inside), F.lit(0)) for o, c in values.items()})
    joined = rows.join(sums, ["conv_id", "span"])
    return joined.withColumns({o: add(F.col(o), F.col(f"_{o}")) for o in values}).select(*blocks.columns, *values)


def _mark(salt: int, place: Column, a: Column, b: Column) -> Column:
    """64 bits for a turn at a place; the exclusive or over a beginning is its key."""
    return F.xxhash64(F.lit(salt), place, a, b)


def in_blocks(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per conversation and WIDTH turns of it, written once.

    t1, t2, ... are the turns (a, b, words), null behind the last; (p1, p2) the key of
    the node that the block continues, (z1, z2) what its turns add to it; m the turns
    from here on, WIDTH + 1 for all that go on in the next block. A conversation without
    turns has one empty block.
    """
    rows = turns.withColumns({"block": F.expr(f"(q - 1) div {WIDTH}"), "slot": (F.col("q") - 1) % WIDTH + 1})
    rows = rows.withColumns({f"z{i}": _mark(i, F.col("q"), F.col("a"), F.col("b")) for i in (1, 2)})
    each = [F.max(F.when(F.col("slot") == j, F.col(c))).alias(f"{c}{j}") for j in SLOTS for c in ("a", "b", "words")]
    blocks = rows.groupBy("conv_id", "block").agg(F.max("n").alias("n"), F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), *each)
    turn = [F.when(F.col(f"a{j}").isNotNull(), F.struct(F.col(f"a{j}").alias("a"), F.col(f"b{j}").alias("b"), F.col(f"words{j}").alias("words"))).alias(f"t{j}") for j in SLOTS]
    blocks = blocks.select("conv_id", "block", "n", "z1", "z2", *turn)
    zero = F.lit(0).cast("long")
    silent = lengths.filter("n = 0").select("conv_id", zero.alias("block"), "n", zero.alias("z1"), zero.alias("z2"))
    blocks = blocks.unionByName(silent, allowMissingColumns=True)
    blocks = _others(blocks, {"p1": "z1", "p2": "z2"}, F.bit_xor, lambda x, y: x.bitwiseXOR(y), after=False)
    return cut(blocks.withColumn("m", F.least(F.col("n") - F.col("block") * WIDTH, F.lit(WIDTH + 1))))


def rolled_up(blocks: DataFrame, aggregates: str) -> DataFrame:
    """One row per node: all prefixes of all blocks in one ROLLUP, with keys and `last`, the node's turn.

    A prefix longer than its conversation, and the empty one of a later block, are no nodes.
    """
    names = ", ".join(f"t{j}" for j in SLOTS)
    rows = blocks.sparkSession.sql(
        f"SELECT block, p1, p2, {names}, CAST({WIDTH} - bit_count(grouping_id()) AS INT) AS level, {aggregates} "
        f"FROM {{blocks}} GROUP BY block, p1, p2, ROLLUP({names})",
        blocks=blocks,
    )
    level = F.col("level")
    last = F.coalesce(*[F.when(level == j, F.col(f"t{j}")) for j in SLOTS])
    rows = rows.withColumn("last", last).filter(F.col("last").isNotNull() | ((level == 0) & (F.col("block") == 0)))

    def key(i: int, up_to: Column) -> Column:
        k = F.col(f"p{i}")
        for j in SLOTS:
            place = F.col("block") * WIDTH + j
            k = k.bitwiseXOR(F.when(up_to >= j, _mark(i, place, F.col(f"t{j}.a"), F.col(f"t{j}.b"))).otherwise(F.lit(0)))
        return k

    # the root has no parent
    above = {f"up{i}": F.when((level > 0) | (F.col("block") > 0), key(i, level - 1)) for i in (1, 2)}
    return rows.withColumns({f"k{i}": key(i, level) for i in (1, 2)} | above | {"depth": F.col("block") * WIDTH + level})


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ends of nodes, a row per node and batch: its ids as text."""
    for b in batches:
        if not b.num_rows:
            continue
        k1, k2, ids = (b.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
        at = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        texts = [",".join(map(str, part.tolist())) for part in np.split(ids, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(ids[at]), pa.array(texts)], ["k1", "k2", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the stretches of each node, one after the other; only one stretch is held."""
    node, state = None, None

    def batch(done):
        arrays = [pa.array([k[0] for k, _ in done], pa.int64()), pa.array([k[1] for k, _ in done], pa.int64()), pa.array([s for _, s in done], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "ends_sha256"])

    for b in batches:
        done = []
        for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
            if (k1, k2) != node:
                if node:
                    done.append((node, state.hexdigest()))
                node, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield batch(done)
    if node:
        yield batch([(node, state.hexdigest())])


def ends_of(blocks: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes where a conversation ends.

    The text of a node's ids is made in stretches by many tasks; only the hash runs
    through them one by one, as it must.
    """
    n = max(12, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    last = blocks.filter(F.col("m").between(1, WIDTH) | (F.col("n") == 0))
    ends = last.select(F.col("p1").bitwiseXOR(F.col("z1")).alias("k1"), F.col("p2").bitwiseXOR(F.col("z2")).alias("k2"), "conv_id")
    ends = ends.repartitionByRange(n, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    stretches = ends.mapInArrow(_stretches, "k1 long, k2 long, first long, ids string")
    return deal(stretches, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashes, "k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the prefix tree of conversations, by the places of their turns.

    A node is a distinct sequence of first turns, called by the smallest conversation
    that starts with it and its depth; join on them to get its text. Blocks of WIDTH
    turns are columns of one row, and one ROLLUP aggregates all prefixes of all blocks;
    a block is keyed by the node before it, of which the turns alone decide the key, so
    conversations of any length take no further round.

    Values of whole subtrees are summed along conversations: a node counts for the
    smallest conversation that starts with it, later blocks for the earlier ones, and
    a second ROLLUP sums over all members.
    """
    blocks = in_blocks(turns, lengths)
    found = rolled_up(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id, max(m) AS deepest")
    # members all end here, or go on
    leaf = F.when(F.col("deepest") == F.col("level"), 1).otherwise(0)
    saved = (F.col("n_convs") - 1) * F.coalesce(F.col("last.words"), F.lit(0))
    found = cut(found.select("k1", "k2", "conv_id", "block", "level", leaf.alias("leaf"), saved.alias("saved")))

    here = F.struct("block", "level", "leaf", "saved", F.lit(0).alias("next"))
    # a conversation that is the smallest from the first turn of a block on is a new child of the block before
    before = F.struct((F.col("block") - 1).alias("block"), F.lit(None).cast("int").alias("level"), F.lit(0).alias("leaf"), F.lit(0).cast("long").alias("saved"), F.lit(1).alias("next"))
    both = F.when((F.col("level") == 1) & (F.col("block") > 0), F.array(here, before)).otherwise(F.array(here))
    first = found.select("conv_id", F.explode(both).alias("x")).select("conv_id", "x.*").groupBy("conv_id", "block")
    first = first.agg(F.min("level").alias("first"), F.max("leaf").alias("leaf"), F.max("next").alias("next"), *[F.sum(F.when(F.col("level") == j, F.col("saved"))).alias(f"s{j}") for j in SLOTS])
    held = blocks.join(first, ["conv_id", "block"], "left").na.fill(0, ["leaf", "next", *[f"s{j}" for j in SLOTS]])
    held = held.withColumn("all", sum((F.col(f"s{j}") for j in SLOTS), F.lit(0)))
    held = _others(held, {"leaf_later": "leaf", "saved_later": "all"}, F.sum, lambda x, y: x + y, after=True)

    children = [f"sum(CASE WHEN first <= {g + 1} AND m > {g} THEN 1 ELSE 0 END) AS c{g}" for g in range(WIDTH)] + [f"sum(next) AS c{WIDTH}"]
    sums = [f"sum({' + '.join(f's{i}' for i in range(max(g, 1), WIDTH + 1))} + saved_later) AS u{g}" for g in range(WIDTH + 1)]
    nodes = rolled_up(held, ", ".join(["count(*) AS n_convs", "min(conv_id) AS conv_id", "sum(leaf + leaf_later) AS n_leaves", *children, *sums]))

    def chosen(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("level") == g, F.col(f"{name}{g}")) for g in range(WIDTH + 1)])

    nodes = nodes.select("k1", "k2", "up1", "up2", "conv_id", "depth", "n_convs", chosen("c").alias("n_children"), "n_leaves", chosen("u").alias("saved_tokens"))
    parents = found.select(F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, ["up1", "up2"], "left").join(ends_of(blocks), ["k1", "k2"], "left").na.fill(NO_ENDS, ["ends_sha256"])
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *[F.col(c).cast("long").alias(c) for c in counts], "ends_sha256")


def conversation_trie(talks: DataFrame, every: int = 0, below: int = GIVEN_BELOW, **columns: str) -> DataFrame:
    """The prefix tree of all conversations: per node its members, children, leaves and saved words.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves (childless nodes in its subtree, itself included),
    saved_tokens (over its subtree, members but one times the words of the last turn)
    and ends_sha256 (over the ids of the conversations that end here). With `every`,
    first turns come from donors (`with_given_starts`).

    Turns of equal number come in the order of the MD5 of role and text; repeated rows
    are turns of their own. Null role or text is empty. Rows without a conversation
    are left out; a conversation without turns is a member of the root alone. An empty
    table has no node, not even a root. Turns are told apart by 128-bit hashes, and so
    are nodes. `columns` names the input's columns (`numbered`); others are not touched.
    """
    turns = numbered(talks, **columns)
    return trie(*(with_given_starts(turns, every, below) if every else as_they_are(turns)))


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix tree of the rebuilt conversations."""
    return conversation_trie(read(spark, sf_dir, "conversations"), every=DONOR_EVERY)
