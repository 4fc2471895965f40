"""Collocations: frequent phrases by mergeable Misra-Gries summaries, counted exactly, scored at their weakest cut."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm import exchange as X
from stagewise.llm.common import column, cut, deal, read, texts
from stagewise.llm.words import mix, prefix_hash, rolling, slices_hash

#: Words of a phrase at most, occurrences at least, phrases reported per language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Capacity of a summary, in multiples of its mass divided by the threshold.
SLACK = 4
#: A longer phrase takes over a part of it that occurs so often with it, in percent.
COVERED = 100
NO_LANG = "und"

_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Of each byte: 0 in a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
#: Bytes that array work is done on at a time.
SLAB = 1 << 20


def _parts(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in parts of about `limit` bytes, cut behind a break, where phrases end anyway."""
    lo = 0
    while len(text) - lo > limit:
        found = _BREAK.search(text, lo + limit)
        if not found:
            break
        yield text[lo : found.end()]
        lo = found.end()
    yield text[lo:]


def _gather(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, langs, data, size = TaskContext.get().partitionId() << 20, [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([X.Chunk(langs, data).dump()], pa.binary())], ["chunk", "blob"])

        for b in batches:
            for lang, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary())):
                for part in _parts(t.as_py() or b"", limit):
                    langs.append(lang)
                    data.append(part)
                    size += len(part) + 1
                    if size >= limit:
                        yield out()
                        number, langs, data, size = number + 1, [], [], 0
        if langs:
            yield out()

    return run


def _joined(chunk: X.Chunk) -> tuple[bytes, np.ndarray]:
    """All texts of a chunk, a break behind each, and where they start."""
    sizes = np.array([len(t) + 1 for t in chunk.texts], np.int64)
    return b"\n".join(chunk.texts) + b"\n", np.cumsum(sizes) - sizes


class Tokens:
    """Words of a chunk: places, hashes and piece of each."""

    def __init__(self, chunk: X.Chunk):
        data, base = _joined(chunk)
        found, pieces, lo = [], 0, 0
        while lo < len(data):
            # the data end with a break
            hi = _BREAK.search(data, min(lo + SLAB, len(data) - 1)).end()
            buf = _LOWER[np.frombuffer(data, np.uint8, count=hi - lo, offset=lo)]
            kind = _CLASS[buf]
            word = np.r_[False, kind == 0]
            edge = np.flatnonzero(word[1:] != word[:-1])
            start, end = edge[0::2], edge[1::2]
            breaks = np.cumsum(kind == 2)
            found.append((start + lo, slices_hash(prefix_hash(buf), start, end), breaks[start] + pieces))
            pieces, lo = pieces + int(breaks[-1]), hi
        self.start, self.hash, self.piece = (np.concatenate(x) for x in zip(*found))
        self.salt = mix(chunk.ids[np.searchsorted(base, self.start, "right") - 1].view(np.uint64))

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit keys of phrase and language at every word, and whether k words follow in its piece."""
        h, ok = rolling(self.hash, self.piece, k)
        return mix(h ^ self.salt), ok


def _short_keys(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and pairs of a chunk, sorted, and their counts."""
    found = [h[ok] for h, ok in (t.keys(k) for k in (1, 2))]
    return np.unique(np.concatenate(found), return_counts=True)


def _alive(t: Tokens, keys: np.ndarray, flags: np.ndarray, k: int) -> np.ndarray:
    """Places where a phrase of k words starts that is among the flagged ones of these sorted keys."""
    h, ok = t.keys(k)
    out, at = np.zeros(len(h), bool), np.flatnonzero(ok)
    if len(keys):
        out[at] = flags[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)]
    return out


def _long_keys(t: Tokens, pairs: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of three words or more whose pairs all survive, sorted, and their counts."""
    found = [np.zeros(0, np.uint64)]
    for k in range(3, longest + 1):
        found.append(t.keys(k)[0][_with_pairs(pairs, k)])
    return np.unique(np.concatenate(found), return_counts=True)


def _with_pairs(pairs: np.ndarray, k: int) -> np.ndarray:
    """Places from which k words go on by surviving pairs; these never cross a piece."""
    n = max(len(pairs) - k + 2, 0)
    out = np.zeros(len(pairs), bool)
    out[:n] = np.logical_and.reduce([pairs[j : j + n] for j in range(k - 1)])
    return out


def _messages(keys: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    for b, part in X.spread(keys, buckets):
        codes = X.pack_sorted(X.short(keys[part], b, buckets))
        yield b, pickle.dumps((codes, X.squeeze(np.minimum(n[part], 0xFFFFFFFF).astype(np.uint32).tobytes())))


def merged(summaries: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries summaries as one: keys, counters and what every counter has lost at most.

    Counters of equal keys are added; if more than `capacity` are left, the largest of
    those too many is taken from each. This takes capacity + 1 times as much from the
    mass, so all losses together are below mass / capacity.
    """
    keys, n, lost = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for i, one in enumerate(summaries):
        held.append(one)
        if sum(len(k) for k, _ in held) < capacity and i + 1 < len(summaries):
            continue
        every, where = np.unique(np.concatenate([keys, *[k for k, _ in held]]), return_inverse=True)
        total = np.bincount(where, np.concatenate([n, *[m for _, m in held]]), len(every)).astype(np.int64)
        if len(every) > capacity:
            excess = int(np.partition(total, len(total) - capacity - 1)[len(total) - capacity - 1])
            every, total, lost = every[total > excess], total[total > excess] - excess, lost + excess
        keys, n, held = every, total, []
    return keys, n, lost


def _survivors(least: int, slack: int):
    """Replies: which keys of a message may have `least` occurrences in all messages of the bucket."""

    def answer(messages: list[bytes]) -> list[bytes]:
        loaded = []
        for m in messages:
            codes, n = pickle.loads(m)
            loaded.append((X.unpack_sorted(codes, "uint32"), np.frombuffer(X.stretch(n), np.uint32).astype(np.int64)))
        capacity = slack * sum(int(n.sum()) for _, n in loaded) // least + 1
        keys, n, lost = merged(loaded, capacity)
        frequent = keys[n + lost >= least]
        return [X.bits(X.member(codes, frequent)) for codes, _ in loaded]

    return answer


def _ask_exact(buckets: int, longest: int):
    """Messages: key, count, place and words of every surviving phrase of a chunk, by keys."""

    def emit(chunk: X.Chunk, replies: X.Replies) -> Iterator[tuple[int, bytes]]:
        t = Tokens(chunk)
        keys, _ = _short_keys(t)
        flags = X.gathered(keys, replies["short"], buckets, X.unbits, bool)
        alive = {k: _alive(t, keys, flags, k) for k in (1, 2)}
        keys, _ = _long_keys(t, alive[2], longest)
        flags = X.gathered(keys, replies["long"], buckets, X.unbits, bool)
        for k in range(3, longest + 1):
            alive[k] = _with_pairs(alive[2], k) & _alive(t, keys, flags, k)
        found = []
        for k, at in alive.items():
            places = np.flatnonzero(at)
            every, first, n = np.unique(t.keys(k)[0][places], return_index=True, return_counts=True)
            found.append((every, n, t.start[places[first]], np.full(len(every), k)))
        keys, n, place, size = (np.concatenate(x) for x in zip(*found))
        by = np.argsort(keys)
        keys, n, place, size = keys[by], n[by].astype(np.uint32), place[by], size[by].astype(np.uint8)
        for b, part in X.spread(keys, buckets):
            yield b, pickle.dumps((X.pack_sorted(keys[part]), *(X.squeeze(x[part].tobytes()) for x in (n, place, size))))

    return emit


def _counted(least: int):
    """Phrases of a bucket with `least` occurrences, each with a chunk that has it and its place there."""

    def answer(table: pa.Table) -> pa.Table:
        loaded = []
        for number, m in zip(table.column("chunk").to_pylist(), table.column("message").to_pylist()):
            keys, *rest = pickle.loads(m)
            keys = X.unpack_sorted(keys, "uint64")
            n, place, size = (np.frombuffer(X.stretch(x), kind) for x, kind in zip(rest, (np.uint32, np.int64, np.uint8)))
            loaded.append((keys, n, place, size, np.full(len(keys), number)))
        keys, n, place, size, chunk = (np.concatenate(x) for x in zip(*loaded))
        every, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, n, len(every)).astype(np.int64)
        # of the chunks that have a phrase any may tell its text: chosen by hash, so that none has to tell most
        held = np.flatnonzero(total[where] >= least)
        held = held[np.lexsort((mix(keys[held] ^ mix(chunk[held].view(np.uint64))), where[held]))]
        held = held[np.r_[True, where[held][1:] != where[held][:-1]]] if len(held) else held
        return pa.table({"chunk": chunk[held], "place": place[held], "size": size[held].astype(np.int32), "n": total[where[held]]})

    return answer


def _ask(emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, replies in X._rows(batches):
            if got := list(emit(chunk, replies)):
                buckets, messages = zip(*got)
                arrays = [pa.array(buckets, pa.int32()), pa.array([number] * len(got), pa.int64()), pa.array(messages, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "chunk", "message"])

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the phrases that a chunk is asked for, and per language its words as the phrase ''."""
    for b in batches:
        for i in range(b.num_rows):
            chunk = X.Chunk.load(b.column("blob")[i].as_py())
            data, base = _joined(chunk)
            buf = np.frombuffer(data, np.uint8)
            starts = np.r_[True, _CLASS[buf[:-1]] != 0] & (_CLASS[buf] == 0)
            words = np.add.reduceat(starts, base, dtype=np.int64)
            langs, of = np.unique(chunk.ids, return_inverse=True)
            rows = [(lang, "", n) for lang, n in zip(langs.tolist(), np.bincount(of, words).astype(np.int64).tolist())]
            asked = b.column("asked")[i].as_py() or []
            text_of = np.searchsorted(base, [x["place"] for x in asked], "right") - 1
            for x, lang in zip(asked, chunk.ids[text_of].tolist()):
                found = _phrase(x["size"]).match(data, x["place"]).group()
                rows.append((lang, b" ".join(found.split()).lower().decode(), x["n"]))
            arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["lang_key", "phrase", "n"])


@cache
def _phrase(size: int) -> re.Pattern[bytes]:
    """As many words of one piece."""
    word = rb"[^\x20\x09-\x0D.,;:!?]+"
    return re.compile(word + rb"(?:[\x20\x09]+" + word + rb"){%d}" % (size - 1))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, slack: int = SLACK, lang_col: str = "lang", text_col: str = "text", chunk: int = X.CHUNK) -> DataFrame:
    """(lang_key, phrase, n): all phrases of up to `longest` words with `least` occurrences, counted exactly.

    First pass: every chunk of texts sends the summary of its words and pairs to the
    hash partitions of the keys; these merge them with a capacity of `slack` times mass /
    `least`, so that what has `least` occurrences always survives, and tell the chunks
    what did. Longer phrases whose pairs all survive go the same way. Second pass: the
    survivors are counted exactly, again packed by partition of the keys, and one chunk
    tells the text of each that is frequent. The empty phrase has the number of all words.

    `lang_key` is the xxhash64 of the language, null being `und`.
    """
    lang = F.xxhash64(F.coalesce(column(lang_col).cast("string"), F.lit(NO_LANG)))
    rows = docs.select(lang.alias("lang_key"), column(text_col).alias("text"))
    chunks = cut(deal(texts(rows, "lang_key", "text").mapInArrow(_gather(chunk), "chunk long, blob binary"), "chunk"))
    buckets = X.bucket_count(chunks)

    def ask_short(c: X.Chunk, _):
        yield from _messages(*_short_keys(Tokens(c)), buckets)

    def ask_long(c: X.Chunk, replies: X.Replies):
        t = Tokens(c)
        keys, _ = _short_keys(t)
        pairs = _alive(t, keys, X.gathered(keys, replies["short"], buckets, X.unbits, bool), 2)
        yield from _messages(*_long_keys(t, pairs, longest), buckets)

    asking = X.exchange(X.exchange(chunks, "short", ask_short, _survivors(least, slack)), "long", ask_long, _survivors(least, slack))
    asked = asking.mapInArrow(_ask(_ask_exact(buckets, longest)), "bucket int, chunk long, message binary")
    found = asked.groupBy("bucket").applyInArrow(_counted(least), "chunk long, place long, size int, n long")
    found = cut(found.groupBy("chunk").agg(F.collect_list(F.struct("place", "size", "n")).alias("asked")))
    counted = chunks.join(found, "chunk", "left").mapInArrow(_told, "lang_key long, phrase string, n long")
    return counted.groupBy("lang_key", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("phrase") == ""))


def _words(first: str, size: str) -> str:
    return f"array_join(slice(w, {first}, {size}), ' ')"


def scored(counts: DataFrame, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """Candidates of `counts` with their score at the weakest cut, less those that a longer one covers.

    The score of a cut is floor(1000 a n / (l r)), in decimals of 38 digits, exact for
    counts below 10^17; ties go to the first cut.
    """
    phrases = counts.filter("phrase <> ''")
    rows = phrases.filter(F.col("n") >= least).withColumn("w", F.split("phrase", " ")).withColumn("size", F.size("w"))
    rows = rows.filter("size >= 2").withColumnRenamed("n", "a")
    inner = rows.filter("size >= 3").select("lang_key", "a", "w", "size", F.expr("explode(sequence(2, size - 1)) AS k"))
    inner = inner.select("lang_key", "a", "w", "k", F.expr("explode(sequence(1, size - k + 1)) AS s"))
    cover = inner.groupBy("lang_key", F.expr(_words("s", "k")).alias("phrase")).agg(F.max("a").alias("longer"))
    rows = rows.join(cover, ["lang_key", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {covered} * a").drop("longer")

    cuts = rows.select("lang_key", "phrase", "a", "w", "size", F.expr("explode(sequence(1, size - 1)) AS k"))
    cuts = cuts.select("lang_key", "phrase", "a", "k", F.expr(_words("1", "k")).alias("first"), F.expr(_words("k + 1", "size - k")).alias("rest"))
    for name, out in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(phrases.select("lang_key", F.col("phrase").alias(name), F.col("n").alias(out)), ["lang_key", name])
    words = counts.filter("phrase = ''").select("lang_key", F.col("n").alias("words"))
    number = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r", "words")}
    cuts = cuts.join(words, "lang_key").withColumn("top", F.lit(1000).cast("decimal(4,0)") * number["a"] * number["words"])
    cuts = cuts.withColumn("below", number["l"] * number["r"]).withColumn("score", F.expr("top div below"))
    weakest = cuts.groupBy("lang_key", "phrase", "a", "words").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return weakest.select("lang_key", "phrase", "a", "x.l", "x.r", F.col("words").alias("n"), "x.score")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    slack: int = SLACK,
    covered: int = COVERED,
    lang_col: str = "lang",
    text_col: str = "text",
    chunk: int = X.CHUNK,
) -> DataFrame:
    """Per language the first `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Words are of A-Z in lower case, split at spaces and tabs, in pieces between
    punctuation or line ends; a phrase is 2 to `longest` words of one piece with `a`
    occurrences, `least` at the fewest, overlapping ones included. Its parts at the
    weakest cut have l and r, all words of the language are n. A phrase inside a longer
    one with `covered` percent of its occurrences is left out. Equal scores are ordered
    by `a`, then by the bytes of the phrase.

    A null language is `und`; null and empty texts have no words; repeated rows count as
    often as they are there; an empty table, or one without frequent phrases, gives no
    rows. Phrases are told apart by 64-bit hashes of text and language.
    """
    counts = cut(frequent_phrases(docs, least, longest, slack, lang_col, text_col, chunk))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = scored(counts, least, covered).withColumn("rank", F.row_number().over(Window.partitionBy("lang_key").orderBy(*order)))
    langs = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang")).distinct()
    named = ranked.filter(F.col("rank") <= top).join(langs.withColumn("lang_key", F.xxhash64("lang")), "lang_key")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The strongest phrases of each language over all documents."""
    return collocations(read(spark, sf_dir, "documents"))
