"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import cut, read, texts

#: Labelled rows the lexicon and its threshold are fitted on, about, at most.
TRAIN_ROWS = 20_000
#: Entries of the lexicon; training rows an entry must be found in; how often likelier in toxic ones.
ENTRIES, SUPPORT, LIFT = 1_000, 8, 12.0
#: Letters of other scripts that look like Latin ones (fixed values, by look).
HOMOGLYPHS = dict(zip("авдеѕиіјкӏмнорԛстухԝαβεικνορτυχωɑɡⅼ", "abdesuijklmhopqctyxwabeikvoptuxwagl", strict=True))
DIGITS = dict(zip("0134578@", "oieastba", strict=True))
#: Signs that look alike and count as one letter, in texts and in the lexicon.
ALIKE = str.maketrans("l1|", "iii")
_MONEY = re.compile(r"(?<!\$)\$++(?=[\w@])|(?<=[^\W_])\$++|(?<=@)\$++")
_BAR = re.compile(r"\|(?=[\w@$])|(?<=[\w@$])\|")
_WIDE = re.compile("[\u3000-\U0010ffff]+")


@cache
def _table() -> dict[int, str | None]:
    """Folding by character: look-alikes, digits, accents; all else but letters is a space.

    Characters from U+3000 on, as NFKC leaves them (`fold`), stay as they are.
    """
    table: dict[int, str | None] = {}
    for code in range(0x3000):
        c = chr(code)
        plain = unicodedata.normalize("NFKD", c)
        base = "".join(x for x in plain if not unicodedata.combining(x)).lower()
        base = "".join(HOMOGLYPHS.get(x, x) for x in base)
        base = "".join(DIGITS.get(x, x) for x in base).replace("l", "i")
        kept = "".join(x if x.isalnum() else " " for x in base)
        if unicodedata.combining(c) or code in (0x200B, 0x200C, 0x200D, 0xAD):
            table[code] = None
        elif kept != c:
            table[code] = kept if base else " "
    return table


def _plain(text: str | None) -> str:
    """Lower case, without compatibility characters from U+3000 on."""
    text = text or ""
    if not text.isascii():
        text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return text.lower()


def fold(text: str | None) -> str:
    """Words of a text, folded, with one space around and between all of them.

    Full-width, mathematical and other compatibility characters become plain ones; l, 1
    and a bar beside a word become i; dollars beside a word become s.
    """
    text = _plain(text)
    if "|" in text:
        text = _BAR.sub("i", text)
    if "$" in text:
        text = _MONEY.sub(lambda m: "s" * len(m[0]), text)
    return " " + " ".join(text.translate(_table()).split()) + " "


def readings(text: str | None) -> list[str]:
    """The folded text, and where a bar beside a word became a letter also with bars as separators."""
    out = [fold(text)]
    if "|" in (plain := _plain(text)) and (parted := fold(plain.replace("|", " "))) != out[0]:
        out.append(parted)
    return out


def features(folded: str) -> set[str]:
    """Candidates for the lexicon: words (" word ") and their beginnings (" wor")."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in (4, 5, 6) if len(w) > k)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each label that a feature is found in, added up as far as memory allows."""
    names = ["feature", "bad", "good"]
    seen: dict[str, list[int]] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names)

    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            for f in set().union(*map(features, readings(text))):
                seen.setdefault(f, [0, 0])[0 if toxic else 1] += 1
            if len(seen) > 200_000:
                yield out()
                seen.clear()
    yield out()


class Lexicon:
    """Weights of entries, phrases that excuse what they contain, and a threshold."""

    def __init__(self, weights: Mapping[str, float], exceptions: Sequence[str] = (), threshold: float = 1.0):
        self.weights, self.exceptions, self.threshold = dict(weights), list(exceptions), threshold
        self._machine = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "threshold": self.threshold, "_machine": None}

    @property
    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            # of entries that look alike the heaviest counts
            for entry, w in sorted(self.weights.items(), key=lambda x: (x[1], x[0])):
                self._machine.add_word(entry.translate(ALIKE), (entry, w))
            for phrase in self.exceptions:
                phrase = fold(phrase)
                if phrase.strip():
                    self._machine.add_word(phrase, (phrase, self.weights.get(phrase)))
            if self.weights or self.exceptions:
                self._machine.make_automaton()
        return self._machine

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(start, entry, weight) of the entries found, the longest at a place, none inside an exception."""
        if not (self.weights or self.exceptions):
            return []
        excused, found = [], {}
        excuses = {fold(x) for x in self.exceptions}
        for end, (entry, w) in self.machine.iter(folded):
            start = end - len(entry) + 1
            if entry in excuses:
                excused.append((start, end))
            elif start not in found or len(found[start][0]) < len(entry):
                found[start] = (entry, w)
        inside = lambda s, e: any(a <= s and e <= b for a, b in excused)
        return [(s, e, w) for s, (e, w) in found.items() if not inside(s, s + len(e) - 1)]

    def density(self, text: str | None) -> float:
        """Weight of the entries found, per word; the largest of the text's readings."""
        return max(map(self._density, readings(text)))

    def _density(self, folded: str) -> float:
        hits = self.hits(folded)
        return sum(w for _, _, w in hits) / max(1, folded.count(" ") - 1) if hits else 0.0

    def score(self, density: float) -> float:
        """0 without a hit, 0.5 at the threshold, towards 1 beyond."""
        return density / (density + self.threshold) if density > 0 else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of labelled rows that are not held out; about `bound` of them at most.

    A share of the labels is taken by a hash of their key, so a larger corpus gives
    as many. Rows of one id with two labels count as toxic if one of them is.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, bound / max(n, 1))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < int(share * 1_000_000))
    # the share bounds the keys, so they are broadcast and texts are not moved; the rows are read three times
    return cut(texts(docs).join(F.broadcast(known), "doc_id").select("text", "toxic"))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _findings(lexicon: Lexicon):
    """Per training row with a hit: the entries found, the phrases around each, and the number of words."""
    strings = pa.list_(pa.string())
    schema = pa.schema([("toxic", pa.int32()), ("words", pa.int64()), ("entries", strings), ("left", strings), ("right", strings)])

    def run(batches):
        for b in batches:
            out = []
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                folded = max(readings(text), key=lexicon._density)
                row = {"toxic": toxic, "words": folded.count(" ") - 1, "entries": [], "left": [], "right": []}
                for s, entry, _ in lexicon.hits(folded):
                    word = folded[s + 1 : folded.index(" ", s + 1)]
                    before, after = folded[:s].rsplit(" ", 1)[-1], folded[s + 1 + len(word) :].split(" ", 2)[1]
                    row["entries"].append(entry)
                    row["left"].append(f"{before} {word}" if before else "")
                    row["right"].append(f"{word} {after}" if after else "")
                if row["entries"]:
                    out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, entries: int = ENTRIES, support: int = SUPPORT, lift: float = LIFT) -> Lexicon:
    """Learn entries, weights, exceptions and threshold from the bounded training rows.

    Entries are words or word beginnings much more frequent among toxic rows, weighted
    by the logarithm of that ratio. Of entries that always come together those are
    kept that a toxic row needs: copies of one toxic text would otherwise make all
    their rare words entries. Two-word phrases around an entry that are found in
    clean rows alone become exceptions.
    """
    train = training_rows(docs, labels, bound)
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    if not bad:
        return Lexicon({})
    counted = train.mapInArrow(_count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = (F.col("bad") + 0.5) / (bad + 1) / ((F.col("good") + 0.5) / (good + 1))
    best = counted.filter(F.col("bad") >= max(2, min(support, bad // 20))).withColumn("ratio", ratio).filter(F.col("ratio") >= lift)
    # support orders them: a beginning comes before the words that it covers
    top = best.orderBy(F.desc("bad"), F.length("feature"), "feature").limit(entries * 4).collect()
    weights: dict[str, float] = {}
    for r in top:
        f = r["feature"]
        if not any(f.startswith(k) for k in (f[:n] for n in range(5, len(f))) if k in weights):
            weights[f] = math.log(r["ratio"])
    # at most `bound` training rows come back, those with a hit
    schema = "toxic int, words long, entries array<string>, left array<string>, right array<string>"
    rows = train.mapInArrow(_findings(Lexicon(weights)), schema).collect()
    near_bad, near_good = Counter(), Counter()
    for r in rows:
        (near_bad if r["toxic"] == 1 else near_good).update({*r["left"], *r["right"]} - {""})
    exceptions = sorted(p for p, n in near_good.items() if n >= 3 and p not in near_bad)[:entries]
    excused = set(exceptions)
    rows = [(r["toxic"] == 1, r["words"], [e for e, a, z in zip(r["entries"], r["left"], r["right"]) if a not in excused and z not in excused]) for r in rows]
    toxic = [set(found) for is_toxic, _, found in rows if is_toxic]
    kept: dict[str, float] = {}
    left = list(range(len(toxic)))
    while left and len(kept) < entries:
        gain = Counter(e for i in left for e in toxic[i])
        entry, n = max(gain.items(), key=lambda x: (x[1], -len(x[0]), x[0]), default=("", 0))
        if n < (3 if bad >= 200 else 2):
            break
        kept[entry] = weights[entry]
        left = [i for i in left if entry not in toxic[i]]
    # the density that parts the labels best, among those of the training rows
    found = sorted((sum(kept.get(e, 0.0) for e in entries_) / max(1, words), is_toxic) for is_toxic, words, entries_ in rows)
    found = [x for x in found if x[0] > 0]
    wrong = best_wrong = sum(not t for _, t in found)
    threshold = found[0][0] / 2 if found else 1.0
    for i, (d, t) in enumerate(found):
        wrong += 1 if t else -1
        if wrong < best_wrong:
            best_wrong = wrong
            threshold = (d + found[i + 1][0]) / 2 if i + 1 < len(found) else d * 2
    return Lexicon(kept, exceptions, threshold)


def _score(lexicon: Lexicon):
    def run(batches):
        for b in batches:
            scores = [lexicon.score(lexicon.density(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text: weight of lexicon entries per word, against a threshold.

    Null, empty and unmatched texts score 0; repeated rows and null ids are scored as
    any row; an empty table gives no rows.
    """
    scored = texts(docs, id_col, text_col).mapInArrow(_score(lexicon), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows, all columns kept whatever their names, whose score is below 0.5."""
    # by place, as names may hold dots
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [lexicon.score(lexicon.density(t)) < 0.5 for t in b.column(text).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a lexicon learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    lexicon = fit(docs, read(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, lexicon)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
