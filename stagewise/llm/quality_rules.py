"""Quality verdicts by a learned decision list over text statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import SPACE, cut, read, texts
from stagewise.llm.toxicity import held_out

FEATURES = ["n_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks", "distinct"]
#: Thresholds tried per feature, conditions of a rule, rules, rows a rule must cover, its least precision on rows kept for pruning.
STEPS, CONDITIONS, RULES, COVER, PRECISION = 24, 3, 12, 8, 0.8
#: Repeated windows up to which they are looked up one by one.
FEW = 24


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base statistics and the features of every whole text."""
    rows = texts(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines).withColumn("n", F.size("words"))
    # hashes of all windows of three words; those found twice follow each other when sorted
    grams = F.expr("transform(slice(words, 1, greatest(n - 2, 0)), (w, i) -> xxhash64(w, words[i + 1], words[i + 2]))")
    rows = rows.withColumn("grams", grams).withColumn("ordered", F.sort_array("grams"))
    rows = rows.withColumn("twice", F.expr("array_distinct(filter(ordered, (g, i) -> i > 0 AND g = ordered[i - 1]))"))
    one_by_one = "filter(sequence(0, n - 3), i -> array_contains(twice, grams[i]))"
    pairs = "sort_array(transform(grams, (g, i) -> struct(g AS g, i AS i)))"
    rows = rows.withColumn("pairs", F.expr(f"CASE WHEN size(twice) > {FEW} THEN {pairs} END"))
    by_order = "array_sort(transform(filter(pairs, (x, k) -> (k > 0 AND x.g = pairs[k - 1].g) OR (k < size(pairs) - 1 AND x.g = pairs[k + 1].g)), x -> x.i))"
    places = f"CASE WHEN size(twice) = 0 THEN array() WHEN size(twice) <= {FEW} THEN {one_by_one} ELSE {by_order} END"
    rows = rows.withColumn("places", F.expr(f"cast({places} as array<int>)"))
    covered = "aggregate(transform(places, (p, k) -> CASE WHEN k = 0 THEN 3 ELSE least(3, p - places[k - 1]) END), 0L, (a, x) -> a + x)"
    rows = rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[!?]")).alias("n_marks"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )
    words = F.greatest("n_words", F.lit(1))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.struct(
            F.col("n_words").cast("double").alias("n_words"),
            (F.col("word_chars") / words).alias("word_length"),
            (F.col("n_symbols") / words).alias("symbols"),
            (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_lines"),
            (F.col("n_repeat_words") / words).alias("repeats"),
            (F.col("n_capitals") / F.greatest("word_chars", F.lit(1))).alias("capitals"),
            (F.col("n_marks") / words).alias("marks"),
            (F.col("n_distinct") / words).alias("distinct"),
        ).alias("f"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, features: str = "f") -> Column:
        x = F.col(features)[self.feature]
        return x >= self.threshold if self.above else x < self.threshold


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions are dropped."""

    conditions: tuple[Condition, ...]

    def column(self, features: str = "f") -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(features)
        return out


def verdict(rules: list[Rule], features: str = "f") -> Column:
    """The decision list as one ordered conditional: false at the first rule that holds, else true."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(features), F.lit(False))
    return out.otherwise(F.lit(True))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained about the dropped class, times the rows of it still covered."""
    return p * (math.log2((p + 0.5) / (p + n + 1)) - math.log2((p0 + 0.5) / (p0 + n0 + 1))) if p else 0.0


def _best(counts: list, steps: dict[str, list[float]], p0: int, n0: int, cover: int) -> tuple[float, Condition | None]:
    """The condition of most gain, from the counts per feature and bin."""
    best: tuple[float, Condition | None] = (0.0, None)
    for i, feature in enumerate(FEATURES):
        bins = {r["bin"]: (r["bad"], r["good"]) for r in counts if r["feature"] == i}
        below = [0, 0]
        for k, t in enumerate(steps[feature]):
            below = [below[j] + bins.get(k, (0, 0))[j] for j in (0, 1)]
            for above, p, n in ((False, *below), (True, p0 - below[0], n0 - below[1])):
                if p >= cover and (g := _gain(p, n, p0, n0)) > best[0] + 1e-9:
                    best = (g, Condition(feature, above, t))
    return best


def learn(
    rows: DataFrame, steps: int = STEPS, conditions: int = CONDITIONS, rules: int = RULES, cover: int = COVER, precision: float = PRECISION
) -> list[Rule]:
    """Sequential covering over (f, bad, pruning): all counts are Spark aggregates.

    Each rule is grown by the condition of most information gain until it covers no good
    row of the growing rows, then cut to the prefix that does best on the pruning rows.
    It is kept if it is precise enough there; the rows that it covers leave, and the next
    is grown. Only counts per feature and bin reach the driver, whatever the rows.
    """
    shares = [(i + 0.5) / steps for i in range(steps)]
    quantiles = rows.agg(*[F.percentile_approx(F.col("f")[x], shares, 2000).alias(x) for x in FEATURES]).first()
    cuts = {x: sorted(set(quantiles[x] or [])) for x in FEATURES}
    # a value's bin is the number of thresholds that it reaches
    bins = [F.struct(F.lit(i).alias("feature"), sum([(F.col("f")[x] >= t).cast("int") for t in cuts[x]], F.lit(0)).alias("bin")) for i, x in enumerate(FEATURES)]
    rows = cut(rows.withColumn("bins", F.array(*bins)))
    found: list[Rule] = []
    while len(found) < rules:
        rest = rows
        for r in found:
            rest = rest.filter(~r.column())
        rule: tuple[Condition, ...] = ()
        while len(rule) < conditions:
            covered = rest.filter(~F.col("pruning")).filter(Rule(rule).column())
            parts = covered.select("bad", F.explode("bins").alias("b")).groupBy("b.feature", "b.bin")
            counts = parts.agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
            p0, n0 = (sum(r[c] for r in counts if r["feature"] == 0) for c in ("bad", "good"))
            if p0 < cover or n0 == 0:
                break
            _, best = _best(counts, cuts, p0, n0, cover)
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        prefixes = [Rule(rule[: k + 1]) for k in range(len(rule))]
        hits = [(f"{name}{k}", F.sum(F.when(r.column(), value).otherwise(0))) for k, r in enumerate(prefixes) for name, value in (("bad", F.col("bad")), ("good", 1 - F.col("bad")))]
        held = rest.filter("pruning").agg(*[column.alias(name) for name, column in hits]).first()
        scores = []
        for k, r in enumerate(prefixes):
            p, n = held[f"bad{k}"] or 0, held[f"good{k}"] or 0
            scores.append(((p - n) / (p + n + 1), p, n, r))
        _, p, n, kept = max(scores, key=lambda s: s[0])
        if p == 0 or p / (p + n) < precision:
            break
        found.append(kept)
    return found


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of all labelled rows that are not held out; a third of them for pruning."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("bad"))
    rows = stats.filter(~F.col("base_failed")).join(known, "doc_id")
    return rows.select("f", "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning"))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics and verdict: kept if the base rules and all learned rules let a document pass."""
    kept = ~F.col("base_failed") & verdict(rules)
    return stats.withColumn("kept", kept).drop("f")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every whole text and the verdict of a decision list learned from labels.

    Null and empty texts have no words and fail the base rules, as all texts of fewer
    than 50 words do. Repeated rows and null ids are judged as any row, an empty table
    gives no rows. Without labelled rows there are no learned rules. Windows of three
    words are told apart by 64-bit hashes within a text.
    """
    stats = cut(statistics(docs, id_col, text_col))
    return judge(stats, learn(training_rows(stats, labels)))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
