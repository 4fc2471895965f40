"""Rules as rows: labels by page and time, and labels by a table of decisions.

Both look up distinct values, not rows: a page, or a combination of facts, meets the
rules once, however many rows have it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.functions import vocab
from stagewise.operators.skew import join_same

#: Columns of a table of page rules. `test` is how the page meets `text`: "contains",
#: "endswith", "startswith" or "equals". The rule holds after `starts`, from the first moment of
#: that day on with `whole_day`, and before `ends`; NULL is no bound.
PAGE_RULES = "priority int, test string, text string, starts timestamp, ends timestamp, whole_day boolean, label string"


def decision_table(spark: SparkSession, facts: Sequence[str], decisions: Sequence[tuple]) -> DataFrame:
    """Decisions (fact values..., label) as rows, the first one with priority 0."""
    schema = ", ".join(["priority int", *[f"{f} string" for f in facts], "label string"])
    return spark.createDataFrame([(n, *row) for n, row in enumerate(decisions)], schema)


def launch_table(spark: SparkSession, site: str, label: str = "1", launches: Sequence[tuple] = vocab.LAUNCHES) -> DataFrame:
    """The fixed launch times as rows of page rules."""
    rows = [
        (n, test, text.format(site=site), launched, by_day, label)
        for n, (test, texts, launched, by_day) in enumerate(launches)
        for text in texts
    ]
    table = spark.createDataFrame(rows, "priority int, test string, text string, starts string, whole_day boolean, label string")
    bounds = {"starts": F.col("starts").cast("timestamp"), "ends": F.lit(None).cast("timestamp")}
    return table.withColumns(bounds).select("priority", "test", "text", "starts", "ends", "whole_day", "label")


def _pieces(page: Column, sizes: Column) -> Column:
    """Every part of a page that a rule's text may equal: (test, text), for text lengths in `sizes`."""

    def part(test: str, text: Column) -> Column:
        return F.struct(F.lit(test).alias("test"), text.alias("text"))

    def of(test: str, text_of) -> Column:
        wanted = F.filter(sizes, lambda s: (s["test"] == test) & (s["size"] <= F.length(page)))
        return F.transform(wanted, lambda s: part(test, text_of(s["size"])))

    wanted = F.filter(sizes, lambda s: (s["test"] == "contains") & (s["size"] <= F.length(page)))
    inside = F.flatten(
        F.transform(
            wanted,
            lambda s: F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(page) - s["size"] + 1)),
                lambda i: part("contains", F.substring(page, i, s["size"])),
            ),
        )
    )
    end = of("endswith", lambda n: F.substring(page, F.length(page) - n + 1, n))
    start = of("startswith", lambda n: F.substring(page, F.lit(1), n))
    whole = of("equals", lambda n: page)
    return F.concat(inside, end, start, whole)


def pages_with_rules(pages: DataFrame, page: str, rules: DataFrame) -> DataFrame:
    """Each different page with the rules whose text it meets, as one array `rules` in order of priority.

    A page is cut into its parts of those lengths that rule texts have, and parts meet texts
    by equality: a join of any size, that Spark broadcasts only where the measured rules are
    small. Parts of a page are as many as its length times the different lengths. A rule without
    text meets no page, an empty text every page; a NULL page meets no rule.
    """
    known = rules.where("text IS NOT NULL AND test IS NOT NULL").dropDuplicates()
    sizes = known.agg(F.collect_set(F.struct("test", F.length("text").alias("size"))).alias("_sizes"))
    names = ["priority", "starts", "ends", "whole_day", "label"]
    distinct = pages.select(F.col(page).alias("_page")).where("_page IS NOT NULL").distinct()
    # one row of lengths: at most four tests times the lengths of texts
    cut = distinct.join(F.broadcast(sizes)).select("_page", F.explode(_pieces(F.col("_page"), F.col("_sizes"))).alias("_p"))
    parts = cut.select("_page", F.col("_p.test").alias("_test"), F.col("_p.text").alias("_text"))
    met = parts.join(known, (F.col("_test") == F.col("test")) & (F.col("_text") == F.col("text")))
    return met.groupBy("_page").agg(F.array_sort(F.collect_set(F.struct(*names))).alias("rules"))


def with_rule_label(df: DataFrame, page: str, ts: str, rules: DataFrame, default: str | None = None, out: str = "label") -> DataFrame:
    """The label of the page rule that holds, the smallest priority first; ``default`` where none does.

    ``rules`` has the columns of PAGE_RULES. Among equal priorities the earliest start, then
    end, then the smallest label wins. A NULL page or time has no rule with a bound.
    """
    at = F.col(ts).cast("timestamp")

    def holds(rule: Column) -> Column:
        begun = F.when(F.coalesce(rule["whole_day"], F.lit(False)), F.to_date(at) >= F.to_date(rule["starts"]))
        begun = begun.otherwise(at > rule["starts"])
        open_start = rule["starts"].isNull() | F.coalesce(begun, F.lit(False))
        return open_start & (rule["ends"].isNull() | F.coalesce(at < rule["ends"], F.lit(False)))

    named = pages_with_rules(df, page, rules).withColumnRenamed("rules", "_rules")
    joined = df.join(named, F.col(page) == F.col("_page"), "left")
    first = F.get(F.filter("_rules", holds), F.lit(0))["label"]
    return joined.withColumn(out, F.coalesce(first, F.lit(default))).drop("_page", "_rules")


def decide(df: DataFrame, facts: Mapping[str, Column], rules: DataFrame, default: str | None = None, out: str = "label") -> DataFrame:
    """The label of the first row of a decision table whose facts are those of the row.

    ``rules`` has `priority`, `label` and one column per fact; NULL there stands for any
    value of the fact, a missing one included. Only combinations of facts that rows have meet the
    table, so facts should take few values: a join over (combinations x rules) that decides,
    and one by equality that labels the rows. Equal priorities: the smallest label.
    """
    names = list(facts)
    own = {f"_f_{n}": c for n, c in facts.items()}
    known = df.withColumns(own)
    cases = known.select(*own).distinct()
    fits = F.lit(True)
    for n in names:
        fits = fits & (F.col(n).isNull() | (F.col(n) == F.col(f"_f_{n}")))
    met = cases.join(rules.select(*names, "priority", F.col("label").alias("_label")), fits)
    best = met.groupBy(*own).agg(F.min(F.struct("priority", "_label")).alias("_best"))
    joined = join_same(known, best, list(own))
    return joined.withColumn(out, F.coalesce(F.col("_best")["_label"], F.lit(default))).drop(*own, "_best")
