"""Labels computed over a whole table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions import columns as C
from stagewise.functions import vocab


def explode_json(df: DataFrame, json_col: str, item_schema: str, keep: Sequence[str], out: str = "item") -> DataFrame:
    """One row per element of a JSON array; none for NULL, empty or broken text."""
    items = F.from_json(json_col, f"array<{item_schema}>")
    return df.select(*keep, F.explode(items).alias(out))


def json_problem(json_col: str, item_schema: str, required: Sequence[str]) -> Column:
    """Why lines of a JSON payload are lost to `explode_json`, or lack a field; NULL where all is well.

    `null`, `broken` (no JSON text), `not_a_list` (neither a list nor an object, which
    counts as a list of one), `empty`, `not_an_object` (a line that is none), `other_case`
    (a line has a required key in other letters only) and `missing_key`; the first that
    holds. A key with the value null is there.
    """
    text = F.col(json_col)
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    items = F.from_json(json_col, f"array<{item_schema}>")
    listed = F.when(kind.startswith("OBJECT"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    lines = F.from_json(listed, "array<map<string,string>>")

    def lacks(line: Column, key: str) -> Column:
        return ~F.coalesce(F.array_contains(F.map_keys(line), key), F.lit(False))

    def cased(line: Column, key: str) -> Column:
        named = F.exists(F.map_keys(line), lambda k: F.lower(k) == key.lower())
        return lacks(line, key) & F.coalesce(named, F.lit(False))

    def any_line(test: Callable[[Column, str], Column]) -> Column:
        return F.exists(lines, lambda x: C.any_of(test(x, key) for key in required))

    # a line that is no object comes out as NULL, or makes the whole list NULL
    strange = items.isNull() | lines.isNull() | F.exists(lines, lambda x: x.isNull())
    return (
        F.when(text.isNull(), "null")
        .when(parsed.isNull(), "broken")
        .when(~kind.startswith("ARRAY") & ~kind.startswith("OBJECT"), "not_a_list")
        .when(F.size(F.try_variant_get(parsed, "$", "array<variant>")) == 0, "empty")
        .when(strange, "not_an_object")
        .when(any_line(cased), "other_case")
        .when(any_line(lacks), "missing_key")
    )


def rejected_payloads(
    df: DataFrame, json_col: str, item_schema: str, keep: Sequence[str], required: Sequence[str] = ()
) -> DataFrame:
    """Rows whose payload `explode_json` loses wholly or in part, with the payload and the `reason`.

    All columns are those of the input, so that the table can be mended and read again.
    """
    named = dict.fromkeys([*keep, json_col])
    return df.select(*named, json_problem(json_col, item_schema, required).alias("reason")).where("reason IS NOT NULL")


def with_keyword_class(df: DataFrame, text_col: str, keywords, default=None, out: str = "code") -> DataFrame:
    return df.withColumn(out, C.keyword_class(F.col(text_col), keywords, default))


def with_code_label(df: DataFrame, code_col: str, dim: Mapping | DataFrame, default, out: str = "label") -> DataFrame:
    """Label of a code, from a fixed mapping or from a two-column table (code, label).

    A table may be of any size: it joins without a broadcast hint, so its
    measured size decides how.
    """
    if isinstance(dim, DataFrame):
        code, label = dim.columns
        table = dim.select(F.col(code).alias("_code"), F.col(label).alias("_label")).dropDuplicates(["_code"])
        joined = df.join(table, df[code_col] == table["_code"], "left")
        return joined.withColumn(out, F.coalesce("_label", F.lit(default))).drop("_code", "_label")
    return df.withColumn(out, C.code_label(F.col(code_col), dim, default))


def with_pair_label(df: DataFrame, first: str, second: str, dim: Mapping, default=vocab.UNDEFINED, out="label"):
    return df.withColumn(out, C.pair_label(F.col(first), F.col(second), dim, default))


def with_canonical_page(df: DataFrame, url_col: str, labels=(), strict: bool = True, out: str = "page") -> DataFrame:
    return df.withColumn(out, C.canonical_page(F.col(url_col), labels, strict))


@dataclass(frozen=True)
class PageRule:
    """Pages that start to count from a launch time on."""

    test: str  # "contains" or "endswith"
    texts: tuple[str, ...]
    launched: str
    by_day: bool = False  # the launch day itself counts from midnight

    def holds(self, page: Column, ts: Column) -> Column:
        matches = C.any_of(getattr(page, self.test)(text) for text in self.texts)
        start = F.lit(self.launched).cast("timestamp")
        return matches & (F.to_date(ts) >= F.to_date(start) if self.by_day else ts > start)


def launch_rules(site: str) -> list[PageRule]:
    return [
        PageRule(test, tuple(text.format(site=site) for text in texts), launched, by_day)
        for test, texts, launched, by_day in vocab.LAUNCHES
    ]


def with_rule_flag(
    df: DataFrame,
    page: str,
    ts: str,
    tags: str | None,
    rules: Sequence[PageRule],
    tag_word: str = vocab.FUNNEL_TAG,
    out: str = "rule_flag",
) -> DataFrame:
    """1 where any page rule holds or a tag has the word, else 0 (also for NULL)."""
    hit = C.any_of(F.coalesce(rule.holds(F.col(page), F.col(ts)), F.lit(False)) for rule in rules)
    if tags is not None:
        hit = hit | C.has_tag(df, tags, tag_word)
    return df.withColumn(out, F.when(hit, 1).otherwise(0))
