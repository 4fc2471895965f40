"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.functions import vocab


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _sql(value) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


def constant_map(pairs: Mapping) -> Column:
    """A literal map, nested if the values are mappings; as small as the vocabulary it holds."""

    def text(m: Mapping) -> str:
        return "map(" + ", ".join(f"{_sql(k)}, {text(v) if isinstance(v, Mapping) else _sql(v)}" for k, v in m.items()) + ")"

    return F.expr(text(pairs))


def keyword_class(text: Column, keywords: Sequence[tuple[str, object]], default=None) -> Column:
    """Code of the first keyword found in the text."""
    out = F.lit(default)
    for word, code in reversed(list(keywords)):
        out = F.when(text.contains(word), F.lit(code)).otherwise(out)
    return out


def code_label(code: Column, labels: Mapping, default) -> Column:
    return F.coalesce(constant_map(labels)[code], F.lit(default))


def pair_label(first: Column, second: Column, labels: Mapping, default=vocab.UNDEFINED) -> Column:
    """Label of an exact pair; a missing or NULL part gives the default."""
    nested: dict = {}
    for (a, b), label in labels.items():
        nested.setdefault(a, {})[b] = label
    return F.coalesce(constant_map(nested)[first][second], F.lit(default))


def school_level(level: Column) -> Column:
    return F.when(level.isin(*vocab.SCHOOL_LEVELS), level).otherwise(vocab.UNDEFINED)


def canonical_page(url: Column, labels: Sequence[tuple[str, str]] = (), strict: bool = True) -> Column:
    """URL up to the query string, closed by a slash, or the label of the page.

    With ``strict`` off, a slash before a query string is doubled.
    """
    path = F.substring_index(url, "?", 1)
    closed = path.endswith("/") if strict else path.endswith("/") & ~url.contains("?")
    page = F.when(closed, path).otherwise(F.concat(path, F.lit("/")))
    for text, label in reversed(list(labels)):
        page = F.when(path.contains(text), F.lit(label)).otherwise(page)
    return page


def has_tag(df: DataFrame, tags: str, word: str) -> Column:
    """Does any tag contain the word? The column is text or an array of text."""
    if isinstance(df.schema[tags].dataType, T.ArrayType):
        return F.coalesce(F.exists(tags, lambda t: t.contains(word)), F.lit(False))
    return F.coalesce(F.col(tags).contains(word), F.lit(False))


def period(unit: str, when: Column) -> Column:
    """First day of the day, week (from Monday) or month."""
    return F.to_date(when) if unit == "day" else F.to_date(F.date_trunc(unit, when))


def same_bucket(a: Column, b: Column, unit: str = "hour") -> Column:
    return F.when(F.date_trunc(unit, a) == F.date_trunc(unit, b), "new").otherwise("current")


def seconds_between(start: Column, end: Column) -> Column:
    """Difference of the whole seconds of two timestamps."""
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def not_named(name: Column, names: Sequence[str], keep_null: bool) -> Column:
    allowed = ~F.lower(name).isin(*names)
    return allowed | name.isNull() if keep_null else allowed


def is_false(flag: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(flag, F.lit(False)) == F.lit(False)


def in_slice(ts: Column, lo: str, hi: str, hi_inclusive: bool) -> Column:
    start, end = F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")
    return (ts >= start) & ((ts <= end) if hi_inclusive else (ts < end))
