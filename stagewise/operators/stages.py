"""Attaching stages, deriving stage columns and stacking stage tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions import columns as C
from stagewise.functions import vocab


@dataclass(frozen=True)
class Stage:
    """A stage table and how its rows belong to a base row.

    ``on`` maps base columns to stage columns. A stage row whose ``wildcard``
    column (base column -> stage column) is NULL belongs to any base value.
    ``values`` maps stage columns to their names in the result.
    """

    rows: DataFrame
    on: Mapping[str, str]
    values: Mapping[str, str]
    wildcard: tuple[str, str] | None = None


def attach_stages(base: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Left-join each stage; base rows are never lost.

    Only the needed columns of a stage are joined, and its copies once, so
    many equal stage rows cannot multiply a base row.
    """
    out = base
    for n, stage in enumerate(stages):
        used = [*stage.on.values(), *stage.values]
        if stage.wildcard:
            used.append(stage.wildcard[1])
        named = {c: f"_s{n}_{c}" for c in dict.fromkeys(used)}
        rows = stage.rows.select(*[F.col(c).alias(a) for c, a in named.items()]).distinct()
        cond = C.all_of(out[b] == rows[named[s]] for b, s in stage.on.items())
        if stage.wildcard:
            b, s = stage.wildcard
            cond = cond & (rows[named[s]].isNull() | (rows[named[s]] == out[b]))
        kept = [out[c] for c in out.columns]
        out = out.join(rows, cond, "left").select(*kept, *[rows[named[c]].alias(a) for c, a in stage.values.items()])
    return out


def left_join_null_safe(left: DataFrame, right: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Left join where NULL equals NULL; the right key columns are dropped."""
    named = {s: f"_n_{s}" for s in on.values()}
    for old, new in named.items():
        right = right.withColumnRenamed(old, new)
    cond = C.all_of(left[b].eqNullSafe(right[named[s]]) for b, s in on.items())
    return left.join(right, cond, "left").drop(*named.values())


def fallback_key(*parts: str) -> Column:
    """First non-NULL of several keys, as text so that numbers and text compare."""
    return F.coalesce(*[F.col(p).cast("string") for p in parts])


def left_join_fallback(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]):
    """Left join on the first non-NULL key of each side; the right keys are dropped."""
    keyed = right.withColumn("_fk", fallback_key(*right_keys)).drop(*right_keys)
    base = left.withColumn("_lk", fallback_key(*left_keys))
    return base.join(keyed, F.col("_lk") == F.col("_fk"), "left").drop("_lk", "_fk")


def lead_time(staff_log: Column, lead_ts: Column, request_ts: Column, offset: str) -> Column:
    """Time of the lead stage of a request.

    Own enrolment: just before the request. By staff: the matched lead, or the
    request itself when there is none.
    """
    return F.when(staff_log.isNull(), request_ts - F.expr(offset)).otherwise(F.coalesce(lead_ts, request_ts))


def derive_lead_time(
    df: DataFrame, staff_log: str, lead_ts: str, request_ts: str, offset: str = "interval 1 minute", out="lead_created"
) -> DataFrame:
    return df.withColumn(out, lead_time(F.col(staff_log), F.col(lead_ts), F.col(request_ts), offset))


def with_same_bucket_flag(df: DataFrame, a: str, b: str, unit: str = "hour", out: str = "same_bucket") -> DataFrame:
    return df.withColumn(out, C.same_bucket(F.col(a), F.col(b), unit))


def with_group_fallback(df: DataFrame, primary: Sequence[str], backup: Sequence[str]) -> DataFrame:
    """Where all primary columns are NULL take all backup columns, else change nothing."""
    empty = C.all_of(F.col(p).isNull() for p in primary)
    return df.withColumns({p: F.when(empty, F.col(b)).otherwise(F.col(p)) for p, b in zip(primary, backup)})


def union_stages(a: DataFrame, b: DataFrame, tag: str = "union_rn") -> DataFrame:
    """Rows of both tables, tagged 1 and 2; missing columns become typed NULLs."""
    return a.withColumn(tag, F.lit(1)).unionByName(b.withColumn(tag, F.lit(2)), allowMissingColumns=True)


def exclude_test_records(
    df: DataFrame,
    names: Mapping[str, tuple[Sequence[str], bool]] | None = None,
    false_flags: Sequence[str] = (),
    floors: Mapping[str, float] | None = None,
    kinds: Mapping[str, Sequence[int]] | None = None,
) -> DataFrame:
    """Drop test records.

    ``names``: column -> (names in lower case, keep rows without a name);
    ``false_flags``: must be false or NULL; ``floors``: must be greater;
    ``kinds``: column -> codes to drop (NULL drops too).
    """
    tests = [C.not_named(F.col(c), listed, keep) for c, (listed, keep) in (names or {}).items()]
    tests += [C.is_false(F.col(c)) for c in false_flags]
    tests += [F.col(c) > floor for c, floor in (floors or {}).items()]
    tests += [~F.col(c).isin(*codes) for c, codes in (kinds or {}).items()]
    return df.where(C.all_of(tests))


def created_by_staff(requests: DataFrame, log: DataFrame, keys: Sequence[str], log_id: str) -> DataFrame:
    """Adds the log's lesson (NULL if none) and the enrolment type of each request."""
    entries = log.select(*[F.col(k).alias("_l_" + k) for k in keys], F.col(log_id).alias("_entry")).distinct()
    cond = C.all_of(requests[k] == entries["_l_" + k] for k in keys)
    joined = requests.join(entries, cond, "left").drop(*["_l_" + k for k in keys])
    return joined.withColumn("lead_type", enrolment_type(F.col("_entry"))).withColumnRenamed("_entry", "sl_lesson_id")


def enrolment_type(staff_log: Column) -> Column:
    return F.when(staff_log.isNull(), vocab.BY_USER).otherwise(vocab.BY_OPERATOR)
