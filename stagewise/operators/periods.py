"""Per-period dedup flags and labels of the funnel table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions import vocab
from stagewise.functions.columns import period
from stagewise.operators.keyed import first_per_key
from stagewise.operators.skew import HOT_ROWS, HotGroups, by_group_size, find_hot, join_same, with_blocks
from stagewise.operators.stages import fallback_key
from stagewise.session import Workspace

GRAINS = ("day", "week", "month")
FLAG = {"day": "rn_daily", "week": "rn_weekly", "month": "rn_monthly"}


@dataclass(frozen=True)
class FlagColumns:
    """Columns the flags are numbered by; ``ties`` make every order total."""

    person: str = "phone"
    product: str = "subject_name"
    request_day: str = "trial_created_at"
    lead_ts: str = "lead_created"
    tag: str = "union_rn"
    request_id: str = "lesson_id"
    ties: Sequence[str] = field(default_factory=tuple)


def period_flags(
    df: DataFrame,
    cols: FlagColumns = FlagColumns(),
    grains: Sequence[str] = GRAINS,
    sentinel: str = "2018-01-01",
    exact_daily_lead: bool = False,
    hot_rows: int = HOT_ROWS,
    hot: HotGroups | None = None,
    work: Workspace | None = None,
) -> DataFrame:
    """Adds two numbers per grain; a row numbered 1 counts in its period.

    By request: rows with a request are numbered within person, request period
    and product; the others within person and lead period, among all rows there.
    By lead: all rows are numbered within person, lead period and product (rows
    before the sentinel day without the product).

    All windows contain the person, so one shuffle by person serves them all.
    Persons with more than ``hot_rows`` rows are numbered slice by slice.
    """
    rows = ranked(df, cols, grains, exact_daily_lead, hot, hot_rows, work)
    return rows.select(*df.columns, *[c.alias(n) for n, c in flag_values(cols, grains, sentinel).items()])


def ranked(
    df: DataFrame,
    cols: FlagColumns,
    grains: Sequence[str],
    exact_daily_lead: bool,
    hot: HotGroups | None,
    hot_rows: int,
    work: Workspace | None,
) -> DataFrame:
    """Adds the ranks of every basis and grain, from which ``flag_values`` chooses."""
    work = work or Workspace(df.sparkSession)
    groups = find_hot(df, [cols.person], hot_rows, work) if hot is None else hot
    return by_group_size(
        df,
        [cols.person],
        lambda rows: _numbered(groups.spread(rows, cols.person), cols, grains, exact_daily_lead),
        lambda rows: _numbered_in_slices(rows, cols, grains, exact_daily_lead, groups),
        groups,
        hot_rows,
        work,
    )


def _lead_periods(cols: FlagColumns, grain: str, exact_daily_lead: bool, product: bool) -> Column:
    lead = F.col(cols.lead_ts)
    return lead if exact_daily_lead and product and grain == "day" else period(grain, lead)


def _numbered(df, cols, grains, exact_daily_lead, by_lead=(), by_request=(), groups=None):
    """Ranks of every basis and grain; ``by_*`` add slice columns to the partitions.

    All windows of a basis contain the person and its slice, so that with slices one shuffle
    for each basis serves them; ``groups`` says how many rows these have.
    """
    ties = [c for c in cols.ties if c != cols.request_id]
    lead_order = Window.orderBy(cols.tag, cols.lead_ts, cols.request_id, *ties)
    request_order = Window.orderBy(cols.tag, cols.request_day, cols.request_id, *ties)
    by_lead_ranks, by_request_ranks = {}, {}
    for g in grains:
        for product in (False, True):
            p = _lead_periods(cols, g, exact_daily_lead, product)
            keys = [cols.person, p, *([cols.product] if product else []), *by_lead]
            by_lead_ranks[f"_lead_{g}_{int(product)}"] = F.row_number().over(lead_order.partitionBy(*keys))
        keys = [cols.person, period(g, F.col(cols.request_day)), cols.product, *by_request]
        by_request_ranks[f"_request_{g}"] = F.row_number().over(request_order.partitionBy(*keys))
    if groups is not None:
        df = groups.spread(df, cols.person, *by_lead)
    numbered = df.withColumns(by_lead_ranks)
    if groups is not None:
        numbered = groups.spread(numbered, cols.person, *by_request)
    return numbered.withColumns(by_request_ranks)


LEAD_SLICE, REQUEST_SLICE = ("_day", "_lead_block"), ("_request_block",)


def in_slices(df: DataFrame, cols: FlagColumns) -> DataFrame:
    """Rows of large groups with the slices they are numbered in.

    Slices follow the numbering order: tag, day of the lead, then a block of lead times,
    request ids and ties; or tag, request day, then a block of request ids and ties. Rows of
    one instant are so cut like any others. Rows without a request get no number by request
    that counts, and are cut by lead time there.
    """
    ties = [F.col(c) for c in cols.ties if c != cols.request_id]
    lead, request = F.col(cols.lead_ts), F.col(cols.request_id)
    cut = with_blocks(df, [cols.person], {"_lead_block": [lead, request, *ties], "_id_block": [request, *ties]})
    block = F.when(F.col(cols.request_day).isNull(), F.col("_lead_block")).otherwise(F.col("_id_block"))
    return cut.withColumns({"_day": F.to_date(cols.lead_ts), "_request_block": block}).drop("_id_block")


def _numbered_in_slices(df, cols, grains, exact_daily_lead, groups):
    """Rank inside a slice plus the rows of the earlier slices of the group."""
    tag, person, product = cols.tag, cols.person, cols.product
    sliced = in_slices(df, cols)

    lead_slice = [tag, *LEAD_SLICE]
    sizes = sliced.groupBy(person, product, *lead_slice).agg(F.count(F.lit(1)).alias("_n"))
    before = {}
    for g in grains:
        for with_product in (False, True):
            if exact_daily_lead and with_product and g == "day":
                continue
            keys = [person, period(g, F.col("_day")), *([product] if with_product else [])]
            before[f"_b_lead_{g}_{int(with_product)}"] = _rows_before(keys, lead_slice)
    lead_offsets = sizes.withColumns(before).drop("_n")

    request_slice = [tag, cols.request_day, *REQUEST_SLICE]
    sizes = sliced.groupBy(person, product, *request_slice).agg(F.count(F.lit(1)).alias("_n"))
    request_offsets = sizes.withColumns(
        {
            f"_b_request_{g}": _rows_before([person, period(g, F.col(cols.request_day)), product], request_slice)
            for g in grains
        }
    ).drop("_n")

    ranked = _numbered(sliced, cols, grains, exact_daily_lead, lead_slice, request_slice, groups)
    joined = join_same(ranked, lead_offsets, [person, product, *lead_slice])
    joined = join_same(joined, request_offsets, [person, product, *request_slice])
    if exact_daily_lead and "day" in grains:
        # numbers of one instant start again, so slices are counted by instant; the first needs no row
        instant = [person, cols.lead_ts, product]
        sizes = sliced.groupBy(*instant, *lead_slice).agg(F.count(F.lit(1)).alias("_n"))
        before = sizes.withColumn("_b_exact", _rows_before(instant, lead_slice)).where("_b_exact > 0").drop("_n")
        joined = join_same(joined, before, [*instant, *lead_slice])
        joined = joined.withColumn("_b_lead_day_1", F.coalesce("_b_exact", F.lit(0)))
    names = [f"_lead_{g}_{p}" for g in grains for p in (0, 1)] + [f"_request_{g}" for g in grains]
    return joined.withColumns({n: F.col(n) + F.col("_b" + n) for n in names}).select(*df.columns, *names)


def _rows_before(keys, slices) -> Column:
    up_to = F.sum("_n").over(Window.partitionBy(*keys).orderBy(*slices))
    own = F.sum("_n").over(Window.partitionBy(*keys, *slices))
    return up_to - own


def flag_values(cols: FlagColumns, grains: Sequence[str], sentinel: str) -> dict[str, Column]:
    """Both flags of each grain, by the ranks."""
    start = F.lit(sentinel).cast("timestamp")
    requested = F.col(cols.request_day).cast("timestamp") >= start
    lead = F.col(cols.lead_ts).cast("timestamp")
    flags = {}
    for g in grains:
        by_lead = F.col(f"_lead_{g}_0")
        flags[FLAG[g]] = F.when(requested, F.col(f"_request_{g}")).otherwise(by_lead)
        flags[FLAG[g] + "_lead"] = F.when(lead >= start, F.col(f"_lead_{g}_1")).when(lead < start, by_lead)
    return {n: c.cast("long") for n, c in flags.items()}


def suppress_covered(
    df: DataFrame, person: str, lead_ts: str, tag: str, ties: Sequence[str], covering: int = 1
) -> DataFrame:
    """Rows of the covering tag, and the other rows that rank first of a person's lead day.

    The tag leads the order, so on a covered day no other row ranks first.
    """
    dated = df.withColumn("_day", F.to_date(lead_ts))
    covered = F.col(tag) == covering
    first = first_per_key(dated, [person, "_day"], [tag, lead_ts, *ties])
    return df.where(covered).unionByName(first.where(~covered).drop("_day"))


def label_period(cols: FlagColumns, grain: str, sentinel: str) -> Column:
    """Request period, or lead period where there is no request."""
    requested = F.col(cols.request_day).cast("timestamp") >= F.lit(sentinel).cast("timestamp")
    return F.when(requested, period(grain, F.col(cols.request_day))).otherwise(period(grain, F.col(cols.lead_ts)))


def with_label_sets(
    df: DataFrame,
    grain: str,
    person_keys: Sequence[str],
    labels: Sequence[str] = ("lead_type", "lead_type_2"),
    cols: FlagColumns = FlagColumns(),
    sentinel: str = "2018-01-01",
    fact: DataFrame | None = None,
) -> DataFrame:
    """Adds the set of labels that each row has in its period, ``_labels_<grain>``, one row for one.

    Counted rows are taken from ``fact`` (default: the labelled table itself).
    An undefined product takes the labels of any product, and a missing label is
    the row's own. The labels of a product are joined as one array and made distinct inside
    the row, so wide rows are not shuffled for it.
    """
    keys = {
        "_person": fallback_key(*person_keys),
        "_period": label_period(cols, grain, sentinel),
        "_product": F.coalesce(F.col(cols.product), F.lit("0")),
    }
    keyed = df.withColumns(keys)
    counted = (
        (df if fact is None else fact)
        .where(F.col(FLAG[grain]) == 1)
        .withColumns(keys)
        .select(
            F.col("_person").alias("_p"),
            F.col("_period").alias("_d"),
            F.explode(F.array_distinct(F.array("_product", F.lit(vocab.UNDEFINED)))).alias("_s"),
            F.struct(*[F.col(c).alias(c) for c in labels]).alias("_l"),
        )
        .groupBy("_p", "_d", "_s")
        .agg(F.collect_set("_l").alias("_labels"))
    )
    cond = (F.col("_person") == F.col("_p")) & (F.col("_period") == F.col("_d")) & (F.col("_product") == F.col("_s"))

    def own_where_missing(found: Column) -> Column:
        return F.struct(*[F.coalesce(found[c], F.col(c)).alias(c) for c in labels])

    own = F.array(F.struct(*[F.col(c).alias(c) for c in labels]))
    each = F.coalesce(F.array_distinct(F.transform("_labels", own_where_missing)), own)
    return keyed.join(counted, cond, "left").select(*df.columns, each.alias(f"_labels_{grain}"))


def spread_label_sets(
    df: DataFrame, grains: Sequence[str], labels: Sequence[str] = ("lead_type", "lead_type_2")
) -> DataFrame:
    """Rows by the sets of ``with_label_sets``: one for each choice of a label set per grain, as ``<label>_<grain>``."""

    def choices(chosen: list[Column], rest: Sequence[str]) -> Column:
        if not rest:
            picked = [found[c].alias(f"{c}_{g}") for g, found in zip(grains, chosen) for c in labels]
            return F.array(F.struct(*picked))
        return F.flatten(F.transform(f"_labels_{rest[0]}", lambda found: choices([*chosen, found], rest[1:])))

    kept = [c for c in df.columns if c not in {f"_labels_{g}" for g in grains}]
    spread = df.select(*kept, F.explode(choices([], grains)).alias("_label"))
    return spread.select(*kept, *[F.col("_label")[f"{c}_{g}"].alias(f"{c}_{g}") for g in grains for c in labels])


def period_labels(
    df: DataFrame,
    grain: str,
    person_keys: Sequence[str],
    labels: Sequence[str] = ("lead_type", "lead_type_2"),
    cols: FlagColumns = FlagColumns(),
    sentinel: str = "2018-01-01",
    fact: DataFrame | None = None,
) -> DataFrame:
    """Adds ``<label>_<grain>``: the label of the counted row of person, product and period.

    A row comes out once for each different set of labels it ends with. Where several grains
    are labelled, ``with_label_sets`` for each and one ``spread_label_sets`` shuffle fewer rows.
    """
    return spread_label_sets(with_label_sets(df, grain, person_keys, labels, cols, sentinel, fact), [grain], labels)
