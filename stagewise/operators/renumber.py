"""Flags and labels of a table that few rows were added to or taken from, by difference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions.columns import period
from stagewise.operators.periods import FLAG, GRAINS, FlagColumns, flag_values, label_period, period_labels, ranked
from stagewise.operators.skew import HOT_ROWS, HotGroups, join_same
from stagewise.operators.stages import fallback_key
from stagewise.session import Workspace

#: A period by its basis and grain; what a change of a row may change is named by these.
PERIOD = "struct<basis: string, grain: string, first: date>"


def _period(basis: str, grain: str, when: Column) -> Column:
    return F.struct(F.lit(basis).alias("basis"), F.lit(grain).alias("grain"), period(grain, when).alias("first")).cast(PERIOD)


def _periods(cols: FlagColumns, grains: Sequence[str]) -> dict[tuple[str, str], Column]:
    """The six numbered periods of a row; a row without a time has the period NULL of its basis."""
    times = {"lead": F.col(cols.lead_ts), "request": F.col(cols.request_day)}
    return {(b, g): _period(b, g, when) for b, when in times.items() for g in grains}


def without(df: DataFrame, gone: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows that are not among the gone ones, told by `ids`, where NULL equals NULL."""
    return join_same(df, gone.select(*ids).distinct(), ids, "left_anti")


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Different rows that one of two tables has more often than the other, from one shuffle of both."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").drop("_n")


def update_flags(
    flagged: DataFrame,
    added: DataFrame,
    gone: DataFrame,
    ids: Sequence[str],
    work: Workspace,
    cols: FlagColumns = FlagColumns(),
    grains: Sequence[str] = GRAINS,
    sentinel: str = "2018-01-01",
    exact_daily_lead: bool = False,
    hot_rows: int = HOT_ROWS,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Rows with their flags after some were added and others went, as if all were numbered again.

    ``flagged`` is what ``period_flags`` gave, before rows are suppressed; ``added``
    has its columns without the flags, ``gone`` at least ``ids``, which tell rows apart;
    gone rows that are not there change nothing. Of a person only the periods that a
    changed row lies in are numbered again, from all rows in them; all other numbers,
    and all rows of people without a change, are carried over without a window.

    The periods of a person's changes travel as one array per person. It has as many
    entries as there are days, weeks and months with a change, whatever the rows.
    """
    names = [n for n in flagged.columns if n not in {f for g in grains for f in (FLAG[g], FLAG[g] + "_lead")}]
    lost = join_same(flagged, gone.select(*ids).distinct(), ids, "left_semi").select(*names)
    periods = _periods(cols, grains)
    hits = lost.unionByName(added.select(*names)).select(cols.person, F.explode(F.array(*periods.values())).alias("_p"))
    hits = work.stage(hits.groupBy(cols.person).agg(F.collect_set("_p").alias("_hits")), "hits")

    kept = join_same(without(flagged, gone, ids), hits, [cols.person])
    hit = {k: F.coalesce(F.array_contains("_hits", p), F.lit(False)) for k, p in periods.items()}
    touched = F.coalesce(F.arrays_overlap("_hits", F.array(*periods.values())), F.lit(False))
    flags = [f for g in grains for f in (FLAG[g], FLAG[g] + "_lead")]
    again = kept.where(touched).withColumns({f"_{b}_{g}_hit": h for (b, g), h in hit.items()}).drop("_hits")
    fresh = added.select(*names).withColumns({f"_{b}_{g}_hit": F.lit(True) for b, g in periods} | {f: F.lit(None).cast("long") for f in flags})
    pool = work.stage(again.unionByName(fresh), "pool")

    numbered = ranked(pool, cols, grains, exact_daily_lead, hot, hot_rows, work)
    requested = F.coalesce(F.col(cols.request_day).cast("timestamp") >= F.lit(sentinel).cast("timestamp"), F.lit(False))
    values = {}
    for name, value in flag_values(cols, grains, sentinel).items():
        g = next(g for g in grains if name in (FLAG[g], FLAG[g] + "_lead"))
        by_lead, by_request = F.col(f"_lead_{g}_hit"), F.col(f"_request_{g}_hit")
        is_hit = by_lead if name.endswith("_lead") else F.when(requested, by_request).otherwise(by_lead)
        values[name] = F.when(is_hit, value).otherwise(F.col(name))
    numbered = numbered.select(*names, *[values[f].alias(f) for f in flags])
    return kept.where(~touched).select(*names, *flags).unionByName(numbered)


def update_labels(
    labelled: DataFrame,
    fact: DataFrame,
    changed: DataFrame,
    persons: Mapping[str, Sequence[str]],
    work: Workspace,
    labels: Sequence[str] = ("lead_type", "lead_type_2"),
    cols: FlagColumns = FlagColumns(),
    sentinel: str = "2018-01-01",
) -> DataFrame:
    """Labels of a fact in which some rows are new, gone or numbered anew, as if all were labelled again.

    ``labelled`` is the fact before with ``<label>_<grain>``, ``fact`` the one after
    with its flags, ``changed`` all rows that are in one of them only, flags included.
    ``persons`` has the person key of each grain. A row is labelled again if it shares
    person and period of some grain with a changed row; the others are carried over.
    """
    grains = list(persons)

    def keys(df: DataFrame) -> dict[str, Column]:
        return {g: F.struct(F.lit(g).alias("grain"), fallback_key(*persons[g]).alias("person"), label_period(cols, g, sentinel).alias("first")) for g in grains}

    # per person key, as flags: periods of changes are few per person
    hits = changed.select(F.explode(F.array(*keys(changed).values())).alias("k")).select("k.*")
    hits = work.stage(hits.groupBy("grain", "person").agg(F.collect_set("first").alias("_firsts")), "label_hits")

    def marked(df: DataFrame) -> DataFrame:
        """Adds whether the row has a changed key; rows without person or period have labels of their own."""
        out = df.withColumn("_touched", F.lit(False))
        for g in grains:
            mine = hits.where(F.col("grain") == g).select(F.col("person").alias("_person"), "_firsts")
            out = out.join(mine, fallback_key(*persons[g]) == F.col("_person"), "left")
            here = F.coalesce(F.array_contains("_firsts", label_period(cols, g, sentinel)), F.lit(False))
            out = out.withColumn("_touched", F.col("_touched") | here).drop("_person", "_firsts")
        return out

    rows = marked(fact)
    # what is new carries no label yet, with or without a key
    new = join_same(fact, changed.select(*fact.columns).distinct(), fact.columns, "left_semi")
    again = work.stage(rows.where("_touched").drop("_touched").unionByName(new).distinct(), "relabel")
    # counted rows of the same people; the others cannot give these rows a label
    near = [again.select(fallback_key(*persons[g]).alias("_person")) for g in grains]
    people = near[0]
    for more in near[1:]:
        people = people.unionAll(more)
    people = people.where("_person IS NOT NULL").distinct()
    source = fact.where(F.greatest(*[F.col(FLAG[g]) == 1 for g in grains]))
    about = [source.join(people, fallback_key(*persons[g]) == F.col("_person"), "left_semi").where(F.col(FLAG[g]) == 1) for g in grains]
    out = again
    for g, counted in reversed(list(zip(grains, about))):
        out = period_labels(out, g, persons[g], labels, cols, sentinel, fact=counted)
    carried = join_same(marked(labelled).where(~F.col("_touched")).drop("_touched"), changed.select(*fact.columns).distinct(), fact.columns, "left_anti")
    return carried.unionByName(out.select(*labelled.columns))
