"""First events per key, kept in a stored table that slices are merged into."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.config import FunnelConfig
from stagewise.functions import columns as C
from stagewise.operators.keyed import first_per_key
from stagewise.operators.skew import join_same
from stagewise.plans import purchases as P
from stagewise.plans import requests as R
from stagewise.session import Workspace, exists, names_in, remove
from stagewise.sources.tables import FunnelSources


@dataclass(frozen=True)
class FirstOf:
    """What is kept: the first event per key in a total order, an event's id and time, and further columns."""

    keys: Sequence[str]
    order: Sequence[str | Column]
    row_id: Sequence[str]
    ts: str
    columns: Sequence[str] = ()

    def select(self, rows: DataFrame) -> DataFrame:
        named = dict.fromkeys([*self.keys, *self.row_id, self.ts, *self.columns])
        return rows.select(*named)


class FirstState:
    """Folder of the first event of every key, parted by the hash of the key.

    `update` merges a slice of time. The new events of the slice are brought to one row per
    key before they meet the state. The slice is the truth about its own time: a stored
    first that lies in it, or whose id it holds, and that is not among its rows as it was
    stored, has been corrected or withdrawn. Only for the keys of such rows the history
    is read again; a key whose events are all gone is kept without an event, so that
    `read` leaves it out.

    Slices may come in any order, overlap and come again. An event that moved has to be
    in a slice at its new time. NULL is a key as any other. An event without a time lies in
    no slice; it is merged when it is given, and noticed as gone by nothing.

    Only parts of the folder in which a row changes are written: to `pending` first, then
    put in place by dynamic partition overwrite. A run that was lost is finished, or
    dropped, by the next one. The number of parts holds for the life of the folder.
    """

    def __init__(self, spark: SparkSession, root: str, spec: FirstOf, parts: int = 256):
        self.spark, self.root, self.spec, self.parts = spark, root.rstrip("/"), spec, parts
        others = [x for x in names_in(spark, self.root) if x.startswith("parts_") and x != f"parts_{parts}"]
        if others:
            raise ValueError(f"{root} holds {others[0]}, not parts_{parts}")
        self.path, self.pending = f"{self.root}/parts_{parts}", f"{self.root}/pending"

    def read(self, schema=None) -> DataFrame:
        """The first event of every key that has one; the schema is needed while there is none."""
        if schema is not None and not self._filled():
            return self.spark.createDataFrame([], schema)
        return self._stored().where("_found").drop("_found", "_part")

    def _stored(self, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path)

    def _filled(self) -> bool:
        return any(x.startswith("_part=") for x in names_in(self.spark, self.path))

    def finish(self) -> None:
        """Put pending parts in place, also those that a run before left when it was lost."""
        if exists(self.spark, f"{self.pending}/_SUCCESS"):
            self._write(self.spark.read.parquet(self.pending), self.path, "dynamic")
        remove(self.spark, self.pending)

    def _write(self, rows: DataFrame, path: str, overwrite: str) -> None:
        writer = rows.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", overwrite)
        writer.partitionBy("_part").parquet(path)

    def update(
        self, rows: DataFrame, lo: str, hi: str, history: DataFrame | None = None, hi_inclusive: bool = False
    ) -> None:
        """Merge the events of the slice from `lo` to `hi`.

        `history` are the events of all time, read for keys whose stored first was corrected;
        a state that has such keys and gets none raises.
        """
        self.finish()
        spec, keys = self.spec, list(self.spec.keys)
        rows = spec.select(rows)
        part = F.pmod(F.xxhash64(*keys), F.lit(self.parts)).cast("int")
        with Workspace(self.spark) as work:
            merged = work.stage(first_per_key(rows, keys, spec.order).withColumn("_found", F.lit(True)), "new")
            if self._filled():
                stored = self._stored(merged.withColumn("_part", part).schema).drop("_part")
                hit = work.stage(self._corrected(stored, rows, C.in_slice(F.col(spec.ts), lo, hi, hi_inclusive)), "hit")
                kept = join_same(stored, merged.unionByName(hit, allowMissingColumns=True), keys, "left_semi")
                if not hit.isEmpty():
                    if history is None:
                        raise ValueError("a stored first was corrected: the history of its key is needed")
                    past = join_same(spec.select(history), hit, keys, "left_semi")
                    anew = first_per_key(past, keys, spec.order).withColumn("_found", F.lit(True))
                    none = hit.withColumn("_found", F.lit(False))
                    kept = join_same(kept, hit, keys, "left_anti").unionByName(anew).unionByName(none, allowMissingColumns=True)
                pool = kept.unionByName(merged)
                merged = first_per_key(pool, keys, [F.col("_found").desc(), *spec.order])
                # rows that are stored as they are need no write
                merged = work.stage(merged.subtract(stored), "merged")
            # as many values as the folder has parts
            touched = [r["_part"] for r in merged.select(part.alias("_part")).distinct().collect()]
            if not touched:
                return
            if self._filled():
                mine = self._stored(merged.withColumn("_part", part).schema).where(F.col("_part").isin(touched))
                merged = join_same(mine.drop("_part"), merged, keys, "left_anti").unionByName(merged)
            self._write(merged.withColumn("_part", part), self.pending, "static")
        self.finish()

    def _corrected(self, stored: DataFrame, rows: DataFrame, inside: Column) -> DataFrame:
        """Keys whose stored first is no longer what the slice says."""
        firsts = stored.where("_found").drop("_found")
        known = join_same(firsts, rows.select(*self.spec.row_id).distinct(), self.spec.row_id, "left_semi")
        said = firsts.where(inside).unionByName(known)
        return said.subtract(rows).select(*self.spec.keys).distinct()


@dataclass(frozen=True)
class FunnelFirsts:
    """The four first events that the funnel asks of all history."""

    payments: FirstState
    lessons: FirstState
    trials: FirstState
    trials_any: FirstState

    @classmethod
    def at(cls, spark: SparkSession, root: str, parts: int = 256) -> FunnelFirsts:
        order = R.slot_order()
        trial = ["student_id", "lesson_id"], "created_at"
        # the school level goes with the first trial
        more = ["subject_id", "grade_kind", "canceled_at"]
        specs = {
            "payments": FirstOf(["client_id"], ["moment", "id"], ["id"], "moment"),
            "lessons": FirstOf(
                ["grade_kind", "subject_id", "client_id"], ["time_start", "lesson_id"], ["client_id", "lesson_id"], "time_start"
            ),
            "trials": FirstOf(["student_id", "subject_id"], order, *trial, more),
            "trials_any": FirstOf(["student_id"], order, *trial, more),
        }
        return cls(**{n: FirstState(spark, f"{root.rstrip('/')}/{n}", s, parts) for n, s in specs.items()})

    def update(self, src: FunnelSources, cfg: FunnelConfig) -> None:
        """Merge the slice of `cfg`: payments by moment, lessons by start, trials by creation.

        The times are tested on the source tables, so the scans are cut to the slice. A paid
        lesson, or a payment with its orders, that changes must be refreshed with its own time.
        """

        paid = P.paid_payments(src, cfg)
        lessons = R.paid_lessons(src, cfg).withColumnRenamed("student_id", "client_id")
        trials = R.allowed(R.trial_lessons(src), cfg)
        for state, history in ((self.payments, paid), (self.lessons, lessons), (self.trials, trials), (self.trials_any, trials)):
            rows = history.where(C.in_slice(F.col(state.spec.ts), cfg.lo, cfg.hi, cfg.hi_inclusive))
            state.update(rows, cfg.lo, cfg.hi, history, cfg.hi_inclusive)
