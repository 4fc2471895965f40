"""First purchase before and after the change of the payment system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.config import FunnelConfig
from stagewise.functions import columns as C
from stagewise.functions import vocab
from stagewise.operators.keyed import first_per_key, first_seen, next_event
from stagewise.operators.labelling import explode_json, rejected_payloads
from stagewise.operators.match import followed_by
from stagewise.operators.skew import find_hot
from stagewise.operators.stages import exclude_test_records
from stagewise.plans.requests import paid_lessons
from stagewise.session import Workspace
from stagewise.sources.tables import FunnelSources

PAYMENT_ITEM = "struct<Description:string>"
ORDER_ITEM = "struct<lessons_count:string>"


def real_payments(src: FunnelSources, cfg: FunnelConfig) -> DataFrame:
    return exclude_test_records(src.payments, false_flags=["testing"], floors={"amount": cfg.min_amount})


def _old(cfg: FunnelConfig) -> Column:
    return F.to_date("moment") < F.lit(cfg.era_cut).cast("date")


def payment_items(payments: DataFrame) -> DataFrame:
    """One row per line of a payment, with the line's text."""
    keep = ["id", "client_id", "moment", "amount", "status"]
    return explode_json(payments, "data", PAYMENT_ITEM, keep).select(*keep, F.col("item.Description").alias("text"))


def rejected_payments(src: FunnelSources, cfg: FunnelConfig) -> DataFrame:
    """Real payments whose lines are lost, or have no text, with the reason."""
    return rejected_payloads(real_payments(src, cfg), "data", PAYMENT_ITEM, ["id", "client_id", "moment"], ["Description"])


def rejected_orders(src: FunnelSources) -> DataFrame:
    """Orders whose packages cannot be read, with the reason; an order may well have none."""
    found = rejected_payloads(src.orders, "data", ORDER_ITEM, ["payment_id", "state"], ["lessons_count"])
    return found.where(~F.col("reason").isin("null", "empty"))


def order_states(orders: DataFrame) -> DataFrame:
    """Per payment: has it a paid order, a cancelled order, any lesson package?

    One row per payment, so orders cannot multiply payments.
    """
    packages = F.size(F.from_json("data", f"array<{ORDER_ITEM}>")) > 0
    return orders.groupBy(F.col("payment_id")).agg(
        F.bool_or(F.col("state") == "paid").alias("paid"),
        F.bool_or(F.col("state").isin("paid", "cancelled")).alias("paid_or_cancelled"),
        F.bool_or(F.coalesce(packages, F.lit(False))).alias("has_package"),
    )


def paid_payments(src: FunnelSources, cfg: FunnelConfig) -> DataFrame:
    """Real payments with a paid order and a line that is not a trial lesson."""
    lines = F.from_json("data", f"array<{PAYMENT_ITEM}>")
    not_trial = F.exists(lines, lambda x: ~x["Description"].startswith(vocab.TRIAL_TEXT_PREFIX))
    payments = real_payments(src, cfg).where(not_trial).select("id", "client_id", "moment", "amount")
    states = order_states(src.orders).where("paid").withColumnRenamed("payment_id", "id")
    return payments.join(states.select("id", "has_package"), "id")


def purchases_before(src: FunnelSources, cfg: FunnelConfig) -> DataFrame:
    """Old era: first payment per client and subject named in a payment line."""
    lines = payment_items(real_payments(src, cfg).where(_old(cfg)))
    named = lines.withColumn("subject_id", C.keyword_class(F.col("text"), vocab.PAYMENT_KEYWORDS))
    dated = named.withColumn("moment", F.to_date("moment"))
    first = first_per_key(dated, ["client_id", "subject_id"], ["moment", "id", "text"])
    return first.select("client_id", "subject_id", "moment", "amount")


def purchases_after(
    src: FunnelSources,
    cfg: FunnelConfig,
    work: Workspace | None = None,
    payments: DataFrame | None = None,
    lessons: DataFrame | None = None,
) -> DataFrame:
    """New era: payments followed by a first paid lesson, or the client's first ever.

    The first payments and first paid lessons of all clients come from stored states
    where these are given, else from all history.
    """
    paid = paid_payments(src, cfg)
    # group sizes come from the raw table, without the join above
    hot = find_hot(src.payments, ["client_id"], cfg.hot_rows, work)
    new = next_event(
        paid.where("has_package").where(~_old(cfg)), ["client_id"], "moment", ["id"], "next_moment", hot=hot, work=work
    )
    if payments is None:
        first_ever = first_seen(paid, ["client_id"], "moment", "first_moment")
    else:
        first_ever = payments.select("client_id", F.col("moment").alias("first_moment"))
    dated = (
        new.join(first_ever, "client_id", "left")
        .withColumn("is_first", F.to_date("first_moment") == F.to_date("moment"))
        .withColumn("moment", F.to_date("moment"))
    )
    by = ["grade_kind", "subject_id", "client_id"]
    if lessons is None:
        first_lessons = first_seen(paid_lessons(src, cfg).withColumnRenamed("student_id", "client_id"), by, "time_start")
    else:
        first_lessons = lessons.select(*by, "time_start")
    end = (F.col("moment") + F.expr(cfg.horizon) + F.expr(cfg.horizon_extra)).cast("timestamp")
    followed = followed_by(
        dated, first_lessons, "client_id", "moment", "time_start", end, "next_moment", cfg.open_end, "is_first", hot, work=work
    )
    product = C.pair_label(F.col("subject_id"), F.col("grade_kind"), vocab.PRODUCTS_BY_ID)
    return followed.select(
        "client_id", F.col("id").alias("payment_id"), "amount", "moment", "subject_id", product.alias("subject_name_rev")
    ).distinct()


def first_purchase_two_eras(
    src: FunnelSources, cfg: FunnelConfig, payments: DataFrame | None = None, lessons: DataFrame | None = None
) -> DataFrame:
    """Purchases of both eras per client; amount and payment exist for the new era only."""
    before = purchases_before(src, cfg).select("client_id", "subject_id", F.col("moment").alias("first_purchase"))
    after = purchases_after(src, cfg, payments=payments, lessons=lessons).withColumnRenamed("moment", "first_purchase")
    return before.withColumn("era", F.lit("before")).unionByName(
        after.withColumn("era", F.lit("after")), allowMissingColumns=True
    )


def all_payments(src: FunnelSources, cfg: FunnelConfig) -> DataFrame:
    """Old-era payment lines for lessons, with a paid or cancelled order."""
    lines = payment_items(real_payments(src, cfg).where(_old(cfg)))
    wanted = lines.where(
        ~F.col("text").startswith(vocab.TRIAL_TEXT_PREFIX)
        & C.any_of(F.col("text").contains(w) for w in vocab.PAID_TEXT_WORDS)
    )
    states = order_states(src.orders).where("paid_or_cancelled").select(F.col("payment_id").alias("id"))
    return wanted.join(states, "id", "left_semi").select(
        "client_id",
        "moment",
        C.keyword_class(F.col("text"), vocab.PAYMENT_KEYWORDS_PAID).alias("subject_id"),
        "amount",
    )
