"""Order lifecycle: first creation wins, last payment and cancellation win, data-quality flags, status, orphans.

``enrich`` is the production form: the three event streams are joined by one aggregation over their union, so each
row is shuffled once, on order_id, after partial aggregation. It has two halves: ``facts`` of events, which can be merged with
facts of other events of the same orders, and ``finish``, which makes orders of them; so an incremental run needs the new
events and the kept facts of their orders, not the orders' history. ``enrich_windowed`` states the same with windows and joins
and is kept to check it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ORDER = ("kafka_load_dttm", "kafka_partition", "kafka_offset", "raw_id")
FLAGS = (
    "dq_multiple_payments_flg",
    "dq_multiple_cancellations_flg",
    "dq_payment_amount_mismatch_flg",
    "dq_payment_currency_mismatch_flg",
    "dq_payment_before_creation_flg",
    "dq_cancellation_before_creation_flg",
    "dq_payment_after_cancellation_flg",
)
COLUMNS = (
    "order_id", "customer_id", "source_channel", "order_amount", "currency", "created_at", "status", "payment_id", "paid_amount", "payment_currency", "paid_at",
    "cancellation_id", "cancellation_reason", "cancelled_at", "payments_cnt", "cancellations_cnt", "duplicate_created_events_cnt", *FLAGS,
    "max_created_raw_id", "max_paid_raw_id", "max_cancelled_raw_id",
)


def order_status(cancelled: Column, paid: Column) -> Column:
    """Cancellation wins over payment."""
    return F.when(cancelled.isNotNull(), "cancelled").when(paid.isNotNull(), "paid").otherwise("created")


def dq_any() -> Column:
    """Any data-quality flag, or a duplicate creation."""
    return reduce(lambda a, b: a | b, [F.col(f) for f in FLAGS]) | (F.col("duplicate_created_events_cnt") > 0)


def _event(df: DataFrame, at: str, *attributes: str) -> Column:
    return F.struct(F.col(at).alias("at"), *ORDER, *attributes)


def union_events(created: DataFrame, paid: DataFrame, cancelled: DataFrame) -> DataFrame:
    """order_id, event_type, event_at and coordinates of all events."""
    parts = [df.select("order_id", F.lit(kind).alias("event_type"), F.col(at).alias("event_at"), "raw_id", "kafka_load_dttm") for df, kind, at in ((created, "created", "created_at"), (paid, "paid", "paid_at"), (cancelled, "cancelled", "cancelled_at"))]
    return reduce(DataFrame.unionByName, parts)


#: How each fact of two sets of events is made of theirs: facts of all events are facts of the facts of their parts.
FACTS = {
    "c": F.min, "c_n": F.sum, "c_raw": F.max, "p": F.max, "p_n": F.sum, "p_raw": F.max, "p_first": F.min, "low": F.min, "high": F.max,
    "low_currency": F.min, "high_currency": F.max, "x": F.max, "x_n": F.sum, "x_raw": F.max, "x_first": F.min,
}


#: Events that one task of a step gathers by order: an upsert of 300 times the events of sf0.1 took 594 MB of a task at most.
EVENTS_A_TASK = 200_000


def tasks_for(*sources: DataFrame) -> int:
    """The number of tasks that orders of these events are dealt to: one row is collected."""
    rows = reduce(DataFrame.union, [df.agg(F.count("*").alias("rows")) for df in sources]).agg(F.sum("rows")).first()[0]
    return max(1, -(-rows // EVENTS_A_TASK))


def facts(created: DataFrame, paid: DataFrame, cancelled: DataFrame, keys: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """One row an order with any event: its first creation, last payment and last cancellation, and counts and bounds.

    Of the orders of ``keys`` only, where given. With ``tasks`` the events, and all that is joined to their orders with the
    same number, are dealt to so many tasks by order_id once, and each task's memory is bounded by its events."""
    c = created.select("order_id", _event(created, "created_at", "customer_id", "source_channel", "amount", "currency").alias("c"))
    p = paid.select("order_id", _event(paid, "paid_at", "payment_id", "paid_amount", "currency").alias("p"))
    x = cancelled.select("order_id", _event(cancelled, "cancelled_at", "cancellation_id", "cancellation_reason").alias("x"))
    one = c.unionByName(p, allowMissingColumns=True).unionByName(x, allowMissingColumns=True)
    if tasks:
        one = one.repartition(tasks, "order_id")
    if keys is not None:
        one = one.join(keys.repartition(tasks, "order_id") if tasks else keys, "order_id", "left_semi")
    # min and max of one attribute say whether any payment differs from the first creation
    return one.groupBy("order_id").agg(
        F.min("c").alias("c"),
        F.count("c").alias("c_n"),
        F.max("c.raw_id").alias("c_raw"),
        F.max("p").alias("p"),
        F.count("p").alias("p_n"),
        F.max("p.raw_id").alias("p_raw"),
        F.min("p.at").alias("p_first"),
        F.min("p.paid_amount").alias("low"),
        F.max("p.paid_amount").alias("high"),
        F.min("p.currency").alias("low_currency"),
        F.max("p.currency").alias("high_currency"),
        F.max("x").alias("x"),
        F.count("x").alias("x_n"),
        F.max("x.raw_id").alias("x_raw"),
        F.min("x.at").alias("x_first"),
    )


def merge_facts(*parts: DataFrame) -> DataFrame:
    """Facts of the events that the parts were made of; no event may be in two parts."""
    return reduce(DataFrame.unionByName, parts).groupBy("order_id").agg(*[g(n).alias(n) for n, g in FACTS.items()])


def finish(known: DataFrame) -> DataFrame:
    """Orders out of facts: one row an order that was created."""
    no = F.lit(False)
    return known.where("c_n > 0").select(
        "order_id",
        "c.customer_id",
        "c.source_channel",
        F.col("c.amount").alias("order_amount"),
        "c.currency",
        F.col("c.at").alias("created_at"),
        order_status(F.col("x.cancellation_id"), F.col("p.payment_id")).alias("status"),
        "p.payment_id",
        "p.paid_amount",
        F.col("p.currency").alias("payment_currency"),
        F.col("p.at").alias("paid_at"),
        "x.cancellation_id",
        "x.cancellation_reason",
        F.col("x.at").alias("cancelled_at"),
        F.col("p_n").cast("int").alias("payments_cnt"),
        F.col("x_n").cast("int").alias("cancellations_cnt"),
        (F.col("c_n") - 1).cast("int").alias("duplicate_created_events_cnt"),
        (F.col("p_n") > 1).alias(FLAGS[0]),
        (F.col("x_n") > 1).alias(FLAGS[1]),
        F.coalesce((F.col("low") != F.col("c.amount")) | (F.col("high") != F.col("c.amount")), no).alias(FLAGS[2]),
        F.coalesce((F.col("low_currency") != F.col("c.currency")) | (F.col("high_currency") != F.col("c.currency")), no).alias(FLAGS[3]),
        F.coalesce(F.col("p_first") < F.col("c.at"), no).alias(FLAGS[4]),
        F.coalesce(F.col("x_first") < F.col("c.at"), no).alias(FLAGS[5]),
        F.coalesce(F.col("p.at") > F.col("x_first"), no).alias(FLAGS[6]),
        F.col("c_raw").alias("max_created_raw_id"),
        F.coalesce("p_raw", F.lit(0).cast("long")).alias("max_paid_raw_id"),
        F.coalesce("x_raw", F.lit(0).cast("long")).alias("max_cancelled_raw_id"),
    )


def unfounded(known: DataFrame) -> DataFrame:
    """Orphans out of facts: payments and cancellations of orders that were not created."""
    return known.where("c_n = 0").select(
        "order_id",
        F.col("p_n").cast("int").alias("payments_cnt"),
        F.col("x_n").cast("int").alias("cancellations_cnt"),
        F.least("p_first", "x_first").alias("first_event_at"),
        F.greatest("p.at", "x.at").alias("last_event_at"),
    )


def enrich(created: DataFrame, paid: DataFrame, cancelled: DataFrame, keys: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """One row an order that was created. Payments and cancellations of others count for nothing here."""
    return finish(facts(created, paid, cancelled, keys, tasks))


def ranked(df: DataFrame, at: str, newest: bool) -> DataFrame:
    """Row number of an order's events by time and coordinates, their count and greatest raw_id."""
    own = W.partitionBy("order_id")
    keys = [F.col(c).desc() if newest else F.col(c).asc() for c in (at, *ORDER)]
    return df.withColumn("rn", F.row_number().over(own.orderBy(*keys))).withColumn("cnt", F.count("*").over(own)).withColumn("max_raw_id", F.max("raw_id").over(own))


def enrich_windowed(created: DataFrame, paid: DataFrame, cancelled: DataFrame) -> DataFrame:
    """The same rows as enrich(), by windows and joins."""
    own = W.partitionBy("order_id")
    first = ranked(created, "created_at", False).where("rn = 1").select("order_id", "customer_id", "source_channel", F.col("amount").alias("order_amount"), "currency", "created_at", F.col("cnt").alias("c_n"), F.col("max_raw_id").alias("max_created_raw_id"))
    base = first.select("order_id", F.col("order_amount").alias("o_amount"), F.col("currency").alias("o_currency"), F.col("created_at").alias("o_at"))
    p = ranked(paid.join(base, "order_id"), "paid_at", True)
    p = (
        p.withColumn("f_amount", F.bool_or(F.col("paid_amount") != F.col("o_amount")).over(own))
        .withColumn("f_currency", F.bool_or(F.col("currency") != F.col("o_currency")).over(own))
        .withColumn("f_early", F.bool_or(F.col("paid_at") < F.col("o_at")).over(own))
        .where("rn = 1")
        .select("order_id", "payment_id", "paid_amount", F.col("currency").alias("payment_currency"), "paid_at", F.col("cnt").alias("p_n"), F.col("max_raw_id").alias("p_raw"), "f_amount", "f_currency", "f_early")
    )
    x = ranked(cancelled.join(base, "order_id"), "cancelled_at", True)
    x = (
        x.withColumn("x_first", F.min("cancelled_at").over(own))
        .withColumn("x_early", F.bool_or(F.col("cancelled_at") < F.col("o_at")).over(own))
        .where("rn = 1")
        .select("order_id", "cancellation_id", "cancellation_reason", "cancelled_at", F.col("cnt").alias("x_n"), F.col("max_raw_id").alias("x_raw"), "x_first", "x_early")
    )
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return (
        first.join(p, "order_id", "left")
        .join(x, "order_id", "left")
        .select(
            "*",
            order_status(F.col("cancellation_id"), F.col("payment_id")).alias("status"),
            F.coalesce("p_n", zero).cast("int").alias("payments_cnt"),
            F.coalesce("x_n", zero).cast("int").alias("cancellations_cnt"),
            (F.col("c_n") - 1).cast("int").alias("duplicate_created_events_cnt"),
            F.coalesce(F.col("p_n") > 1, no).alias(FLAGS[0]),
            F.coalesce(F.col("x_n") > 1, no).alias(FLAGS[1]),
            F.coalesce("f_amount", no).alias(FLAGS[2]),
            F.coalesce("f_currency", no).alias(FLAGS[3]),
            F.coalesce("f_early", no).alias(FLAGS[4]),
            F.coalesce("x_early", no).alias(FLAGS[5]),
            F.coalesce(F.col("paid_at") > F.col("x_first"), no).alias(FLAGS[6]),
            F.coalesce("p_raw", zero).alias("max_paid_raw_id"),
            F.coalesce("x_raw", zero).alias("max_cancelled_raw_id"),
        )
        .select(*COLUMNS)
    )


def orphans(created: DataFrame, paid: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Orders with payments or cancellations but no creation."""
    events = union_events(created.limit(0), paid, cancelled).join(created.select("order_id"), "order_id", "left_anti")
    return events.groupBy("order_id").agg(
        F.count_if(F.col("event_type") == "paid").cast("int").alias("payments_cnt"),
        F.count_if(F.col("event_type") == "cancelled").cast("int").alias("cancellations_cnt"),
        F.min("event_at").alias("first_event_at"),
        F.max("event_at").alias("last_event_at"),
    )
