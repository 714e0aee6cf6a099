"""The exception queue: findings, tiers, deadlines, priorities, clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trisettle.config import DEFAULT, Config
from trisettle.functions import scoring
from trisettle.operators import settlements


def findings(gateway: DataFrame, bank: DataFrame, ledger: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Ordered steps; an event that an earlier step reported is silent in later ones.

    1. settlements whose bank credit is missing; 2. credits that name a settlement and are short or over; 3. credits
    without a ledger row; 4. repeated ledger rows; 5. held gateway rows.
    """
    sums = settlements.arithmetic(gateway)
    claimed = settlements.named(bank, gateway).filter("settlement_id is not null").select("settlement_id", "event_id", "amount_paise", "txn_date")
    missing = sums.join(claimed, "settlement_id", "left_anti").select(F.lit(1).alias("step"), F.lit("missing_in_bank").alias("category"), F.col("settlement_id").alias("subject"), F.col("expected_net_paise").alias("amount_paise"), F.col("expected_net_paise").alias("gap_paise"), F.col("gross_paise"), F.col("first_date").alias("on_date"))
    delta = F.col("amount_paise") - F.col("expected_net_paise")
    variance = claimed.join(sums, "settlement_id").filter(F.abs(delta) > scoring.tolerance(F.col("expected_net_paise"), F.col("n_txns"), cfg)).select(F.lit(2), F.lit("amount_variance"), "settlement_id", F.col("amount_paise"), F.abs(delta), F.col("gross_paise"), F.col("txn_date"))
    books = settlements.named(ledger, gateway).filter("settlement_id is not null")
    booked = books.select("settlement_id").distinct()
    unbooked = claimed.join(booked, "settlement_id", "left_anti").select(F.lit(3), F.lit("missing_in_ledger"), "settlement_id", F.col("amount_paise"), F.col("amount_paise"), F.col("amount_paise"), F.col("txn_date"))
    twice = books.groupBy("settlement_id").agg(F.count("*").alias("n"), F.min("amount_paise").alias("amount_paise"), F.min("txn_date").alias("txn_date")).filter("n > 1").select(F.lit(4), F.lit("duplicate_ledger_entry"), F.col("settlement_id"), F.col("amount_paise"), F.col("amount_paise"), F.col("amount_paise"), F.col("txn_date"))
    held = gateway.filter("on_hold").groupBy("settlement_id").agg(F.sum("amount_paise").alias("amount_paise"), F.min("txn_date").alias("txn_date")).select(F.lit(5), F.lit("revenue_booked_not_settled"), "settlement_id", F.col("amount_paise"), F.col("amount_paise"), F.col("amount_paise"), F.col("txn_date"))
    every = missing
    for step in (variance, unbooked, twice, held):
        every = every.union(step)
    first = every.groupBy("subject").agg(F.min(F.struct("step", "category", "amount_paise", "gap_paise", "gross_paise", "on_date")).alias("x"))
    return first.select("subject", "x.category", "x.amount_paise", "x.gap_paise", "x.gross_paise", "x.on_date")


def queue(found: DataFrame, today: str, cfg: Config = DEFAULT) -> DataFrame:
    """Findings with confidence, tier, status, deadline, cluster, priority and action group."""
    now = F.lit(today).cast("date")
    conf = F.when(F.col("category") == "amount_variance", F.lit("0.97")).when(F.col("category") == "missing_in_bank", F.lit("0.90")).otherwise(F.lit("1.0")).cast("decimal(5,4)")
    rows = found.withColumn("confidence", conf)
    rows = rows.withColumn("explained", F.col("gap_paise") * 100 <= F.col("gross_paise"))
    rows = rows.withColumn("tier", scoring.tier(F.col("category"), F.col("confidence"), F.col("explained"), F.lit(False), cfg))
    rows = rows.withColumn("status", scoring.birth_status(F.col("tier"))).withColumn("deadline", scoring.deadline(F.col("category"), F.col("on_date"), F.lit(None).cast("date"), cfg))
    rows = rows.withColumn("cluster_key", F.concat_ws("|", "category", scoring.gap_shape(F.col("gap_paise"), F.col("gross_paise")), scoring.amount_band(F.col("amount_paise"))))
    sizes = rows.groupBy("cluster_key").agg(F.count("*").alias("cluster_size"))
    rows = rows.join(sizes, "cluster_key")
    rows = rows.withColumn("urgency", scoring.urgency(F.col("deadline"), now))
    return rows.withColumn("priority", scoring.priority(F.col("amount_paise"), F.col("tier"), F.col("confidence"), F.col("urgency"), F.col("cluster_size"))).withColumn(
        "action_group", scoring.action_group(F.col("category"), F.col("tier"), F.col("deadline"), F.lit(None).cast("date"), now))


def clusters(rows: DataFrame, least: int = 2) -> DataFrame:
    """Groups of two or more exceptions of one key: count, total, the strictest tier."""
    rank = F.when(F.col("tier") == "escalate", 2).when(F.col("tier") == "monitor", 1).otherwise(0)
    return rows.groupBy("cluster_key").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("total_paise"), F.max_by("tier", rank).alias("tier")).filter(F.col("n") >= least)


def page(rows: DataFrame, value: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """The next ``size`` rows by (value, key) descending, with one more to tell whether another page follows."""
    if after is not None:
        rows = rows.filter((F.col(value) < F.lit(after[0])) | ((F.col(value) == F.lit(after[0])) & (F.col(key) < F.lit(after[1]))))
    return rows.orderBy(F.desc(value), F.desc(key)).limit(size + 1)


def changed(before: DataFrame, after: DataFrame, key: str = "subject") -> DataFrame:
    """Exceptions of two runs: added, removed, changed or unchanged."""
    a = before.select(F.col(key).alias("subject"), F.struct("category", "gap_paise").alias("a"))
    b = after.select(F.col(key).alias("subject"), F.struct("category", "gap_paise").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return a.join(b, "subject", "full_outer").select("subject", change.alias("change"), F.col("a.gap_paise").alias("gap_before"), F.col("b.gap_paise").alias("gap_after"))


def transitions(rows: DataFrame, today: str, matched: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Recheck of monitored and snoozed exceptions: resolved if matched now, a snooze opens, else counted; the third
    count escalates, others come up again two days later. New snapshots, nothing is updated in place."""
    due = F.col("status").isin("monitoring", "snoozed") & (F.col("recheck_on") <= F.lit(today).cast("date"))
    hit = matched.select("subject", F.lit(True).alias("hit")).distinct()
    rows = rows.join(hit, "subject", "left")
    count = F.col("rechecks") + 1
    status = F.when(~due, F.col("status")).when(F.col("hit"), "resolved").when(F.col("status") == "snoozed", "open").when(count >= cfg.max_rechecks, "escalated").otherwise("monitoring")
    waiting = due & F.col("hit").isNull() & (F.col("status") == "monitoring")
    return rows.select("subject", status.alias("status"), F.when(waiting, count).otherwise(F.col("rechecks")).alias("rechecks"),
                       F.when(waiting & (count < cfg.max_rechecks), F.date_add("recheck_on", cfg.recheck_interval_days)).otherwise(F.col("recheck_on")).alias("recheck_on"))


def linked(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """What is left of each gap after a linked amount, and whether that is enough for an exception of its own."""
    residual = F.abs(F.col("gap_paise") - F.col("linked_paise"))
    return rows.withColumn("residual_paise", residual).withColumn("child", residual > cfg.tolerance_abs_paise)


def first_of(rows: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def smallest(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """kind, value: the ``k`` smallest different values of each column, the smallest, then the smallest above it, and so
    on. Minima of whole columns only, so nothing is sorted or made distinct and one row is broadcast. ``rows`` are read
    ``k`` times and should be a written table."""
    low = rows.agg(*[F.min(c).alias(c) for c in columns])
    found = [low]
    for _ in range(k - 1):
        above = rows.join(F.broadcast(low.select(*[F.col(c).alias(f"_{c}") for c in columns])))
        low = above.agg(*[F.min(F.when(F.col(c) > F.col(f"_{c}"), F.col(c))).alias(c) for c in columns])
        found.append(low)
    return reduce(DataFrame.unionByName, found).unpivot([], columns, "kind", "value").filter("value is not null")
