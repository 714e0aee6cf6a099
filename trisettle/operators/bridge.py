"""From gross sales to the money in the bank: segments, each of rows that add up to it, and what explains the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Segments in order and how they count towards the net that the bank should have credited.
SEGMENTS = {"gross": 1, "mdr": -1, "gst": -1, "refunds": -1, "chargebacks": -1, "reserve": -1, "reserve_release": 1, "other_charges": -1, "other_credits": 1}
#: The gst within a fee, as the sources state it, is this many times too large.
TAX_UNIT = 118
#: Findings that say where money is, nearest to proof first; the rest is shared out in this order.
EXPLAINS = ("timing_lag", "missing_in_bank", "amount_variance", "reference_truncated", "ambiguous_multi_candidate", "missing_in_gateway", "partial_refund")


def detail(gateway: DataFrame) -> DataFrame:
    """segment, event_id, amount_paise of every gateway row: a payment states its gross, what was kept of it and the tax
    within; held payments stand apart as ``held``. Every row is in a segment, so none can be left out of the sum."""
    credit, debit = F.col("direction") == "credit", F.col("direction") == "debit"
    kind, amount = F.coalesce("txn_type", F.lit("")), F.col("amount_paise")
    fee, tax = F.coalesce("fee_paise", F.lit(0)), F.floor(F.coalesce("tax_raw", F.lit(0)) / TAX_UNIT).cast("long")
    part = lambda name, value: F.struct(F.lit(name).alias("segment"), value.cast("long").alias("amount_paise"))
    payment = F.when(F.col("on_hold"), F.array(part("held", amount + fee))).otherwise(F.array(part("gross", amount + fee), part("mdr", fee - tax), part("gst", tax)))
    parts = (F.when((kind == "payment") & credit, payment).when((kind == "refund") & debit, F.array(part("refunds", amount))).when(kind == "dispute", F.array(part("chargebacks", F.when(debit, amount).otherwise(-amount))))
             .when((kind == "reserve") & debit, F.array(part("reserve", amount))).when((kind == "reserve") & credit, F.array(part("reserve_release", amount))).when(debit, F.array(part("other_charges", amount))).otherwise(F.array(part("other_credits", amount))))
    return gateway.select("event_id", F.explode(parts).alias("x")).select("x.segment", "event_id", "x.amount_paise")


def credited(events: DataFrame, members: DataFrame) -> DataFrame:
    """Bank rows that a match with a gateway row holds, as rows of the segment ``bank``; debits count against it."""
    own = ("event_id", "source", "direction", "amount_paise")
    # members that have their events' columns (``references.exact_stage``) need no join
    rows = members.select("match_id", *own).distinct() if set(own) <= set(members.columns) else members.select("match_id", "event_id").distinct().join(events.select(*own), "event_id")
    proven = rows.groupBy("match_id").agg(F.bool_or(F.col("source") == "gateway").alias("gateway")).filter("gateway").select("match_id")
    signed = F.when(F.col("direction") == "credit", F.col("amount_paise")).otherwise(-F.col("amount_paise"))
    return rows.filter("source = 'bank'").join(proven, "match_id").select(F.lit("bank").alias("segment"), "event_id", signed.alias("amount_paise"))


def bridge(events: DataFrame, members: DataFrame, findings: DataFrame) -> DataFrame:
    """line, n_rows, amount_paise: every segment, ``expected`` (what the segments leave), ``bank``, ``rest`` (expected
    less bank), then what of the rest each category of ``findings`` (finding, category, amount_paise) accounts for, in
    the order of ``EXPLAINS``, and ``unexplained``.

    A category takes no more than is left and no more than its findings are worth; nothing is taken from a rest below
    zero. So the shares and ``unexplained`` always add up to the rest, whatever rows there are."""
    rows = detail(events.filter("source = 'gateway'")).unionByName(credited(events, members))
    sums = rows.groupBy("segment").agg(F.count("*").alias("n_rows"), F.sum("amount_paise").alias("amount_paise"))
    sign = F.lit(0)
    for name, value in SEGMENTS.items():
        sign = F.when(F.col("segment") == name, value).otherwise(sign)
    total = sums.agg(F.coalesce(F.sum(sign * F.col("amount_paise")), F.lit(0)).alias("expected"), F.coalesce(F.sum(F.when(F.col("segment") == "bank", F.col("amount_paise"))), F.lit(0)).alias("bank"),
                     F.coalesce(F.sum(F.when(sign != 0, F.col("n_rows"))), F.lit(0)).alias("n")).withColumn("rest", F.col("expected") - F.col("bank"))
    worth = findings.filter(F.col("category").isin(*EXPLAINS)).groupBy("category").agg(F.count_distinct("finding").alias("n_rows"), F.sum("amount_paise").alias("worth"))
    place = F.array_position(F.array(*map(F.lit, EXPLAINS)), F.col("category"))
    order = Window.orderBy(place)  # one row for each category, so few
    ranked = worth.withColumn("before", F.sum("worth").over(order) - F.col("worth"))
    shared = ranked.join(F.broadcast(total.select("rest"))).withColumn("share", F.least(F.col("worth"), F.greatest(F.col("rest") - F.col("before"), F.lit(0))))
    lines = sums.select(F.col("segment").alias("line"), "n_rows", "amount_paise")
    facts = total.select(F.inline(F.array(*[F.struct(F.lit(k).alias("line"), F.col("n").alias("n_rows"), F.col(k).alias("amount_paise")) for k in ("expected", "rest")])))
    share = shared.select(F.concat(F.lit("explained by "), "category").alias("line"), "n_rows", F.col("share").alias("amount_paise"))
    taken = shared.agg(F.coalesce(F.sum("share"), F.lit(0)).alias("taken"))
    left = total.join(F.broadcast(taken)).select(F.lit("unexplained").alias("line"), F.lit(0).cast("long").alias("n_rows"), (F.col("rest") - F.col("taken")).alias("amount_paise"))
    return lines.unionByName(facts).unionByName(share).unionByName(left)
