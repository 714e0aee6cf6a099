"""Rules drafted from what people decided: three findings of one shape, resolved alike, that no live rule covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trisettle.functions.scoring import NEVER_AUTO, amount_band, gap_shape
from trisettle.operators.shared import settled

THRESHOLD = 3
#: Below the threshold of automatic closing: a draft closes nothing by itself.
DRAFT_CONFIDENCE = "0.90"
DRAFT_PRIORITY = 50
# Rails that a rule's scope may name.
RAILS = ("neft", "rtgs", "imps", "upi", "nach", "ach", "cheque")
ANY = "*"


def covered(history: DataFrame, live: DataFrame) -> DataFrame:
    """exception_id of every resolution that a live rule speaks to. ``live``: counterparty, rail, date_from, date_to,
    null: any. Clauses that a rule leaves out are looked up as such, so this is an equi-join."""
    either = lambda c: F.array_distinct(F.array(F.coalesce(c, F.lit(ANY)), F.lit(ANY)))
    asked = history.select("exception_id", "on_date", "rail", F.explode(either("counterparty")).alias("party_key")).select("exception_id", "on_date", "party_key", F.explode(either("rail")).alias("rail_key"))
    rules = live.select(F.coalesce("counterparty", F.lit(ANY)).alias("party_key"), F.coalesce("rail", F.lit(ANY)).alias("rail_key"), "date_from", "date_to")
    in_force = (F.col("date_from").isNull() | (F.col("on_date") >= F.col("date_from"))) & (F.col("date_to").isNull() | (F.col("on_date") <= F.col("date_to")))
    return asked.join(rules, ["party_key", "rail_key"]).filter(in_force).select("exception_id").distinct()


def drafts(history: DataFrame, live: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One draft for each shape that was resolved alike ``threshold`` times, unless live rules cover all its cases.

    ``history``: exception_id, category, resolution_category, counterparty, rail, source, amount_paise, gap_paise,
    gross_paise, on_date. Categories that never close by themselves, and cases without a gap or a gross, teach nothing.
    The rate is the lower median of gap over gross in percent to two places (rates are rounded first, which the median
    of ordered values allows, so a shape has few of them); the tolerance is the widest miss that the rate leaves."""
    cases = history.filter(~F.col("category").isin(*NEVER_AUTO) & (F.col("gap_paise") != 0) & (F.col("gross_paise") != 0))
    shape = F.sha2(F.concat_ws("\x1f", "category", F.coalesce("counterparty", F.lit("-")), F.coalesce("rail", F.lit("-")), amount_band(F.col("amount_paise")), gap_shape(F.col("gap_paise"), F.col("gross_paise"))), 256)
    rate = F.round(F.abs("gap_paise").cast("decimal(20,0)") * 100 / F.abs("gross_paise").cast("decimal(20,0)"), 2).cast("decimal(12,2)")
    cases = cases.join(covered(cases, live).withColumn("covered", F.lit(True)), "exception_id", "left").withColumns({"signature": shape, "rate": rate})
    key = ["signature", "resolution_category"]
    cases = settled(cases, "learner-cases")
    groups = cases.groupBy(*key).agg(F.count("*").alias("occurrences"), F.bool_and(F.coalesce("covered", F.lit(False))).alias("known"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rate)").cast("decimal(12,2)").alias("rate_percent"),
                                     F.min_by(F.struct("counterparty", "rail", "source"), "exception_id").alias("anchor"), F.min("on_date").alias("effective_from"), F.min("exception_id").alias("first_exception"))
    kept = groups.filter((F.col("occurrences") >= threshold) & ~F.col("known"))
    explained = F.round(F.abs("gross_paise").cast("decimal(20,0)") * F.col("rate_percent") / 100, 0).cast("long")
    worst = cases.join(kept.select(*key, "rate_percent"), key).groupBy(*key).agg(F.max(F.abs(F.abs("gap_paise") - explained)).alias("tolerance_paise"))
    return kept.join(worst, key).select(
        F.concat(F.lit("learned_"), "resolution_category", F.lit("_"), F.substring("signature", 1, 12)).alias("rule_id"), *key, "occurrences", "rate_percent", "tolerance_paise", F.col("anchor.counterparty").alias("counterparty"), F.col("anchor.source").alias("source"),
        F.when(F.col("anchor.rail").isin(*RAILS), F.col("anchor.rail")).alias("rail"), "effective_from", "first_exception", F.lit(DRAFT_CONFIDENCE).cast("decimal(5,4)").alias("effective_confidence"), F.lit(DRAFT_PRIORITY).alias("priority"), F.lit("draft").alias("status"), F.lit("learned").alias("origin"))
