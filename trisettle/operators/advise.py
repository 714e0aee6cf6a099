"""What to do about a finding: one sentence for each category, filled from its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trisettle.config import DEFAULT, Config
from trisettle.functions.money import fmt_inr
from trisettle.functions.scoring import deadline


def facts(findings: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each finding (``findings``: finding, event_id, category, amount_paise, and where known
    residual_paise, gross_paise, rules_reason, expected_on) with what its rows say. Counts and extremes only, so a
    finding of very many rows is not gathered."""
    known = [c for c in ("residual_paise", "gross_paise", "rules_reason", "expected_on") if c in findings.columns]
    own = events.select("event_id", "source", F.col("amount_paise").alias("row_paise"), "txn_date", "utr", "order_id", "counterparty")
    rows = findings.select("finding", "event_id", "category", "amount_paise", *known).join(own, "event_id", "left")
    ledger = F.col("source") == "ledger"
    out = rows.groupBy("finding", "category").agg(
        F.min("amount_paise").alias("amount_paise"), *[F.min(c).alias(c) for c in known], F.min(F.struct("event_id", "txn_date", "utr", "order_id", "counterparty")).alias("first"),
        F.max(F.struct(F.abs("row_paise").alias("size"), "event_id", "txn_date")).alias("largest"), F.count_if(ledger).alias("n_ledger"), F.count("*").alias("n_rows"), F.min(F.when(ledger, F.col("event_id"))).alias("keep"),
        F.max(F.when(ledger, F.struct("event_id", "txn_date"))).alias("reverse"), F.min("order_id").alias("order_low"), F.max("order_id").alias("order_high"))
    missing = {"residual_paise": F.col("amount_paise"), "gross_paise": F.lit(None).cast("long"), "rules_reason": F.lit(None).cast("string"), "expected_on": F.lit(None).cast("date")}
    return out.withColumns({c: v for c, v in missing.items() if c not in known})


def advice(cfg: Config = DEFAULT) -> Column:
    """The sentence for a row of ``facts``."""
    amount, day = fmt_inr(F.col("amount_paise")), F.coalesce(F.col("first.txn_date").cast("string"), F.lit("an unknown day"))
    order = F.coalesce("order_low", F.lit("its order"))
    due = deadline(F.col("category"), F.col("first.txn_date"), F.lit(None).cast("date"), cfg).cast("string")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    two = (F.col("residual_paise") == 0) & F.col("order_low").isNotNull() & (F.col("order_low") != F.col("order_high"))
    legs = F.when(F.col("n_ledger") > 0, F.col("n_ledger")).otherwise(F.col("n_rows")).cast("string")
    by_category = {
        "duplicate_ledger_entry": F.when(F.col("n_ledger") == 2, say("Reverse ", F.col("reverse.event_id"), " of ", F.col("reverse.txn_date").cast("string"), ": it books ", amount, " a second time after ", F.col("keep"), "."))
        .otherwise(say("Find out which of ", legs, " rows books ", amount, "; the others are to be reversed.")),
        "chargeback_unrecorded": say("Book the chargeback of ", amount, " for ", order, " (", F.col("first.event_id"), ") and contest it by ", F.coalesce(due, F.lit("the end of the window")), "."),
        "missing_in_bank": say(amount, " of ", day, " (reference ", F.coalesce("first.utr", F.lit("none")), ") is not in the bank; ask the gateway if it is not there by ", F.coalesce(due, F.lit("the usual time")), "."),
        "missing_in_gateway": say("Find the settlement behind the credit of ", amount, " on ", day, ", or book it as paid directly by ", F.coalesce("first.counterparty", F.lit("an unknown party")), "."),
        "missing_in_ledger": say("Book a receipt of ", amount, " on ", F.coalesce(F.col("largest.txn_date").cast("string"), F.lit("the day it settled")), ": gateway and bank agree on it."),
        "partial_refund": say("Check the refund of ", amount, " for ", order, "; what remains of the sale stays revenue."),
        "nach_batch_unexploded": say("Book the mandate batch of ", amount, " on ", day, " as one sum; the statement does not name its mandates."),
        "timing_lag": say("Nothing to do: ", amount, " should arrive ", F.coalesce(F.concat(F.lit("by "), F.col("expected_on").cast("string")), F.lit("soon")), " and is looked up again."),
        "ambiguous_multi_candidate": F.when(two, say("The cash is settled; say whether ", F.col("order_low"), " or ", F.col("order_high"), " is the payment of ", amount, " on ", day, ", and name orders in vouchers from now on."))
        .otherwise(say("Say which candidate ", amount, " of ", day, " belongs to before either side closes.")),
        "reference_truncated": say("Compare ", amount, " of ", day, " by hand; the bank cut its reference."),
        "amount_variance": F.coalesce(F.col("rules_reason"), say("Check the difference of ", amount, F.coalesce(F.concat(F.lit(" against "), fmt_inr(F.col("gross_paise")), F.lit(" gross")), F.lit("")), "; no rule explains all of it.")),
    }
    out = say("Look at ", amount, " of ", day, " by hand; it fits no category.")
    for name, text in by_category.items():
        out = F.when(F.col("category") == name, text).otherwise(out)
    return out
