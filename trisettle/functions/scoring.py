"""Tolerance, confidence, bands, tiers, priority: the scalar rules of matching and of the exception queue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trisettle.config import DEFAULT, Config

FACTOR = "decimal(38,18)"
#: Ceilings on confidence by stage; other stages have none.
STAGE_CAPS = {"fuzzy": "0.75", "rule": "0.95"}
# Exception categories by how they may close and where they go.
NEVER_AUTO = ("chargeback_unrecorded", "duplicate_ledger_entry", "ambiguous_multi_candidate", "nach_batch_unexploded", "unidentified_inflow", "unknown")
AUTO_SAFE = ("timing_lag", "amount_variance", "partial_refund", "reference_truncated")
BOOKS = ("missing_in_ledger", "duplicate_ledger_entry", "unbooked_bank_entry", "revenue_booked_not_settled", "amount_variance")
UNRESOLVABLE = ("ambiguous_multi_candidate", "reference_truncated", "nach_batch_unexploded", "unknown")
#: Days before a deadline from which it is fully urgent, and before which not at all.
URGENT_DAYS, CALM_DAYS = 2, 30


def tolerance_terms(amount: Column, n_txns: Column, cfg: Config = DEFAULT) -> Column:
    """The three terms, the largest of them, and the name that binds (absolute before percentage before drift)."""
    absolute = F.lit(cfg.tolerance_abs_paise).cast("bigint")
    percentage = F.floor(F.abs(amount).cast("decimal(20,0)") * F.lit(cfg.tolerance_pct).cast("decimal(10,8)")).cast("bigint")
    drift = (n_txns * cfg.rounding_drift_paise).cast("bigint")
    top = F.greatest(absolute, percentage, drift)
    binding = F.when(top == absolute, "absolute").when(top == percentage, "percentage").otherwise("drift")
    return F.struct(absolute.alias("absolute"), percentage.alias("percentage"), drift.alias("drift"), top.alias("tolerance"), binding.alias("binding"))


def tolerance(amount: Column, n_txns: Column, cfg: Config = DEFAULT) -> Column:
    return tolerance_terms(amount, n_txns, cfg)["tolerance"]


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0).cast(FACTOR), F.least(F.lit(1).cast(FACTOR), x.cast(FACTOR)))


def confidence(base: Column, agreed: Column, disagreed: Column, delta: Column, basis: Column, days: Column, candidates: Column,
               sources: Column, stage: Column | None = None) -> Column:
    """base x agreement x (1 - delta / basis) x (1 - 0.02 days) x 1 / candidates x 1.05 for three sources, clamped to
    [0, 1], half up to four places, then the stage's ceiling."""
    agreement = F.when(agreed + disagreed == 0, F.lit(1).cast(FACTOR)).otherwise(agreed.cast("decimal(10,0)") / (agreed + disagreed).cast("decimal(10,0)"))
    ratio = F.when(basis == 0, F.lit(0).cast(FACTOR)).otherwise(F.abs(delta).cast("decimal(20,0)") / F.abs(basis).cast("decimal(20,0)"))
    shift = unit(F.lit(1) - F.lit("0.02").cast("decimal(4,2)") * F.greatest(days, F.lit(0)).cast("decimal(10,0)"))
    ambiguity = F.lit(1).cast("decimal(10,0)") / F.greatest(candidates, F.lit(1)).cast("decimal(10,0)")
    bonus = F.when(sources >= 3, F.lit("1.05").cast("decimal(4,2)")).otherwise(F.lit("1.00").cast("decimal(4,2)"))
    raw = base.cast("decimal(6,4)").cast("double") * agreement.cast("double") * (1 - unit(ratio).cast("double")) * shift.cast("double") * ambiguity.cast("double") * bonus.cast("double")
    value = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).cast("decimal(20,12)"), 4).cast("decimal(5,4)")
    return value if stage is None else F.least(value, stage_cap(stage)).cast("decimal(5,4)")


def stage_cap(stage: Column) -> Column:
    out = F.lit("1").cast("decimal(5,4)")
    for name, cap in STAGE_CAPS.items():
        out = F.when(stage == name, F.lit(cap).cast("decimal(5,4)")).otherwise(out)
    return out


def amount_band(paise: Column) -> Column:
    size = F.abs(paise)
    return F.when(size < 100_000, "<1k").when(size < 1_000_000, "1k-10k").when(size < 10_000_000, "10k-1L").when(size < 100_000_000, "1L-10L").otherwise(">10L")


def gap_shape(gap: Column, gross: Column) -> Column:
    """The half point of gap over gross in percent that the gap lies in, as ``low-high%``; ``gross=0`` without gross."""
    halves = F.floor(F.abs(gap).cast("decimal(20,0)") * 200 / F.abs(gross).cast("decimal(20,0)")).cast("bigint")
    text = lambda h: F.concat(((h - h % 2) / 2).cast("bigint").cast("string"), F.when(h % 2 == 1, ".5").otherwise(""))
    return F.when((gross == 0) | gross.isNull(), "gross=0").otherwise(F.concat(text(halves), F.lit("-"), text(halves + 1), F.lit("%")))


def tier(category: Column, conf: Column, explained: Column, has_date: Column, cfg: Config = DEFAULT) -> Column:
    return (F.when(category.isin(*NEVER_AUTO), "escalate")
            .when((category == "amount_variance") & ~explained, "escalate")
            .when((conf >= F.lit(cfg.auto_threshold).cast("decimal(5,4)")) & category.isin(*AUTO_SAFE), "auto")
            .when((category == "timing_lag") & has_date, "monitor").otherwise("escalate"))


def birth_status(tier_: Column) -> Column:
    return F.when(tier_ == "monitor", "monitoring").when(tier_ == "auto", "resolved").otherwise("open")


def deadline(category: Column, effective: Column, settled: Column, cfg: Config = DEFAULT) -> Column:
    return (F.when(category == "chargeback_unrecorded", F.date_add(effective, cfg.dispute_window_days))
            .when(category == "missing_in_bank", F.date_add(F.coalesce(settled, effective), cfg.missing_in_bank_sla_days)))


def urgency(due: Column, today: Column) -> Column:
    """1 from two days before the deadline, falling to 0 at thirty days, 0 without one; half even to four places."""
    left = F.datediff(due, today)
    falling = F.lit(1).cast("decimal(10,6)") - (left - URGENT_DAYS).cast("decimal(10,0)") / F.lit(CALM_DAYS - URGENT_DAYS).cast("decimal(4,0)")
    return F.when(due.isNull(), 0).when(left <= URGENT_DAYS, 1).when(left >= CALM_DAYS, 0).otherwise(F.bround(falling.cast("decimal(20,12)"), 4)).cast("decimal(5,4)")


def priority(amount: Column, tier_: Column, conf: Column, urgent: Column, cluster_size: Column) -> Column:
    """0.40 log amount + 0.25 tier + 0.15 doubt + 0.15 urgency + 0.05 cluster size, at most 1, half even."""
    size = F.least(F.log10(F.abs(amount) + 1) / 9, F.lit(1.0))
    weight = F.when(tier_ == "escalate", 1.0).when(tier_ == "monitor", 0.4).otherwise(0.0)
    raw = 0.40 * size + 0.25 * weight + 0.15 * (1 - conf.cast("double")) + 0.15 * urgent.cast("double") + 0.05 * F.least(cluster_size / 20, F.lit(1.0))
    return F.bround(F.least(raw, F.lit(1.0)).cast("decimal(20,12)"), 4).cast("decimal(5,4)")


def action_group(category: Column, tier_: Column, due: Column, recheck: Column, today: Column) -> Column:
    """Where an exception waits: an arrived deadline first, then what is being rechecked, then by category."""
    return (F.when(due <= today, "act_today").when((tier_ == "monitor") | recheck.isNotNull(), "waiting").when(due.isNotNull(), "act_today")
            .when(category == "unidentified_inflow", "unidentified_inflow").when(category.isin(*UNRESOLVABLE), "cannot_resolve")
            .when(category.isin(*BOOKS), "books_fix").when(tier_ == "escalate", "act_today").otherwise("waiting"))
