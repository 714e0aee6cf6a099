"""The life of a rulebook, as snapshots: every function returns the whole table after the change, nothing is updated.

A row is one version of a rule: rule_set, rule_id, version, status (draft, active, retired), date_from, date_to, hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNNABLE = ("active",)
KEY = ["rule_set", "rule_id"]


def successors(rules: DataFrame, start: str) -> DataFrame:
    """For each rule its next version and whether a successor may start at ``start``: only after the live one's start."""
    live = F.max(F.when(F.col("status") == "active", F.col("date_from")))
    return rules.groupBy(*KEY).agg((F.max("version") + 1).alias("next_version"), live.alias("live_from")).withColumn(
        "accepted", F.coalesce(F.lit(start).cast("date") > F.col("live_from"), F.lit(True)))


def imported(rules: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """The rulebook after an import: active rules of the imported sets end today, imported ones follow as active with
    the next version of their rule. Other sets stay as they are. ``new``: rule_set, rule_id, hash, each rule once."""
    day = F.lit(today).cast("date")
    sets = new.select("rule_set").distinct().withColumn("_replaced", F.lit(True))
    old = rules.join(sets, "rule_set", "left")
    ends = F.coalesce(F.col("_replaced") & (F.col("status") == "active"), F.lit(False))
    old = old.withColumn("date_to", F.when(ends, day).otherwise(F.col("date_to"))).withColumn("status", F.when(ends, "retired").otherwise(F.col("status")))
    last = rules.groupBy(*KEY).agg(F.max("version").alias("_last"))
    added = new.join(last, KEY, "left").select(*KEY, (F.coalesce("_last", F.lit(0)) + 1).alias("version"), F.lit("active").alias("status"), day.alias("date_from"), F.lit(None).cast("date").alias("date_to"), "hash")
    return old.select(*added.columns).unionByName(added)


def withdrawn(rules: DataFrame, asked: Column) -> DataFrame:
    """What becomes of each version that is asked to go: drafts are deleted, active ones retired, others refused."""
    outcome = F.when(F.col("status") == "draft", "deleted").when(F.col("status") == "active", "retired").otherwise("refused")
    return rules.filter(asked).select(*KEY, "version", outcome.alias("outcome"))


def resolved(rules: DataFrame, rule_set: int | None = None, none: bool = False) -> DataFrame:
    """The versions that a run uses: runnable ones, of one set if it is named, or explicitly none."""
    runnable = rules.filter(F.col("status").isin(*RUNNABLE))
    if none:
        return runnable.filter(F.lit(False))
    return runnable if rule_set is None else runnable.filter(F.col("rule_set") == rule_set)


def altered(before: DataFrame, after: DataFrame) -> DataFrame:
    """Versions that were once active and changed their meaning or went missing: the log of rules only grows."""
    fixed = before.filter(F.col("status") != "draft").select(*KEY, "version", F.col("hash").alias("was"))
    rows = fixed.join(after.select(*KEY, "version", F.col("hash").alias("now")), [*KEY, "version"], "left")
    return rows.filter(~F.col("was").eqNullSafe(F.col("now"))).withColumn("fault", F.when(F.col("now").isNull(), "missing").otherwise("changed"))


def soft_deleted(runs: DataFrame, asked: Column) -> DataFrame:
    """Runs with the asked ones marked as deleted; no row goes."""
    return runs.withColumn("status", F.when(asked, "deleted").otherwise(F.col("status")))
