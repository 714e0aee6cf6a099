"""Rule lifecycle, replay under another rulebook, classifier steps and counters of wrong closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trisettle.functions.text import sanitised
from trisettle.operators import classify, exceptions, lifecycle, rules, settlements
from trisettle.operators.shared import settled
from trisettle.plans.queue import CASES, QUEUE, TODAY, cases, queue
from trisettle.plans.records import MATCHES, named
from trisettle.sources.harness import CTES, derived, events, source

QUERIES = {}
ORACLE_SQL = {}
NEVER_AUTO = ("duplicate_ledger_entry", "chargeback_unrecorded")
#: Versions of one rule for each region, from ``nation``.
VERSIONS = """WITH v AS (SELECT n_regionkey AS rule_set, 'fee' || n_regionkey AS rule_id, cast(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS version,
 CASE n_nationkey % 4 WHEN 0 THEN 'draft' WHEN 2 THEN 'retired' ELSE 'active' END AS status, DATE '1992-01-01' + cast(n_nationkey * 60 AS INT) AS date_from, cast(NULL AS DATE) AS date_to, sha256(n_name) AS hash, n_nationkey AS k FROM nation)"""
#: The rules that each case meets, in order, from the steps of the fold.
APPLIED = CASES + """, ap AS (SELECT x4.event_id, x4.gross, x4.gap, x4.t3, x4.t4, fold.fully_explained, fold.residual_paise, list_filter([CASE WHEN coalesce(full1 OR part1, false) THEN CASE x4.method WHEN 'card' THEN 'fee_card:2' ELSE 'fee_upi:1' END END,
 CASE WHEN f2 OR p2 THEN 'fee_bank:1' END, CASE WHEN f3 OR p3 THEN 'tds:1' END, CASE WHEN f4 OR p4 THEN 'commission:1' END], lambda x: x IS NOT NULL) AS applied FROM x4 JOIN fold USING (event_id))"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases under the starter rulebook, written once: an explode above the fold would have its filter pushed below it."""
    return settled(rules.apply_rules(cases(spark, sf_dir), rules.STARTER), "explained")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    status = F.when(k % 4 == 0, "draft").when(k % 4 == 2, "retired").otherwise("active")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.col("n_regionkey").alias("rule_set"), F.concat(F.lit("fee"), F.col("n_regionkey").cast("string")).alias("rule_id"),
        F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("version"), status.alias("status"),
        F.date_add(F.lit("1992-01-01").cast("date"), (k * 60).cast("int")).alias("date_from"), F.lit(None).cast("date").alias("date_to"),
        F.sha2("n_name", 256).alias("hash"), k.alias("k"))


@query(VERSIONS + " SELECT rule_set, rule_id, max(version) + 1 AS next_version, max(date_from) FILTER (status = 'active') AS live_from, coalesce(DATE '1995-06-01' > max(date_from) FILTER (status = 'active'), true) AS accepted FROM v GROUP BY 1, 2")
def rule_successors(spark, sf_dir):
    return lifecycle.successors(versions(spark, sf_dir), "1995-06-01")


@query(VERSIONS + f""", n AS (SELECT DISTINCT rule_set, rule_id FROM v WHERE rule_set IN (1, 3))
 SELECT rule_set, rule_id, version, CASE WHEN status = 'active' AND rule_set IN (1, 3) THEN 'retired' ELSE status END AS status, date_from, CASE WHEN status = 'active' AND rule_set IN (1, 3) THEN DATE '{TODAY}' END AS date_to FROM v
 UNION ALL SELECT rule_set, rule_id, (SELECT max(version) FROM v WHERE v.rule_id = n.rule_id) + 1, 'active', DATE '{TODAY}', NULL FROM n""")
def rulebook_import(spark, sf_dir):
    old = versions(spark, sf_dir)
    new = old.filter(F.col("rule_set").isin(1, 3)).select("rule_set", "rule_id", F.sha2("rule_id", 256).alias("hash")).distinct()
    return lifecycle.imported(old, new, TODAY).select("rule_set", "rule_id", "version", "status", "date_from", "date_to")


@query(VERSIONS + " SELECT rule_set, rule_id, version, CASE status WHEN 'draft' THEN 'deleted' WHEN 'active' THEN 'retired' ELSE 'refused' END AS outcome FROM v WHERE k % 3 = 0")
def rule_withdrawals(spark, sf_dir):
    return lifecycle.withdrawn(versions(spark, sf_dir), F.col("k") % 3 == 0)


@query(VERSIONS + " SELECT 'all' AS asked, rule_id, version FROM v WHERE status = 'active' UNION ALL SELECT 'set 2', rule_id, version FROM v WHERE status = 'active' AND rule_set = 2")
def ruleset_choices(spark, sf_dir):
    every = versions(spark, sf_dir)
    choice = lambda name, rows: rows.select(F.lit(name).alias("asked"), "rule_id", "version")
    return choice("all", lifecycle.resolved(every)).union(choice("set 2", lifecycle.resolved(every, 2))).union(choice("none", lifecycle.resolved(every, none=True)))


@query(VERSIONS + " SELECT rule_set, rule_id, version, CASE WHEN k % 6 = 1 THEN 'missing' ELSE 'changed' END AS fault FROM v WHERE status <> 'draft' AND k % 6 IN (1, 3)")
def altered_rules(spark, sf_dir):
    before = versions(spark, sf_dir)
    after = before.filter("k % 6 <> 1").withColumn("hash", F.when(F.col("k") % 6 == 3, F.sha2("hash", 256)).otherwise(F.col("hash")))
    return lifecycle.altered(before, after).select("rule_set", "rule_id", "version", "fault")


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'deleted' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def run_deletions(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    return lifecycle.soft_deleted(runs, F.col("run_id") % 5 == 0).groupBy("status").agg(F.count("*").alias("n"))


@query(CASES + " SELECT event_id, greatest(100, cast(round(gap * 0.01) AS BIGINT), 1)::BIGINT AS tolerance_paise FROM c")
def rule_tolerances(spark, sf_dir):
    bank_fee = rules.STARTER[2]
    return cases(spark, sf_dir).select("event_id", bank_fee.tolerance(F.col("gap_paise"), F.col("n_txns")).alias("tolerance_paise"))


@query(APPLIED + " SELECT event_id, len(applied)::INT AS n_rules, CASE WHEN len(applied) = 0 THEN 0.97 ELSE 0.95 END::DECIMAL(5,4) AS confidence FROM ap")
def explained_confidence(spark, sf_dir):
    done = explained(spark, sf_dir).withColumn("confidence", F.lit("0.97"))
    return rules.with_ceiling(done, rules.STARTER).select("event_id", F.size("rules_applied").alias("n_rules"), "confidence")


@query(APPLIED + " SELECT rule, count(*) AS n, count(*) FILTER (fully_explained) AS n_closed FROM (SELECT unnest(applied) AS rule, fully_explained FROM ap) GROUP BY rule")
def explained_by_rule(spark, sf_dir):
    done = explained(spark, sf_dir).select(F.explode("rules_applied").alias("rule"), "fully_explained")
    return done.groupBy("rule").agg(F.count("*").alias("n"), F.count_if("fully_explained").alias("n_closed"))


@query(APPLIED + " SELECT count(DISTINCT rule) AS rules_fired FROM (SELECT unnest(applied) AS rule FROM ap)")
def rules_fired(spark, sf_dir):
    hashes = rules.by_version(rules.STARTER, rules.version_hash)
    fired = explained(spark, sf_dir).select(F.explode("rules_applied").alias("rule"))
    return fired.agg(F.count_distinct(hashes[F.col("rule")]).alias("rules_fired"))


@query(APPLIED + """, r3b AS (SELECT *, t3 > 0 AND abs(gap - t3) <= 100 AS g3 FROM ap), s3b AS (SELECT *, t3 > 0 AND t3 < gap AND NOT g3 AS q3 FROM r3b), l3b AS (SELECT *, CASE WHEN g3 OR q3 THEN gap - t3 ELSE gap END AS lb FROM s3b),
 r4b AS (SELECT *, NOT g3 AND t4 > 0 AND abs(lb - t4) <= 100 AS g4 FROM l3b), s4b AS (SELECT *, NOT g3 AND NOT g4 AND t4 > 0 AND t4 < lb AS q4 FROM r4b),
 w AS (SELECT event_id, applied, fully_explained, residual_paise, list_filter([CASE WHEN g3 OR q3 THEN 'tds:1' END, CASE WHEN g4 OR q4 THEN 'commission:1' END], lambda x: x IS NOT NULL) AS later, g3 OR g4 AS closed, CASE WHEN g4 OR q4 THEN lb - t4 ELSE lb END AS left_paise FROM s4b),
 d AS (SELECT event_id, array_to_string(list_filter(applied, lambda x: NOT list_contains(later, x)), ',') AS no_longer, array_to_string(list_filter(later, lambda x: NOT list_contains(applied, x)), ',') AS newly,
 CASE WHEN fully_explained AND NOT closed THEN 'reopened' WHEN closed AND NOT fully_explained THEN 'closed' ELSE 'same' END AS state, left_paise - residual_paise AS residual_change FROM w)
 SELECT * FROM d WHERE no_longer <> '' OR newly <> '' OR state <> 'same' OR residual_change <> 0""")
def rulebook_replay(spark, sf_dir):
    """The cases of all payments under the starter rulebook and under its last two rules alone."""
    return rules.replayed(cases(spark, sf_dir), rules.STARTER, rules.STARTER[3:], "event_id")


@query(CTES + " SELECT event_id, order_id, amount_paise FROM gateway WHERE txn_type = 'refund' AND batch % 2 <> 0")
def chargebacks_unrecorded(spark, sf_dir):
    """Refund rows stand in for dispute debits; the books tell of those of even orders."""
    gateway = source(spark, sf_dir, "gateway").filter("txn_type = 'refund'").withColumn("txn_type", F.lit("dispute")).withColumn("direction", F.lit("debit"))
    books = gateway.filter("batch % 2 = 0").select(F.concat(F.lit("Disputes: order "), "order_id", F.lit(" charged back")).alias("narration"))
    return classify.unrecorded_chargebacks(gateway, books)


@query(CTES + """, p AS (SELECT b.batch, b.amount_paise - min(l.amount_paise) AS residual_paise, datediff('day', min(b.txn_date), min(l.txn_date)) AS shift_days, count(*) AS n_candidates FROM bank b JOIN ledger l ON b.batch = l.batch GROUP BY b.batch, b.amount_paise)
 SELECT 'S' || batch AS settlement_id, residual_paise, n_candidates FROM p WHERE NOT (residual_paise = 0 AND abs(shift_days) <= 3 AND n_candidates = 1)""")
def matches_to_report(spark, sf_dir):
    gateway, bank, ledger = derived(spark, sf_dir)
    books = settlements.named(ledger, gateway).groupBy("settlement_id").agg(F.min("amount_paise").alias("booked_paise"), F.min("txn_date").alias("booked_on"), F.count("*").alias("n_candidates"))
    groups = settlements.named(bank, gateway).join(books, "settlement_id").select(
        "settlement_id", F.lit(False).alias("has_gateway"), (F.col("amount_paise") - F.col("booked_paise")).alias("residual_paise"), F.date_diff("booked_on", "txn_date").alias("shift_days"), "n_candidates")
    return classify.worth_reporting(groups).select("settlement_id", "residual_paise", "n_candidates")


@query(QUEUE + " SELECT category, count(*) FILTER (tier = 'auto') AS n_auto, count(*) FILTER (tier = 'auto' AND NOT explained) AS false_auto, count(*) FILTER (tier = 'auto' AND category IN ('duplicate_ledger_entry', 'chargeback_unrecorded')) AS never_auto FROM q GROUP BY category")
def auto_counters(spark, sf_dir):
    auto = F.col("tier") == "auto"
    return queue(spark, sf_dir).groupBy("category").agg(F.count_if(auto).alias("n_auto"), F.count_if(auto & ~F.col("explained")).alias("false_auto"), F.count_if(auto & F.col("category").isin(*NEVER_AUTO)).alias("never_auto"))


@query(CTES + " SELECT event_id, substr(narration, 1, 500) AS narration FROM ev")
def sanitised_narrations(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.concat(F.lit("\u200b"), "narration", F.lit("\x07")).alias("raw"))
    return rows.select("event_id", sanitised("raw").alias("narration"))


@query(MATCHES + """, x AS (SELECT subject, 'new' AS run, status FROM q WHERE cast(substr(subject, 2) AS BIGINT) % 7 <> 0 UNION ALL SELECT subject, 'old', 'open' FROM q WHERE cast(substr(subject, 2) AS BIGINT) % 2 = 0)
 SELECT event_id, run, status FROM (SELECT n.event_id, x.run, x.status, row_number() OVER (PARTITION BY n.event_id ORDER BY (x.status = 'open')::INT DESC, x.run) AS k FROM x JOIN named n ON n.settlement_id = x.subject) WHERE k = 1""")
def open_exception_of_event(spark, sf_dir):
    """One exception for each event out of two runs: an open one before any other, then the newer run's."""
    number = F.substring("subject", 2, 20).cast("bigint")
    found = settled(queue(spark, sf_dir).select("subject", "status"), "queue")
    runs = found.filter(number % 7 != 0).select("subject", F.lit("new").alias("run"), "status").union(found.filter(number % 2 == 0).select("subject", F.lit("old"), F.lit("open")))
    rows = named(spark, sf_dir).select("settlement_id", "event_id").join(runs, F.col("settlement_id") == F.col("subject"))
    return exceptions.first_of(rows, ["event_id"], [(F.col("status") == "open").desc(), F.col("run")]).select("event_id", "run", "status")
