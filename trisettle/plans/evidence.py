"""Evidence behind matches and exceptions: overlaps, funnels and precision by category."""

from __future__ import annotations

from pyspark.sql import functions as F

from trisettle.operators import settlements
from trisettle.operators.shared import settled
from trisettle.plans.matching import PAIRS, RESULT, SUMS, settlement_vs_bank_windowed
from trisettle.plans.queue import FINDINGS, QUEUE, findings, queue
from trisettle.sources.harness import CTES, derived, events, source

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(CTES + " SELECT event_id, settlement_id, amount_paise FROM gateway WHERE on_hold AND batch IN (SELECT batch FROM ledger)")
def held_but_booked(spark, sf_dir):
    gateway = source(spark, sf_dir, "gateway")
    booked = settlements.named(source(spark, sf_dir, "ledger"), gateway).select("settlement_id")
    return gateway.filter("on_hold").join(booked, "settlement_id", "left_semi").select("event_id", "settlement_id", "amount_paise")


@query(FINDINGS + """, m AS (SELECT 'm' || batch AS match_id, list(event_id) AS ids FROM ev WHERE source <> 'gateway' GROUP BY batch HAVING count(*) > 1), x AS (SELECT f.subject, list(e.event_id) AS ids FROM found f JOIN ev e ON e.source <> 'gateway' AND 'S' || e.batch = f.subject GROUP BY f.subject)
 SELECT m.match_id, x.subject FROM m JOIN x ON 'm' || substr(x.subject, 2) = m.match_id AND list_has_any(m.ids, x.ids)""")
def match_exception_overlap(spark, sf_dir):
    gateway, bank, ledger = derived(spark, sf_dir)
    rows = settled(settlements.named(bank.unionByName(ledger), gateway).filter("settlement_id is not null").select("settlement_id", "event_id"), "named-rows")
    members = rows.groupBy("settlement_id").agg(F.collect_list("event_id").alias("ids")).filter(F.size("ids") > 1)
    matches = members.select(F.concat(F.lit("m"), F.substring("settlement_id", 2, 20)).alias("match_id"), F.explode("ids").alias("event_id"))
    own = findings(spark, sf_dir).join(rows.withColumnRenamed("settlement_id", "subject"), "subject").select("subject", "event_id")
    return matches.join(own, "event_id").select("match_id", "subject").distinct()


@query(CTES + SUMS + PAIRS + ", r AS (" + RESULT.format(where="WHERE bd - fd BETWEEN -3 AND 3") + ") SELECT CASE WHEN n_candidates = 1 THEN 'fee_adjusted' ELSE 'refused' END AS stage, count(*) AS n, count(*) FILTER (confidence >= 0.94) AS n_auto FROM r GROUP BY 1")
def stage_funnel(spark, sf_dir):
    rows = settlement_vs_bank_windowed(spark, sf_dir)
    return rows.groupBy(F.when(F.col("n_candidates") == 1, "fee_adjusted").otherwise("refused").alias("stage")).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.94).alias("n_auto"))


@query(FINDINGS + """, t AS (SELECT DISTINCT 'S' || batch AS subject, CASE WHEN batch % 17 = 0 THEN 'missing_in_bank' WHEN batch % 13 <> 0 AND batch % 19 = 0 THEN 'amount_variance' WHEN batch % 23 = 0 THEN 'missing_in_ledger' WHEN batch % 29 = 0 THEN 'duplicate_ledger_entry' WHEN batch % 41 = 0 THEN 'revenue_booked_not_settled' END AS truth FROM gateway),
 p AS (SELECT category, count(*) AS predicted FROM found GROUP BY category), a AS (SELECT truth AS category, count(*) AS actual FROM t WHERE truth IS NOT NULL GROUP BY truth), b AS (SELECT f.category, count(*) AS both FROM found f JOIN t ON t.subject = f.subject AND t.truth = f.category GROUP BY f.category)
 SELECT coalesce(p.category, a.category) AS category, coalesce(predicted, 0) AS predicted, coalesce(actual, 0) AS actual, coalesce("both", 0) AS correct FROM p FULL OUTER JOIN a ON p.category = a.category LEFT JOIN b ON b.category = coalesce(p.category, a.category)""".replace("AS both", 'AS "both"'))
def category_precision(spark, sf_dir):
    b = F.col("batch")
    truth = (F.when(b % 17 == 0, "missing_in_bank").when((b % 13 != 0) & (b % 19 == 0), "amount_variance").when(b % 23 == 0, "missing_in_ledger").when(b % 29 == 0, "duplicate_ledger_entry").when(b % 41 == 0, "revenue_booked_not_settled"))
    known = source(spark, sf_dir, "gateway").select("batch").distinct().select(F.concat(F.lit("S"), b.cast("string")).alias("subject"), truth.alias("truth"))
    rows = known.join(findings(spark, sf_dir).select("subject", "category"), "subject", "full_outer")
    # each row counts once for its prediction and once for its truth, and both meet where they agree
    sides = rows.select(F.inline(F.array(F.struct(F.col("category"), F.lit(1).alias("predicted"), F.lit(0).alias("actual"), (F.col("category").eqNullSafe(F.col("truth"))).cast("int").alias("correct")),
                                         F.struct(F.col("truth").alias("category"), F.lit(0).alias("predicted"), F.lit(1).alias("actual"), F.lit(0).alias("correct")))))
    return sides.filter("category is not null").groupBy("category").agg(*[F.sum(c).alias(c) for c in ("predicted", "actual", "correct")])


@query(QUEUE + " SELECT subject, category, tier, status FROM q WHERE tier = 'escalate' AND status = 'open' AND category = 'missing_in_bank'")
def exception_list(spark, sf_dir):
    return queue(spark, sf_dir).filter("tier = 'escalate' and status = 'open' and category = 'missing_in_bank'").select("subject", "category", "tier", "status")


@query("SELECT event_id, user_id, ts FROM events WHERE user_id BETWEEN 10 AND 19 AND event_type <> 'view' ORDER BY ts")
def audit_list(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.filter("user_id between 10 and 19 and event_type <> 'view'").select("event_id", "user_id", "ts")


@query("SELECT p_type AS rule_set, count(*) AS n, count(*) FILTER (p_size > 25) AS n_active, max(p_partkey) AS latest FROM part GROUP BY p_type")
def rule_sets(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_type").alias("rule_set")).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("n_active"), F.max("p_partkey").alias("latest"))
