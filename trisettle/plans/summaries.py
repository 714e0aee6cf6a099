"""Run summaries, lanes, statement balances and linked residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from trisettle.operators import exceptions, settlements
from trisettle.plans.matching import SUMS
from trisettle.plans.queue import FINDINGS, QUEUE, findings, queue
from trisettle.sources.harness import CTES, events, source

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(QUEUE + " SELECT count(*) AS n, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (tier = 'auto') AS n_auto, count(*) FILTER (tier = 'escalate') AS n_escalated, sum(gap_paise)::BIGINT AS gap_paise FROM q")
def run_summary(spark, sf_dir):
    return queue(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("n_open"), F.count_if(F.col("tier") == "auto").alias("n_auto"), F.count_if(F.col("tier") == "escalate").alias("n_escalated"), F.sum("gap_paise").alias("gap_paise"))


@query(CTES + """ SELECT source, count(*) AS n, coalesce(sum(fee_paise), 0)::BIGINT AS fee_paise, arg_min(event_id, lpad((1000000000000 - amount_paise)::BIGINT::VARCHAR, 14, '0') || event_id) AS largest FROM ev GROUP BY source""")
def run_facts(spark, sf_dir):
    largest = F.min(F.struct((-F.col("amount_paise")).alias("a"), "event_id")).getField("event_id")
    return events(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("fee_paise"), F.lit(0)).alias("fee_paise"), largest.alias("largest"))


@query(CTES + """, l AS (SELECT CASE WHEN source = 'gateway' THEN 'gateway' WHEN source = 'bank' AND narration LIKE '%Settlement credit%' THEN 'gateway' WHEN source = 'bank' AND upper(narration) LIKE '%GATEWAY%' THEN 'gateway' WHEN source = 'ledger' AND voucher_type = 'Receipt' THEN 'gateway' WHEN source = 'ledger' AND voucher_type = 'Journal' THEN 'other' ELSE 'operating' END AS lane, source, amount_paise FROM ev)
 SELECT x.lane, count(amount_paise) AS n, coalesce(sum(amount_paise), 0)::BIGINT AS amount_paise FROM (SELECT unnest(['gateway', 'marketplace', 'pos', 'operating', 'other']) AS lane) x LEFT JOIN l ON l.lane = x.lane GROUP BY x.lane""")
def lane_totals(spark, sf_dir):
    text = F.upper("narration")
    lane = (F.when(F.col("source") == "gateway", "gateway").when((F.col("source") == "bank") & text.rlike("SETTLEMENT CREDIT|GATEWAY"), "gateway")
            .when((F.col("source") == "ledger") & (F.col("voucher_type") == "Receipt"), "gateway").when((F.col("source") == "ledger") & (F.col("voucher_type") == "Journal"), "other").otherwise("operating"))
    sums = events(spark, sf_dir).groupBy(lane.alias("lane")).agg(F.count("*").alias("n"), F.sum("amount_paise").alias("amount_paise"))
    lanes = spark.range(1).select(F.explode(F.array(*map(F.lit, ("gateway", "marketplace", "pos", "operating", "other")))).alias("lane"))
    return lanes.join(sums, "lane", "left").select("lane", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount_paise", F.lit(0)).alias("amount_paise"))


@query(CTES + """, b AS (SELECT event_id, txn_date, amount_paise, sum(amount_paise) OVER (ORDER BY txn_date, event_id ROWS UNBOUNDED PRECEDING) AS closing FROM bank), m AS (SELECT date_trunc('month', txn_date)::DATE AS month, txn_date, event_id, closing - amount_paise AS before, closing FROM b)
 SELECT month, arg_min(before, lpad((txn_date - DATE '1970-01-01')::VARCHAR, 6, '0') || event_id)::BIGINT AS opening_paise, arg_max(closing, lpad((txn_date - DATE '1970-01-01')::VARCHAR, 6, '0') || event_id)::BIGINT AS closing_paise FROM m GROUP BY month""")
def statement_balances(spark, sf_dir):
    rows = settlements.running_balance(source(spark, sf_dir, "bank"))
    first = F.min(F.struct("txn_date", "event_id", (F.col("closing_paise") - F.col("amount_paise")).alias("x"))).getField("x")
    last = F.max(F.struct("txn_date", "event_id", F.col("closing_paise").alias("x"))).getField("x")
    return rows.groupBy(F.trunc("txn_date", "month").alias("month")).agg(first.alias("opening_paise"), last.alias("closing_paise"))


@query(FINDINGS + """, l AS (SELECT subject, gap_paise, CASE WHEN cast(substr(subject, 2) AS BIGINT) % 3 = 0 THEN gap_paise ELSE gap_paise // 2 END AS linked FROM found), r AS (SELECT *, abs(gap_paise - linked) AS residual FROM l)
 SELECT subject, residual AS residual_paise, residual > 100 AS child FROM r""")
def linked_residuals(spark, sf_dir):
    number = F.substring("subject", 2, 20).cast("bigint")
    linked = F.when(number % 3 == 0, F.col("gap_paise")).otherwise(F.expr("gap_paise div 2"))
    return exceptions.linked(findings(spark, sf_dir).withColumn("linked_paise", linked)).select("subject", "residual_paise", "child")


@query(CTES + SUMS + """, held AS (SELECT DISTINCT settlement_id FROM gateway WHERE on_hold), risk AS (SELECT a.settlement_id, a.expected_net_paise, a.first_date + 2 AS due FROM arith a WHERE a.settlement_id NOT IN (SELECT 'S' || batch FROM bank) AND a.settlement_id NOT IN (SELECT settlement_id FROM held))
 SELECT count(*) AS n, coalesce(sum(expected_net_paise), 0)::BIGINT AS at_risk_paise, min(due) AS first_due FROM risk""")
def cash_at_risk(spark, sf_dir):
    gateway = source(spark, sf_dir, "gateway")
    paid = settlements.named(source(spark, sf_dir, "bank"), gateway).select("settlement_id")
    rows = settlements.arithmetic(gateway).join(paid, "settlement_id", "left_anti").join(gateway.filter("on_hold").select("settlement_id").distinct(), "settlement_id", "left_anti")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("expected_net_paise"), F.lit(0)).alias("at_risk_paise"), F.min(F.date_add("first_date", 2)).alias("first_due"))
