"""Matching queries over the derived three sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from trisettle.functions.scoring import tolerance_terms
from trisettle.operators import references, settlements
from trisettle.operators.shared import settled
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


CELLS = """c AS (SELECT e.*, bucket // 3 + x AS amount_cell, (txn_date - DATE '1970-01-01') // 7 + y AS day_cell FROM e, (SELECT unnest([-1, 0, 1]) AS x), (SELECT unnest([-1, 0, 1]) AS y))"""
BANKISH = "(upper(ledger_account) LIKE '%BANK%' OR upper(ledger_account) LIKE '%CASH%' OR upper(ledger_account) LIKE '%CURRENT A%') AND upper(ledger_account) NOT LIKE '%CHARGES%'"
TOL = "greatest(100, cast(floor(abs(expected_net_paise) * 0.0005::DECIMAL(10,8)) AS BIGINT), n_txns)"
SUMS = """, sums AS (SELECT settlement_id,
 cast(coalesce(sum(amount_paise + fee_paise) FILTER (txn_type = 'payment'), 0) AS BIGINT) AS gross_paise, cast(coalesce(sum(fee_paise) FILTER (txn_type = 'payment'), 0) AS BIGINT) AS fee_paise,
 cast(coalesce(sum(tax_raw) FILTER (txn_type = 'payment'), 0) AS BIGINT) AS gst_paise, cast(0 AS BIGINT) AS deductions_paise,
 cast(coalesce(sum(amount_paise) FILTER (txn_type <> 'payment'), 0) AS BIGINT) AS additions_paise, count(*) FILTER (txn_type = 'payment') AS n_txns, min(txn_date) AS first_date, min(utr) AS utr
 FROM gateway GROUP BY settlement_id), arith AS (SELECT *, gross_paise - fee_paise - deductions_paise + additions_paise AS expected_net_paise FROM sums),
 tol AS (SELECT *, """ + TOL + """ AS tolerance_paise FROM arith WHERE gross_paise - fee_paise + additions_paise > 0)"""


@query(CTES + f" SELECT event_id, source FROM ev WHERE source <> 'ledger' OR ledger_account = 'Main Bank' OR ({BANKISH}) OR voucher_type IN ('Receipt', 'Payment', 'Contra')")
def reconcilable_events(spark, sf_dir):
    return references.reconcilable(events(spark, sf_dir)).select("event_id", "source")


@query(CTES + f""" SELECT source, count(*) AS n, cast(sum(CASE WHEN (direction = 'credit') <> (source = 'ledger' AND coalesce({BANKISH}, false)) THEN amount_paise ELSE -amount_paise END) AS BIGINT) AS signed_paise
 FROM ev GROUP BY source""")
def signed_totals(spark, sf_dir):
    return events(spark, sf_dir).withColumn("signed", references.bank_signed()).groupBy("source").agg(F.count("*").alias("n"), F.sum("signed").alias("signed_paise"))


@query(CTES + """, r AS (SELECT event_id, 'utr' AS field, utr AS value, '' AS side FROM ev WHERE length(utr) >= 16
 UNION SELECT event_id, 'settlement_id', settlement_id, '' FROM ev WHERE settlement_id IS NOT NULL
 UNION SELECT event_id, 'order_id', order_id, CASE WHEN txn_type IN ('refund', 'dispute') THEN 'refund' ELSE 'payment' END FROM ev WHERE order_id IS NOT NULL
 UNION SELECT event_id, 'settlement_id', split_part(narration, ' ', 3), '' FROM ev WHERE source = 'ledger' AND narration LIKE 'Settlement credit %')
 SELECT * FROM r""")
def trusted_references(spark, sf_dir):
    return references.trusted_references(events(spark, sf_dir))


@query(CTES + f""", e AS (SELECT *, CASE WHEN (direction = 'credit') <> (source = 'ledger' AND coalesce({BANKISH}, false)) THEN amount_paise ELSE -amount_paise END AS signed FROM ev
 WHERE source <> 'bank' OR length(utr) >= 16),
 g AS (SELECT batch, min(event_id) AS group_id, count(*) AS n_events, count(DISTINCT source) AS n_sources, sum(signed) FILTER (source = 'bank') AS bank, sum(signed) FILTER (source = 'gateway') AS gateway,
 sum(signed) FILTER (source = 'ledger') AS ledger, count(*) FILTER (source <> 'bank') AS n_txns FROM e GROUP BY batch),
 d AS (SELECT *, bank - coalesce(gateway, ledger) AS delta, greatest(100, cast(floor(abs(bank) * 0.0005::DECIMAL(10,8)) AS BIGINT), n_txns) AS tol FROM g)
 SELECT group_id, n_events, n_sources, cast(coalesce(delta, 0) AS BIGINT) AS delta_paise FROM d WHERE n_sources >= 2 AND (delta IS NULL OR abs(delta) <= tol)""")
def exact_reference_groups(spark, sf_dir):
    return references.exact_reference_groups(events(spark, sf_dir))


@query(CTES + SUMS + " SELECT settlement_id, gross_paise, fee_paise, gst_paise, deductions_paise, additions_paise, n_txns, expected_net_paise FROM arith")
def settlement_arithmetic(spark, sf_dir):
    return settlements.arithmetic(source(spark, sf_dir, "gateway")).drop("first_date", "utrs")


@query(CTES + SUMS + """ SELECT settlement_id, tolerance_paise, CASE WHEN tolerance_paise = 100 THEN 'absolute' WHEN tolerance_paise = cast(floor(abs(expected_net_paise) * 0.0005::DECIMAL(10,8)) AS BIGINT) THEN 'percentage' ELSE 'drift' END AS binding FROM tol""")
def settlement_tolerance(spark, sf_dir):
    sums = settlements.arithmetic(source(spark, sf_dir, "gateway")).filter("expected_net_paise > 0")
    return sums.select("settlement_id", tolerance_terms(F.col("expected_net_paise"), F.col("n_txns")).alias("t")).select("settlement_id", F.col("t.tolerance").alias("tolerance_paise"), "t.binding")


PAIRS = """, cand AS (SELECT b.event_id AS credit_id, t.settlement_id, b.amount_paise AS credit_paise, b.amount_paise - t.expected_net_paise AS delta_paise, t.tolerance_paise, t.n_txns, coalesce(length(b.utr) >= 16, false) AS by_reference,
 b.txn_date AS bd, t.first_date AS fd FROM bank b JOIN (SELECT *, expected_net_paise - tolerance_paise AS lo, expected_net_paise + tolerance_paise AS hi FROM tol) t ON b.amount_paise BETWEEN t.lo AND t.hi
 WHERE (length(b.utr) < 16 OR b.utr IS NULL OR b.utr = t.utr))"""
RESULT = """ SELECT credit_id, count(*) AS n_candidates, CASE WHEN count(*) = 1 THEN min(settlement_id) END AS settlement_id, CASE WHEN count(*) = 1 THEN min(delta_paise) END AS delta_paise,
 CASE WHEN count(*) = 1 THEN min(tolerance_paise) END AS tolerance_paise, CASE WHEN count(*) = 1 THEN cast(round(cast(0.97 * (1 - least(1.0, abs(min(delta_paise)) / min(credit_paise)::DOUBLE)) AS DECIMAL(20,12)), 4) AS DOUBLE) END AS confidence
 FROM cand {where} GROUP BY credit_id"""


def credits_and_sums(spark, sf_dir):
    """Bank rows, written as they are read twice, and the arithmetic of settlements."""
    gateway, bank, _ = derived(spark, sf_dir)
    return settled(bank.select("event_id", "amount_paise", "direction", "txn_date", "utr"), "bank"), settlements.arithmetic(gateway)


@query(CTES + SUMS + PAIRS + RESULT.format(where=""))
def settlement_vs_bank(spark, sf_dir):
    return settlements.reconcile(*credits_and_sums(spark, sf_dir))


@query(CTES + SUMS + PAIRS + RESULT.format(where="WHERE bd - fd BETWEEN -3 AND 3"))
def settlement_vs_bank_windowed(spark, sf_dir):
    return settlements.reconcile(*credits_and_sums(spark, sf_dir), window_days=3)


@query(CTES + SUMS + PAIRS + """, r AS (SELECT credit_id, min(settlement_id) AS settlement_id FROM cand WHERE bd - fd BETWEEN -3 AND 3 GROUP BY credit_id HAVING count(*) = 1)
 SELECT r.credit_id, r.settlement_id, count(l.event_id) AS n_legs, CASE WHEN count(l.event_id) = 1 THEN min(l.event_id) END AS ledger_id, CASE WHEN count(l.event_id) = 1 THEN min(l.amount_paise) END AS ledger_paise
 FROM r LEFT JOIN ledger l ON split_part(l.narration, ' ', 3) = r.settlement_id GROUP BY 1, 2""")
def three_way_attach(spark, sf_dir):
    return settlements.three_way(settlement_vs_bank_windowed(spark, sf_dir), source(spark, sf_dir, "ledger"))


@query(CTES + SUMS + """ SELECT b.event_id AS credit_id, a.settlement_id, b.amount_paise - a.expected_net_paise AS delta_paise, a.n_txns FROM bank b JOIN arith a ON a.settlement_id = split_part(b.narration, 'Settlement credit ', 2)
 WHERE b.narration LIKE '%Settlement credit %' AND abs(b.amount_paise - a.expected_net_paise) <= """ + TOL)
def grouped_batches(spark, sf_dir):
    return settlements.grouped(source(spark, sf_dir, "bank"), settlements.arithmetic(source(spark, sf_dir, "gateway")))


@query(CTES + """, f AS (SELECT DISTINCT utr AS fragment FROM bank WHERE length(utr) < 16), v AS (SELECT DISTINCT utr AS value FROM gateway)
 SELECT fragment, count(value) AS n_values, CASE WHEN count(value) = 1 THEN min(value) END AS completion FROM f LEFT JOIN v ON starts_with(value, fragment) AND value <> fragment GROUP BY fragment""")
def prefix_completion(spark, sf_dir):
    bank, gateway = source(spark, sf_dir, "bank"), source(spark, sf_dir, "gateway")
    return references.completions(bank.filter("length(utr) < 16").select(F.col("utr").alias("fragment")), gateway.select(F.col("utr").alias("value")))


@query(CTES + """, e AS (SELECT event_id, source, amount_paise, cast(floor(amount_paise / 100000.0) AS BIGINT) AS bucket, txn_date FROM ev), """ + CELLS + """
 SELECT a.event_id AS left_id, a.source AS left_source, b.event_id AS right_id, b.source AS right_source, b.amount_paise - a.amount_paise AS delta_paise, b.txn_date - a.txn_date AS days
 FROM e a JOIN c b ON a.bucket // 3 = b.amount_cell AND (a.txn_date - DATE '1970-01-01') // 7 = b.day_cell AND a.source < b.source AND abs(a.bucket - b.bucket) <= 2 AND abs(a.txn_date - b.txn_date) <= 6""")
def blocked_pairs(spark, sf_dir):
    return references.blocked_pairs(events(spark, sf_dir))


@query(CTES + """, e AS (SELECT source, cast(floor(amount_paise / 100000.0) AS BIGINT) AS bucket, txn_date FROM ev WHERE source <> 'gateway'), """ + CELLS + """,
 p AS (SELECT count(*) AS candidate_pairs FROM e a JOIN c b ON a.bucket // 3 = b.amount_cell AND (a.txn_date - DATE '1970-01-01') // 7 = b.day_cell AND a.source < b.source AND abs(a.bucket - b.bucket) <= 2 AND abs(a.txn_date - b.txn_date) <= 6),
 n AS (SELECT count(*) FILTER (source = 'bank') * count(*) FILTER (source = 'ledger') AS cross_pairs, cast(count(*) * (count(*) - 1) / 2 AS BIGINT) AS naive_pairs FROM e)
 SELECT naive_pairs, cross_pairs, candidate_pairs FROM n, p""")
def blocking_statistics(spark, sf_dir):
    rows = events(spark, sf_dir).filter("source <> 'gateway'")
    totals = rows.agg(F.count("*").alias("n"), F.count_if(F.col("source") == "bank").alias("b"), F.count_if(F.col("source") == "ledger").alias("l"))
    pairs = references.blocked_pairs(rows).agg(F.count("*").alias("candidate_pairs"))
    return totals.join(pairs).select((F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("naive_pairs"), (F.col("b") * F.col("l")).alias("cross_pairs"), "candidate_pairs")


@query(CTES + """ SELECT left_id, right_id, days FROM (SELECT b.event_id AS left_id, l.event_id AS right_id, abs(l.txn_date - b.txn_date) AS days,
 row_number() OVER (PARTITION BY b.event_id ORDER BY abs(l.txn_date - b.txn_date), l.event_id) AS k FROM bank b JOIN ledger l ON b.amount_paise = l.amount_paise AND abs(l.txn_date - b.txn_date) > 2) WHERE k = 1""")
def nearest_opposite(spark, sf_dir):
    return settlements.nearest_opposite(source(spark, sf_dir, "bank"), source(spark, sf_dir, "ledger"), 2)


@query(CTES + """ SELECT voucher_type, amount_paise, txn_date, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM ledger GROUP BY voucher_type, direction, amount_paise, txn_date, upper(trim(narration)) HAVING count(*) > 1""")
def duplicate_legs(spark, sf_dir):
    return settlements.duplicate_legs(source(spark, sf_dir, "ledger")).drop("direction", "narration_key")


@query(CTES + """, s AS (SELECT batch, sum(amount_paise) AS net, count(*) AS n FROM gateway GROUP BY batch), l AS (SELECT batch, sum(amount_paise) AS booked, count(*) AS legs, min(amount_paise) = max(amount_paise) AS same FROM ledger WHERE voucher_type = 'Receipt' GROUP BY batch)
 SELECT l.batch, cast(booked - net AS BIGINT) AS difference_paise, CASE WHEN legs > 1 AND same THEN 'duplicate' ELSE 'amount_variance' END AS finding FROM l JOIN s ON l.batch = s.batch
 WHERE abs(booked - net) > greatest(100, cast(floor(abs(net) * 0.0005::DECIMAL(10,8)) AS BIGINT), n)""")
def books_disagreement(spark, sf_dir):
    from trisettle.functions.scoring import tolerance

    net = source(spark, sf_dir, "gateway").groupBy("batch").agg(F.sum("amount_paise").alias("net"), F.count("*").alias("n"))
    booked = source(spark, sf_dir, "ledger").filter("voucher_type = 'Receipt'").groupBy("batch").agg(F.sum("amount_paise").alias("booked"), F.count("*").alias("legs"), (F.min("amount_paise") == F.max("amount_paise")).alias("same"))
    delta = F.col("booked") - F.col("net")
    return booked.join(net, "batch").filter(F.abs(delta) > tolerance(F.col("net"), F.col("n"))).select("batch", delta.alias("difference_paise"), F.when((F.col("legs") > 1) & F.col("same"), "duplicate").otherwise("amount_variance").alias("finding"))


@query(CTES + " SELECT event_id, txn_date, amount_paise, cast(sum(amount_paise) OVER (ORDER BY txn_date, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS closing_paise FROM bank")
def running_balance(spark, sf_dir):
    return settlements.running_balance(source(spark, sf_dir, "bank"))


@query(CTES + """, c AS (SELECT g.batch, length(b.utr) >= 16 AND b.amount_paise = s.net AS agreed FROM (SELECT DISTINCT batch FROM gateway) g JOIN (SELECT batch, sum(amount_paise) AS net FROM gateway GROUP BY batch) s ON s.batch = g.batch LEFT JOIN bank b ON b.batch = g.batch)
 SELECT CASE WHEN agreed IS NULL THEN 'no credit' WHEN agreed THEN 'agreed' ELSE 'open' END AS state, count(*) AS n FROM c GROUP BY 1""")
def bank_coverage(spark, sf_dir):
    gateway, bank, _ = derived(spark, sf_dir)
    net = gateway.groupBy("settlement_id").agg(F.sum("amount_paise").alias("net"))
    rows = net.join(settlements.named(bank, gateway).select("settlement_id", "utr", "amount_paise"), "settlement_id", "left")
    agreed = F.when(F.col("amount_paise").isNotNull(), F.coalesce(F.length("utr") >= 16, F.lit(None).cast("boolean")) & (F.col("amount_paise") == F.col("net")))
    return rows.groupBy(F.when(agreed.isNull(), "no credit").when(agreed, "agreed").otherwise("open").alias("state")).agg(F.count("*").alias("n"))
