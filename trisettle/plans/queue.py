"""Exception-queue, rulebook and replay queries over the derived three sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from trisettle.functions import scoring
from trisettle.operators import exceptions, rules, settlements
from trisettle.operators.shared import dealt, settled, tasks_for
from trisettle.plans.matching import SUMS, TOL
from trisettle.sources.harness import CTES, derived, source

QUERIES = {}
ORACLE_SQL = {}
TODAY = "1996-06-30"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def findings(spark, sf_dir):
    gateway, bank, ledger = derived(spark, sf_dir)
    return exceptions.findings(gateway, settled(bank, "bank"), settled(ledger, "ledger"))


def queue(spark, sf_dir):
    """The queue over findings written once: the sizes of clusters need them twice."""
    return exceptions.queue(settled(findings(spark, sf_dir), "findings"), TODAY)


FINDINGS = CTES + SUMS + """, cl AS (SELECT 'S' || batch AS settlement_id, amount_paise, txn_date FROM bank), lb AS (SELECT 'S' || batch AS settlement_id, count(*) AS n, min(amount_paise) AS amount_paise, min(txn_date) AS txn_date FROM ledger GROUP BY 1),
 steps AS (SELECT 1 AS step, 'missing_in_bank' AS category, settlement_id AS subject, expected_net_paise AS amount_paise, expected_net_paise AS gap_paise, gross_paise, first_date AS on_date FROM arith WHERE settlement_id NOT IN (SELECT settlement_id FROM cl)
 UNION ALL SELECT 2, 'amount_variance', a.settlement_id, c.amount_paise, abs(c.amount_paise - a.expected_net_paise), a.gross_paise, c.txn_date FROM cl c JOIN arith a USING (settlement_id) WHERE abs(c.amount_paise - a.expected_net_paise) > """ + TOL + """
 UNION ALL SELECT 3, 'missing_in_ledger', settlement_id, amount_paise, amount_paise, amount_paise, txn_date FROM cl WHERE settlement_id NOT IN (SELECT settlement_id FROM lb)
 UNION ALL SELECT 4, 'duplicate_ledger_entry', settlement_id, amount_paise, amount_paise, amount_paise, txn_date FROM lb WHERE n > 1
 UNION ALL SELECT 5, 'revenue_booked_not_settled', settlement_id, sum(amount_paise), sum(amount_paise), sum(amount_paise), min(txn_date) FROM gateway WHERE on_hold GROUP BY settlement_id),
 found AS (SELECT subject, category, cast(amount_paise AS BIGINT) AS amount_paise, cast(gap_paise AS BIGINT) AS gap_paise, cast(gross_paise AS BIGINT) AS gross_paise, on_date FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY step, category, amount_paise, gap_paise) AS k FROM steps) WHERE k = 1)"""
QUEUE = FINDINGS + f""", q0 AS (SELECT *, CASE category WHEN 'amount_variance' THEN 0.97 WHEN 'missing_in_bank' THEN 0.90 ELSE 1.0 END AS conf, gap_paise * 100 <= gross_paise AS explained, CASE WHEN gross_paise > 0 THEN cast(floor(gap_paise * 200 / gross_paise::DOUBLE + 1e-12) AS BIGINT) END AS h,
 CASE WHEN amount_paise < 100000 THEN '<1k' WHEN amount_paise < 1000000 THEN '1k-10k' WHEN amount_paise < 10000000 THEN '10k-1L' WHEN amount_paise < 100000000 THEN '1L-10L' ELSE '>10L' END AS band FROM found),
 q1 AS (SELECT *, CASE WHEN category = 'duplicate_ledger_entry' THEN 'escalate' WHEN category = 'amount_variance' AND NOT explained THEN 'escalate' WHEN category = 'amount_variance' AND conf >= 0.94 THEN 'auto' ELSE 'escalate' END AS tier,
 CASE WHEN category = 'missing_in_bank' THEN on_date + 2 END AS deadline,
 category || '|' || coalesce((h // 2) || (CASE WHEN h % 2 = 1 THEN '.5' ELSE '' END) || '-' || ((h + 1) // 2) || (CASE WHEN h % 2 = 0 THEN '.5' ELSE '' END) || '%', 'gross=0') || '|' || band AS cluster_key FROM q0),
 q2 AS (SELECT *, count(*) OVER (PARTITION BY cluster_key) AS cluster_size, CASE tier WHEN 'auto' THEN 'resolved' ELSE 'open' END AS status, deadline - DATE '{TODAY}' AS days_left FROM q1),
 q3 AS (SELECT *, CASE WHEN deadline IS NULL THEN 0 WHEN days_left <= 2 THEN 1 WHEN days_left >= 30 THEN 0 ELSE round_even(cast(1 - (days_left - 2) / 28.0 AS DECIMAL(20,12)), 4) END AS urgency FROM q2),
 q AS (SELECT *, round(0.40 * least(log10(amount_paise + 1) / 9, 1) + 0.25 * (tier = 'escalate')::INT + 0.15 * (1 - conf::DOUBLE) + 0.15 * urgency::DOUBLE + 0.05 * least(cluster_size / 20.0, 1), 2) AS priority2,
 CASE WHEN deadline <= DATE '{TODAY}' THEN 'act_today' WHEN deadline IS NOT NULL THEN 'act_today' WHEN category IN ('missing_in_ledger', 'duplicate_ledger_entry', 'revenue_booked_not_settled', 'amount_variance') THEN 'books_fix' WHEN tier = 'escalate' THEN 'act_today' ELSE 'waiting' END AS action_group FROM q3)"""


@query(FINDINGS + " SELECT subject, category, amount_paise, gap_paise, gross_paise, on_date FROM found")
def exception_findings(spark, sf_dir):
    return findings(spark, sf_dir)


@query(QUEUE + " SELECT subject, category, tier, status, deadline, cluster_key, cluster_size, action_group FROM q")
def exception_queue(spark, sf_dir):
    return queue(spark, sf_dir).select("subject", "category", "tier", "status", "deadline", "cluster_key", "cluster_size", "action_group")


@query(QUEUE + " SELECT subject, cast(urgency AS DOUBLE) AS urgency FROM q")
def exception_urgency(spark, sf_dir):
    return queue(spark, sf_dir).select("subject", F.col("urgency").cast("double").alias("urgency"))


@query(QUEUE + ", c AS (SELECT category, count(*) AS n, sum(amount_paise)::BIGINT AS total_paise FROM q GROUP BY category) SELECT * FROM c")
def exceptions_by_category(spark, sf_dir):
    return queue(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("total_paise"))


@query(QUEUE + " SELECT cluster_key, count(*) AS n, sum(amount_paise)::BIGINT AS total_paise, CASE max(CASE tier WHEN 'escalate' THEN 2 WHEN 'monitor' THEN 1 ELSE 0 END) WHEN 2 THEN 'escalate' WHEN 1 THEN 'monitor' ELSE 'auto' END AS tier FROM q GROUP BY cluster_key HAVING count(*) >= 2")
def exception_clusters(spark, sf_dir):
    return exceptions.clusters(queue(spark, sf_dir))


@query(QUEUE + " SELECT tier, category, grouping_id(tier, category) AS level, count(*) AS n, sum(gap_paise)::BIGINT AS gap_paise, max(gap_paise) AS largest_paise FROM q GROUP BY GROUPING SETS ((tier), (category), ())")
def daily_digest(spark, sf_dir):
    queue(spark, sf_dir).createOrReplaceTempView("digest_queue")
    return spark.sql("SELECT tier, category, grouping_id(tier, category) AS level, count(*) AS n, sum(gap_paise) AS gap_paise, max(gap_paise) AS largest_paise FROM digest_queue GROUP BY GROUPING SETS ((tier), (category), ())")


@query(QUEUE + " SELECT action_group, status, count(*) AS n, sum(amount_paise)::BIGINT AS total_paise FROM q WHERE status = 'open' GROUP BY 1, 2")
def open_by_action(spark, sf_dir):
    return queue(spark, sf_dir).filter("status = 'open'").groupBy("action_group", "status").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("total_paise"))


@query(QUEUE + f" SELECT subject, deadline FROM q WHERE status = 'open' AND deadline BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 2")
def deadline_window(spark, sf_dir):
    now = F.lit(TODAY).cast("date")
    return queue(spark, sf_dir).filter((F.col("status") == "open") & F.col("deadline").between(now, F.date_add(now, 2))).select("subject", "deadline")


@query(QUEUE + """, due AS (SELECT subject, deadline, amount_paise, unnest([deadline - 2, deadline - 1, deadline]) AS today FROM q WHERE status = 'open' AND deadline IS NOT NULL)
 SELECT today, count(*) AS n, sum(amount_paise)::BIGINT AS amount_paise, min(subject) AS first_subject FROM due GROUP BY today""")
def deadline_calendar(spark, sf_dir):
    """For every day on which something open falls due within two days: how many, and what they are worth."""
    rows = queue(spark, sf_dir).filter("status = 'open' and deadline is not null")
    days = rows.withColumn("today", F.explode(F.array(F.date_sub("deadline", 2), F.date_sub("deadline", 1), F.col("deadline"))))
    return days.groupBy("today").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("amount_paise"), F.min("subject").alias("first_subject"))


@query(QUEUE + " SELECT subject, amount_paise FROM q WHERE amount_paise < 20000000 OR (amount_paise = 20000000 AND subject < 'S5') ORDER BY amount_paise DESC, subject DESC LIMIT 51")
def exception_page(spark, sf_dir):
    return exceptions.page(queue(spark, sf_dir).select("subject", "amount_paise"), "amount_paise", "subject", 50, (20_000_000, "S5"))


@query(QUEUE + """, s AS (SELECT subject, sha256(concat_ws(chr(31), category, '-', '-', band, coalesce((h // 2) || (CASE WHEN h % 2 = 1 THEN '.5' ELSE '' END) || '-' || ((h + 1) // 2) || (CASE WHEN h % 2 = 0 THEN '.5' ELSE '' END) || '%', 'gross=0'))) AS signature FROM q)
 SELECT signature, count(*) AS n, min(subject) AS first_subject FROM s GROUP BY signature""")
def learning_signatures(spark, sf_dir):
    rows = findings(spark, sf_dir)
    signature = F.sha2(F.concat_ws("\x1f", "category", F.lit("-"), F.lit("-"), scoring.amount_band(F.col("amount_paise")), scoring.gap_shape(F.col("gap_paise"), F.col("gross_paise"))), 256)
    return rows.select(signature.alias("signature"), "subject").groupBy("signature").agg(F.count("*").alias("n"), F.min("subject").alias("first_subject"))


@query(FINDINGS + """, g AS (SELECT category, CASE WHEN gross_paise > 0 THEN cast(floor(gap_paise * 200 / gross_paise::DOUBLE + 1e-12) AS BIGINT) END AS h, gap_paise, gross_paise, gap_paise * 10000 // gross_paise AS bp FROM found WHERE category <> 'duplicate_ledger_entry' AND gross_paise > 0)
 SELECT category, h, count(*) AS support, quantile_disc(bp, 0.5) AS rate_bp, max(gap_paise) AS worst_paise FROM g GROUP BY category, h HAVING count(*) >= 3""")
def learned_drafts(spark, sf_dir):
    rows = findings(spark, sf_dir).filter("category <> 'duplicate_ledger_entry' and gross_paise > 0")
    halves = F.floor(F.col("gap_paise").cast("decimal(20,0)") * 200 / F.col("gross_paise").cast("decimal(20,0)")).cast("bigint")
    rows = rows.select("category", halves.alias("h"), "gap_paise", F.expr("gap_paise * 10000 div gross_paise").alias("bp"))
    return rows.groupBy("category", "h").agg(F.count("*").alias("support"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY bp)").cast("bigint").alias("rate_bp"), F.max("gap_paise").alias("worst_paise")).filter("support >= 3")


@query(FINDINGS + """, b AS (SELECT subject, category, gap_paise FROM found), a AS (SELECT subject, category, CASE WHEN cast(substr(subject, 2) AS BIGINT) % 5 = 0 THEN gap_paise - 1 ELSE gap_paise END AS gap_paise FROM found WHERE cast(substr(subject, 2) AS BIGINT) % 7 <> 0)
 SELECT coalesce(a.subject, b.subject) AS subject, CASE WHEN b.subject IS NULL THEN 'added' WHEN a.subject IS NULL THEN 'removed' WHEN a.category = b.category AND a.gap_paise = b.gap_paise THEN 'unchanged' ELSE 'changed' END AS change,
 b.gap_paise AS gap_before, a.gap_paise AS gap_after FROM b FULL OUTER JOIN a ON a.subject = b.subject""")
def run_diff(spark, sf_dir):
    before = settled(findings(spark, sf_dir), "diff-before")
    number = F.substring("subject", 2, 20).cast("bigint")
    after = before.filter(number % 7 != 0).withColumn("gap_paise", F.when(number % 5 == 0, F.col("gap_paise") - 1).otherwise(F.col("gap_paise")))
    return exceptions.changed(before, after)


@query(FINDINGS + f""", s AS (SELECT subject, CASE WHEN h % 3 = 0 THEN 'monitoring' WHEN h % 3 = 1 THEN 'snoozed' ELSE 'open' END AS status, cast(h % 4 AS INT) AS rechecks, on_date + 2 AS recheck_on, h % 11 = 0 AS hit FROM (SELECT *, cast(substr(subject, 2) AS BIGINT) AS h FROM found)),
 d AS (SELECT *, status <> 'open' AND recheck_on <= DATE '{TODAY}' AS due FROM s)
 SELECT subject, CASE WHEN NOT due THEN status WHEN hit THEN 'resolved' WHEN status = 'snoozed' THEN 'open' WHEN rechecks + 1 >= 3 THEN 'escalated' ELSE 'monitoring' END AS status,
 CASE WHEN due AND NOT hit AND status = 'monitoring' THEN rechecks + 1 ELSE rechecks END AS rechecks, CASE WHEN due AND NOT hit AND status = 'monitoring' AND rechecks + 1 < 3 THEN recheck_on + 2 ELSE recheck_on END AS recheck_on FROM d""")
def recheck(spark, sf_dir):
    h = F.substring("subject", 2, 20).cast("bigint")
    rows = findings(spark, sf_dir).select("subject", F.when(h % 3 == 0, "monitoring").when(h % 3 == 1, "snoozed").otherwise("open").alias("status"), (h % 4).cast("int").alias("rechecks"), F.date_add("on_date", 2).alias("recheck_on"))
    return exceptions.transitions(rows, TODAY, rows.filter(h % 11 == 0).select("subject"))


CASES = CTES + """, c AS (SELECT event_id, fee_paise AS gap, amount_paise + fee_paise AS gross, method FROM gateway WHERE txn_type = 'payment'),
 r1 AS (SELECT *, CASE method WHEN 'card' THEN cast(round(gross * 0.02) AS BIGINT) + cast(round(cast(round(gross * 0.02) AS BIGINT) * 0.18) AS BIGINT) WHEN 'upi' THEN cast(round(gross * 0.005) AS BIGINT) + cast(round(cast(round(gross * 0.005) AS BIGINT) * 0.18) AS BIGINT) END AS t FROM c),
 s1 AS (SELECT *, t > 0 AND t <= gross AS ok, greatest(100, 1) AS tl FROM r1), a1 AS (SELECT event_id, gross, method, gap, ok AND abs(gap - t) <= tl AS full1, ok AND NOT abs(gap - t) <= tl AND t < gap AS part1, t FROM s1),
 x1 AS (SELECT *, CASE WHEN coalesce(full1 OR part1, false) THEN gap - t ELSE gap END AS l1, coalesce(full1, false) AS d1 FROM a1),
 r2 AS (SELECT *, CASE WHEN method = 'netbanking' THEN cast(round(gross * 0.05) AS BIGINT) END AS t2, greatest(100, cast(round(abs(l1) * 0.01) AS BIGINT), 1) AS tl2 FROM x1),
 x2 AS (SELECT *, coalesce(NOT d1 AND t2 > 0 AND abs(l1 - t2) <= tl2, false) AS f2, coalesce(NOT d1 AND t2 > 0 AND t2 < l1 AND NOT abs(l1 - t2) <= tl2, false) AS p2 FROM r2),
 y2 AS (SELECT *, CASE WHEN f2 OR p2 THEN l1 - t2 ELSE l1 END AS l2, d1 OR f2 AS d2 FROM x2),
 r3 AS (SELECT *, cast(round(gross * 0.01) AS BIGINT) AS t3 FROM y2), x3 AS (SELECT *, NOT d2 AND t3 > 0 AND abs(l2 - t3) <= 100 AS f3, NOT d2 AND t3 > 0 AND t3 < l2 AND NOT abs(l2 - t3) <= 100 AS p3 FROM r3),
 y3 AS (SELECT *, CASE WHEN f3 OR p3 THEN l2 - t3 ELSE l2 END AS l3, d2 OR f3 AS d3 FROM x3),
 r4 AS (SELECT *, cast(round(gross * 0.03) AS BIGINT) + cast(round((gross - cast(round(gross * 0.03) AS BIGINT)) * 0.01) AS BIGINT) AS t4 FROM y3), x4 AS (SELECT *, NOT d3 AND t4 > 0 AND abs(l3 - t4) <= 100 AS f4, NOT d3 AND t4 > 0 AND t4 < l3 AND NOT abs(l3 - t4) <= 100 AS p4 FROM r4),
 fold AS (SELECT event_id, method, gross, gap, gap - (CASE WHEN f4 OR p4 THEN l3 - t4 ELSE l3 END) AS explained_paise, (CASE WHEN f4 OR p4 THEN l3 - t4 ELSE l3 END) AS residual_paise, d3 OR f4 AS fully_explained FROM x4)"""


def cases(spark, sf_dir):
    rows = source(spark, sf_dir, "gateway").filter("txn_type = 'payment'")
    return rows.select("event_id", "method", "counterparty", F.col("txn_date").alias("on_date"), (F.col("amount_paise") + F.col("fee_paise")).alias("gross_paise"), F.col("fee_paise").alias("gap_paise"), F.lit(1).alias("n_txns"))


@query(CASES + " SELECT event_id, explained_paise, residual_paise, fully_explained FROM fold")
def rule_gaps(spark, sf_dir):
    return rules.apply_rules(cases(spark, sf_dir), rules.STARTER).select("event_id", "explained_paise", "residual_paise", "fully_explained")


@query(CASES + " SELECT method, count(*) AS n, sum(gap)::BIGINT AS gap_paise, sum(explained_paise)::BIGINT AS explained_paise, count(*) FILTER (fully_explained) AS n_full FROM fold GROUP BY method")
def explained_by_method(spark, sf_dir):
    done = rules.apply_rules(cases(spark, sf_dir), rules.STARTER)
    return done.groupBy("method").agg(F.count("*").alias("n"), F.sum("gap_paise").alias("gap_paise"), F.sum("explained_paise").alias("explained_paise"), F.count_if("fully_explained").alias("n_full"))


@query(CTES + """, c AS (SELECT fee_paise AS gap, amount_paise + fee_paise AS gross, on_hold FROM gateway WHERE txn_type = 'payment' AND method = 'netbanking'),
 t AS (SELECT gap, on_hold, cast(round(gross * 0.05) AS BIGINT) AS t FROM c), x AS (SELECT on_hold, t, t > 0 AND abs(gap - t) <= greatest(100, cast(round(abs(gap) * 0.01) AS BIGINT), 1) AS closed FROM t)
 SELECT count(*) AS n_cases, count(*) FILTER (closed) AS n_closed, count(*) FILTER (closed AND on_hold) AS n_wrong, coalesce(sum(t) FILTER (closed), 0)::BIGINT AS explained_paise, CASE WHEN count(*) FILTER (closed AND on_hold) > 0 THEN 'discard' WHEN count(*) FILTER (closed) >= 3 THEN 'activate' ELSE 'adjust' END AS advice FROM x""")
def rule_backtest(spark, sf_dir):
    rows = source(spark, sf_dir, "gateway").filter("txn_type = 'payment' and method = 'netbanking'")
    rows = rows.select("method", "counterparty", F.col("txn_date").alias("on_date"), (F.col("amount_paise") + F.col("fee_paise")).alias("gross_paise"), F.col("fee_paise").alias("gap_paise"), F.lit(1).alias("n_txns"), F.when(F.col("on_hold"), "chargeback_unrecorded").otherwise("amount_variance").alias("category"))
    return rules.backtest(rows, rules.STARTER[2])


@query(CTES + SUMS + """, b AS (SELECT sum(amount_paise) AS received FROM bank), g AS (SELECT sum(gross_paise) AS gross, sum(fee_paise) AS fee, sum(additions_paise) AS added, sum(expected_net_paise) AS net FROM arith),
 m AS (SELECT sum(expected_net_paise) AS missing FROM arith WHERE settlement_id NOT IN (SELECT 'S' || batch FROM bank)), v AS (SELECT sum(a.expected_net_paise - b.amount_paise) AS variance FROM arith a JOIN bank b ON a.settlement_id = 'S' || b.batch)
 SELECT gross::BIGINT AS gross_paise, fee::BIGINT AS fee_paise, added::BIGINT AS additions_paise, net::BIGINT AS expected_paise, missing::BIGINT AS missing_paise, variance::BIGINT AS variance_paise, received::BIGINT AS received_paise, (net - missing - variance - received)::BIGINT AS unexplained_paise FROM g, m, v, b""")
def cash_bridge(spark, sf_dir):
    gateway, bank, _ = derived(spark, sf_dir)
    sums = settlements.arithmetic(gateway)
    bank = settlements.named(bank, gateway).select("settlement_id", F.col("amount_paise").alias("received"))
    rows = sums.join(bank, "settlement_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    out = rows.agg(total("gross_paise").alias("gross_paise"), total("fee_paise").alias("fee_paise"), total("additions_paise").alias("additions_paise"), total("expected_net_paise").alias("expected_paise"),
                   total(F.when(F.col("received").isNull(), F.col("expected_net_paise"))).alias("missing_paise"), total(F.col("expected_net_paise") - F.col("received")).alias("variance_paise"), total("received").alias("received_paise"))
    return out.withColumn("unexplained_paise", F.col("expected_paise") - F.col("missing_paise") - F.col("variance_paise") - F.col("received_paise"))


@query(CTES + """, l AS (SELECT batch, sum(amount_paise) AS booked FROM ledger GROUP BY batch), x AS (SELECT coalesce(b.batch, l.batch) AS batch, coalesce(b.amount_paise, 0) AS bank, coalesce(l.booked, 0) AS books, b.batch IS NULL AS nb, l.batch IS NULL AS nl FROM bank b FULL OUTER JOIN l ON b.batch = l.batch)
 SELECT CASE WHEN nb THEN 'only in books' WHEN nl THEN 'only in bank' WHEN bank = books THEN 'agreed' WHEN books >= 2 * bank - 100 THEN 'booked twice' ELSE 'different amount' END AS bucket, count(*) AS n, sum(books - bank)::BIGINT AS difference_paise FROM x GROUP BY 1""")
def books_against_bank(spark, sf_dir):
    gateway, bank, ledger = derived(spark, sf_dir)
    tasks = tasks_for(gateway)
    own = F.coalesce("settlement_id", "event_id").alias("own")  # a row that names no settlement stands alone
    of = lambda rows, amount: dealt(settlements.named(rows, gateway, tasks).select(own, F.col("amount_paise").alias(amount)), tasks, "own")
    books = of(ledger, "books").groupBy("own").agg(F.sum("books").alias("books"))
    rows = of(bank, "bank").join(books, "own", "full_outer")
    bank, book = F.coalesce("bank", F.lit(0)), F.coalesce("books", F.lit(0))
    bucket = F.when(F.col("bank").isNull(), "only in books").when(F.col("books").isNull(), "only in bank").when(bank == book, "agreed").when(book >= 2 * bank - 100, "booked twice").otherwise("different amount")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(book - bank).cast("bigint").alias("difference_paise"))
