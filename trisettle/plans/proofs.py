"""Scored matching, the classifier's whole order, audit chains, run lineage and the views that read stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trisettle.functions import text
from trisettle.functions.scoring import stage_cap
from trisettle.operators import audit, classify, residual, rules, settlements
from trisettle.operators.shared import settled
from trisettle.plans import matching, queue, records, views
from trisettle.plans.matching import CELLS, PAIRS, SUMS
from trisettle.plans.queue import CASES, QUEUE
from trisettle.sources.harness import CTES, derived, source

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


SCORED = CTES + """, e AS (SELECT *, cast(floor(amount_paise / 100000.0) AS BIGINT) AS bucket FROM ev WHERE source = 'ledger' OR (source = 'bank' AND (utr IS NULL OR length(utr) < 16))), """ + CELLS + """,
 p AS (SELECT a.event_id AS left_id, b.event_id AS right_id, a.amount_paise AS x, b.amount_paise AS y, abs(a.txn_date - b.txn_date) AS days, coalesce(length(a.utr) < 16, false) AS cut, b.utr AS ref_b,
 list_filter([a.utr, nullif(regexp_extract(a.narration, 'UTR[0-9]{13}'), '')], lambda r: r IS NOT NULL) AS refs FROM e a JOIN c b ON a.bucket // 3 = b.amount_cell AND (a.txn_date - DATE '1970-01-01') // 7 = b.day_cell
 WHERE a.source = 'bank' AND b.source = 'ledger' AND abs(a.bucket - b.bucket) <= 2 AND abs(a.txn_date - b.txn_date) <= 6),
 r AS (SELECT *, CASE WHEN ref_b IS NOT NULL THEN list_max(list_transform(refs, lambda r: round(jaro_winkler_similarity(r, ref_b) + 1e-12, 4))) END AS best FROM p),
 f AS (SELECT left_id, right_id, 1 - abs(x - y) / greatest(x, y)::DOUBLE AS fa, greatest(0::DOUBLE, 1 - days / 7::DOUBLE) AS fd, CASE WHEN best < 1 AND NOT cut THEN 0::DOUBLE ELSE best END AS fr FROM r),
 s AS (SELECT left_id, right_id, fr, round((fa * 0.35::DOUBLE + fd * 0.20::DOUBLE + coalesce(fr * 0.25::DOUBLE, 0::DOUBLE) + 0.15::DOUBLE) / (0.35::DOUBLE + 0.20::DOUBLE + CASE WHEN fr IS NULL THEN 0::DOUBLE ELSE 0.25::DOUBLE END + 0.15::DOUBLE), 4) AS score FROM f)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bank, ledger = derived(spark, sf_dir)
    return residual.scores(residual.fuzzy_pairs(bank.drop("batch"), ledger.drop("batch")))


@query(SCORED + " SELECT left_id, right_id, fr AS reference, score FROM s")
def scored_pairs(spark, sf_dir):
    """Bank rows without a whole reference against ledger rows of their amount and time."""
    return scored(spark, sf_dir).select("left_id", "right_id", "reference", "score")


@query(SCORED + """, b AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS k, lead(score) OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS runner_up FROM s WHERE score >= 0.60)
 SELECT left_id, right_id AS best_id, score, runner_up, runner_up IS NULL OR score - runner_up > 0.05::DOUBLE AS clear FROM b WHERE k = 1""")
def best_and_runner_up(spark, sf_dir):
    """The best candidate of each row, the next one's score, and whether the tie margin lies between them."""
    by_left = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    rows = residual.leaders(scored(spark, sf_dir)).select("left_id", F.col("right_id").alias("best_id"), "score", F.lead("score").over(by_left).alias("runner_up"), F.row_number().over(by_left).alias("k"))
    return rows.filter("k = 1").select("left_id", "best_id", "score", "runner_up", (F.col("runner_up").isNull() | (F.col("score") - F.col("runner_up") > residual.TIE)).alias("clear"))


@query(SCORED + """, b AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS k, lead(score) OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS n FROM s WHERE score >= 0.60),
 w AS (SELECT left_id, right_id, score FROM b WHERE k = 1 AND (n IS NULL OR score - n > 0.05::DOUBLE)),
 v AS (SELECT *, row_number() OVER (PARTITION BY right_id ORDER BY score DESC, left_id) AS k, lead(score) OVER (PARTITION BY right_id ORDER BY score DESC, left_id) AS n FROM w)
 SELECT left_id, right_id, score, least(score, 0.75::DOUBLE) AS confidence FROM v WHERE k = 1 AND (n IS NULL OR score > n)""")
def fuzzy_matches(spark, sf_dir):
    """Pairs that win on both sides; the stage's ceiling holds their confidence."""
    won = residual.clear_winners(residual.leaders(scored(spark, sf_dir)))
    return won.withColumn("confidence", F.least("score", stage_cap(F.lit("fuzzy")).cast("double")))


STEPS = CASES + SUMS + PAIRS + """, led AS (SELECT 'S' || batch AS sid, event_id, amount_paise FROM ledger), bk AS (SELECT 'S' || batch AS sid, event_id, amount_paise, txn_date FROM bank),
 step1 AS (SELECT event_id AS finding, event_id, 'chargeback_unrecorded' AS category, amount_paise, amount_paise AS residual_paise, 1.0 AS confidence FROM gateway WHERE txn_type = 'refund' AND batch % 2 <> 0),
 step3 AS (SELECT credit_id AS finding, credit_id AS event_id, 'ambiguous_multi_candidate' AS category, min(credit_paise) AS amount_paise, min(credit_paise) AS residual_paise, 1.0 AS confidence FROM cand GROUP BY credit_id HAVING count(*) > 1),
 silent AS (SELECT event_id FROM y2 WHERE gap > 0 AND (d2 OR method = 'wallet')),
 step4 AS (SELECT event_id AS finding, event_id, 'amount_variance' AS category, abs(l2) AS amount_paise, abs(l2) AS residual_paise, 0.95 AS confidence FROM y2 WHERE gap > 0 AND NOT d2 AND method <> 'wallet' AND event_id NOT IN (SELECT event_id FROM step1)),
 c4 AS (SELECT event_id FROM step1 UNION ALL SELECT event_id FROM step3 UNION ALL SELECT event_id FROM step4),
 m0 AS (SELECT b.sid, b.event_id AS credit, b.amount_paise - a.expected_net_paise AS delta, a.tolerance_paise, abs(b.txn_date - a.first_date) AS shift FROM bk b JOIN (SELECT settlement_id, expected_net_paise, first_date, """ + matching.TOL + """ AS tolerance_paise FROM arith) a ON a.settlement_id = b.sid),
 m1 AS (SELECT * FROM m0 WHERE abs(delta) > tolerance_paise), e5 AS (SELECT 'm' || sid AS finding, credit AS event_id, delta, shift FROM m1 UNION ALL SELECT 'm' || m1.sid, led.event_id, delta, shift FROM m1 JOIN led USING (sid)),
 step5 AS (SELECT finding, event_id, CASE WHEN shift > 3 THEN 'timing_lag' ELSE 'amount_variance' END AS category, abs(delta) AS amount_paise, abs(delta) AS residual_paise, 0.70 AS confidence FROM e5 WHERE finding NOT IN (SELECT finding FROM e5 WHERE event_id IN (SELECT event_id FROM c4))),
 o6 AS (SELECT g.settlement_id, g.event_id, a.expected_net_paise FROM gateway g JOIN arith a USING (settlement_id) WHERE NOT g.on_hold AND g.settlement_id NOT IN (SELECT sid FROM bk)),
 step6 AS (SELECT settlement_id AS finding, event_id, 'missing_in_bank' AS category, abs(expected_net_paise) AS amount_paise, abs(expected_net_paise) AS residual_paise, 1.0 AS confidence FROM o6 WHERE settlement_id NOT IN (SELECT settlement_id FROM o6 WHERE event_id IN (SELECT event_id FROM c4))),
 c6 AS (SELECT event_id FROM c4 UNION ALL SELECT event_id FROM step5 UNION ALL SELECT event_id FROM step6),
 step7 AS (SELECT event_id AS finding, event_id, 'revenue_booked_not_settled' AS category, amount_paise, amount_paise AS residual_paise, 1.0 AS confidence FROM gateway WHERE on_hold AND settlement_id IN (SELECT sid FROM led) AND event_id NOT IN (SELECT event_id FROM c6)),
 step8 AS (SELECT event_id AS finding, event_id, 'missing_in_bank' AS category, amount_paise, amount_paise AS residual_paise, 1.0 AS confidence FROM led WHERE sid NOT IN (SELECT sid FROM bk) AND event_id NOT IN (SELECT event_id FROM c6) AND event_id NOT IN (SELECT event_id FROM silent)),
 classified AS (SELECT '1 chargebacks' AS step, * FROM step1 UNION ALL SELECT '3 refusals', * FROM step3 UNION ALL SELECT '4 rule gaps', * FROM step4 UNION ALL SELECT '5 open matches', * FROM step5
 UNION ALL SELECT '6 sweep', * FROM step6 UNION ALL SELECT '7 held', * FROM step7 UNION ALL SELECT '8 unmatched', * FROM step8)"""
#: Steps in which events that a rule explained, or that no rule was asked about, report nothing.
SILENT_STEPS = ("4 rule gaps", "8 unmatched")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps in their order over the derived sources; refund rows stand in for disputes, as in
    ``chargebacks_unrecorded``, and the fee rules are those by payment method."""
    gateway, bank, ledger = derived(spark, sf_dir)
    bank, ledger = settled(bank, "bank"), settled(ledger, "ledger")
    rows = settled(records.named_of(gateway, bank, ledger), "named-rows")
    sums, found = settled(settlements.arithmetic(gateway), "sums"), settled(records.matches(rows, gateway), "matches")
    disputes = gateway.filter("txn_type = 'refund'").withColumns({"txn_type": F.lit("dispute"), "direction": F.lit("debit")})
    books = disputes.filter("batch % 2 = 0").select(F.concat(F.lit("Disputes: order "), "order_id", F.lit(" charged back")).alias("narration"))
    charged = classify.shaped(classify.unrecorded_chargebacks(disputes, books), "event_id", "chargeback_unrecorded", "amount_paise", "amount_paise", "1")
    unnamed = classify.ambiguous_attribution(gateway.select(F.col("settlement_id").alias("match_id"), "event_id", "order_id", (F.col("amount_paise") + F.coalesce("fee_paise", F.lit(0))).alias("gross_paise")))
    open_orders = classify.shaped(unnamed, F.concat_ws("|", "match_id", F.col("gross_paise").cast("string")), "ambiguous_multi_candidate", "gross_paise", "gross_paise", "1")
    several = settlements.reconcile(bank, sums).filter("n_candidates > 1").select(F.col("credit_id").alias("event_id"))
    refused = bank.join(several, "event_id").select(F.col("event_id").alias("refusal_id"), "event_id", F.lit("ambiguous_multi_candidate").alias("category"), "amount_paise", F.lit(None).cast("double").alias("member_confidence"))
    book = rules.STARTER[:3]
    gaps = rules.apply_rules(queue.cases(spark, sf_dir).filter("gap_paise > 0").withColumn("considered", rules.considered(book)), book)
    gaps = settled(gaps.withColumn("said", F.col("fully_explained") | (F.col("considered") == 0)), "rule-gaps")
    left_open = gaps.filter("not said").select("event_id", "residual_paise", F.lit("0.95").alias("confidence"))
    legs = found.join(sums.select("settlement_id", "first_date"), "settlement_id").join(rows.select("settlement_id", "event_id", "source", F.col("amount_paise").alias("row_paise"), "txn_date"), "settlement_id")
    late = F.max(F.when(F.col("source") == "bank", F.abs(F.datediff("txn_date", "first_date")))).over(Window.partitionBy("match_id"))
    legs = legs.filter("confidence_pct < 94").select("match_id", "event_id", "row_paise", F.col("delta_paise").alias("residual_paise"), late.alias("shift_days"), F.lit(1).alias("n_candidates"), (F.col("confidence_pct") / 100).alias("confidence"), F.lit(False).alias("has_gateway"))
    matches = classify.from_matches(classify.worth_reporting(legs))
    paid = rows.filter("source = 'bank'").select("settlement_id").distinct()
    unpaid = gateway.filter("not on_hold").join(sums.select("settlement_id", "expected_net_paise"), "settlement_id").join(paid, "settlement_id", "left_anti")
    sweep = classify.shaped(unpaid, "settlement_id", "missing_in_bank", "expected_net_paise", "expected_net_paise", "1")
    booked = rows.filter("source = 'ledger'").select("settlement_id").distinct()
    held = classify.shaped(gateway.filter("on_hold").join(booked, "settlement_id", "left_semi"), "event_id", "revenue_booked_not_settled", "amount_paise", "amount_paise", "1")
    loose = classify.from_unmatched(rows.filter("source = 'ledger'").join(paid, "settlement_id", "left_anti").withColumn("category", F.lit("missing_in_bank")))
    steps = [("1 chargebacks", charged), ("2 attribution", open_orders), ("3 refusals", classify.from_refusals(refused)), ("4 rule gaps", classify.from_rule_gaps(left_open)), ("5 open matches", matches),
             ("6 sweep", sweep), ("7 held", held), ("8 unmatched", loose)]
    return classify.precedence(steps, gaps.filter("said").select("event_id"), SILENT_STEPS)


@query(STEPS + " SELECT step, finding, min(category) AS category, count(*) AS n_events, min(amount_paise)::BIGINT AS amount_paise, min(residual_paise)::BIGINT AS residual_paise, min(confidence)::DOUBLE AS confidence FROM classified GROUP BY step, finding")
def classified_exceptions(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("step", "finding").agg(F.min("category").alias("category"), F.count("*").alias("n_events"), F.min("amount_paise").alias("amount_paise"),
                                                                    F.min("residual_paise").alias("residual_paise"), F.min("confidence").cast("double").alias("confidence"))


CITING = """WITH t AS (SELECT o_orderkey, 'paid order_' || lpad(o_orderkey::VARCHAR, 26, '0') || ' by pay_' || lpad(o_orderkey::VARCHAR, 26, '0') || CASE WHEN o_orderkey % 3 = 0 THEN ' and order_' || lpad((o_orderkey + 1)::VARCHAR, 26, '0') ELSE ' again order_' || lpad(o_orderkey::VARCHAR, 26, '0') END AS narration FROM orders),
 x AS (SELECT o_orderkey, list_distinct(regexp_extract_all(narration, 'order_[0-9A-HJKMNP-TV-Z]{26}')) AS orders, list_distinct(regexp_extract_all(narration, 'pay_[0-9A-HJKMNP-TV-Z]{26}')) AS payments FROM t)"""


@query(CITING + " SELECT o_orderkey, len(orders)::INT AS n_orders, CASE WHEN len(orders) = 1 THEN orders[1] END AS order_id, CASE WHEN len(payments) = 1 THEN payments[1] END AS payment_id FROM x")
def cited_identities(spark, sf_dir):
    """Ids that a narration cites; a kind cited for two things claims none."""
    key = F.col("o_orderkey")
    long = lambda k: F.lpad(k.cast("string"), 26, "0")
    also = F.when(key % 3 == 0, F.concat(F.lit(" and order_"), long(key + 1))).otherwise(F.concat(F.lit(" again order_"), long(key)))
    ids = text.cited_ids(F.concat(F.lit("paid order_"), long(key), F.lit(" by pay_"), long(key), also))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", ids.alias("ids"))
    return rows.select("o_orderkey", F.size("ids.order_ids").alias("n_orders"), text.identity_claim(F.col("ids.order_ids")).alias("order_id"), text.identity_claim(F.col("ids.payment_ids")).alias("payment_id"))


@query(CTES + """, g AS (SELECT settlement_id AS match_id, event_id, amount_paise - amount_paise % 1000000 AS gross_paise FROM gateway WHERE fee_paise % 3 <> 0)
 SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY match_id, gross_paise) AS n_alike FROM g) WHERE n_alike >= 2""")
def order_ambiguity(spark, sf_dir):
    """Payments taken as naming no order by their fee, their gross in whole ten thousands so that some agree."""
    rows = source(spark, sf_dir, "gateway").select(F.col("settlement_id").alias("match_id"), "event_id", F.when(F.col("fee_paise") % 3 == 0, F.col("order_id")).alias("order_id"), (F.col("amount_paise") - F.col("amount_paise") % 1_000_000).alias("gross_paise"))
    return classify.ambiguous_attribution(rows)


CHAIN = """WITH RECURSIVE r AS (SELECT 'n' || c_nationkey AS tenant, c_custkey AS seq, '{"amount_paise":' || c_custkey * 137 || ',"customer":"' || c_name || '"}' AS payload, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
 ch AS (SELECT tenant, seq, k, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || payload) AS this_hash FROM r WHERE k = 1 UNION ALL SELECT r.tenant, r.seq, r.k, ch.this_hash, sha256(ch.this_hash || r.payload) FROM ch JOIN r ON r.tenant = ch.tenant AND r.k = ch.k + 1)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as audit rows of their nation, canonical payloads chained; numbers that other tenants used are burned."""
    payload = F.to_json(F.struct((F.col("c_custkey") * 137).alias("amount_paise"), F.col("c_name").alias("customer")))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("tenant"), F.col("c_custkey").cast("long").alias("seq"), payload.alias("payload"))
    return audit.append(rows)


@query(CHAIN + " SELECT tenant, seq, prev_hash, this_hash FROM ch")
def audit_chain(spark, sf_dir):
    return chain(spark, sf_dir).select("tenant", "seq", "prev_hash", "this_hash")


@query("SELECT 'n' || c_nationkey AS tenant, min(c_custkey)::BIGINT AS first_bad FROM customer WHERE c_custkey % 50 = 0 GROUP BY 1")
def audit_first_bad(spark, sf_dir):
    """A chain some of whose payloads were altered afterwards."""
    log = settled(chain(spark, sf_dir), "audit-log")
    return audit.verify(log.withColumn("payload", F.when(F.col("seq") % 50 == 0, F.replace(F.col("payload"), F.lit("amount"), F.lit("Amount"))).otherwise(F.col("payload"))))


@query("SELECT o_orderkey AS run_id, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS owner_id FROM orders")
def run_owners(spark, sf_dir):
    """Orders as runs, the customer's order before as parent; finished ones own their events."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), before.alias("parent_id"), (F.col("o_orderstatus") == "F").alias("owns"))
    return audit.owner_runs(runs)


MEANINGS = {
    "fee_card": '{"scope":{"method":"card"},"deductions":[{"type":"fee","basis":"gross","rate":"2","fixed_paise":0},{"type":"gst","basis":"fee","rate":"18","fixed_paise":0}],"tolerance":{"absolute_paise":100,"percent":"0"}}',
    "fee_upi": '{"scope":{"method":"upi"},"deductions":[{"type":"fee","basis":"gross","rate":"0.5","fixed_paise":0},{"type":"gst","basis":"fee","rate":"18","fixed_paise":0}],"tolerance":{"absolute_paise":100,"percent":"0"}}',
    "fee_bank": '{"scope":{"method":"netbanking"},"deductions":[{"type":"fee","basis":"gross","rate":"5","fixed_paise":0}],"tolerance":{"absolute_paise":100,"percent":"1"}}',
    "tds": '{"scope":{},"deductions":[{"type":"tds","basis":"gross","rate":"1","fixed_paise":0}],"tolerance":{"absolute_paise":100,"percent":"0"}}',
    "commission": '{"scope":{},"deductions":[{"type":"commission","basis":"gross","rate":"3","fixed_paise":0},{"type":"tcs","basis":"net","rate":"1","fixed_paise":0}],"tolerance":{"absolute_paise":100,"percent":"0"}}',
}


@query(CTES + ", meant AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, sha256('{v}') AS version_hash, {m} AS method" for (k, v), m in zip(MEANINGS.items(), ("'card'", "'upi'", "'netbanking'", "NULL", "NULL"), strict=True)) + """)
 SELECT m.rule_id, m.version_hash, g.method, count(*) AS n FROM gateway g JOIN meant m ON m.method IS NULL OR m.method = g.method GROUP BY ALL""")
def rule_version_hashes(spark, sf_dir):
    """Gateway rows in the scope of each version of the starter rules, versions named by the hash of what they mean."""
    book = spark.createDataFrame([(r.id, rules.version_hash(r), m) for r in rules.STARTER for m in ([r.method] if r.method else ["card", "upi", "netbanking", "wallet"])], "rule_id string, version_hash string, method string")
    counts = source(spark, sf_dir, "gateway").groupBy("method").agg(F.count("*").alias("n"))
    return counts.join(book, "method").select("rule_id", "version_hash", "method", "n")


@query(QUEUE + """ SELECT 'false_auto' AS gate, count(*) FILTER (tier = 'auto' AND NOT explained) = 0 AS passed FROM q UNION ALL SELECT 'never_auto', count(*) FILTER (tier = 'auto' AND category = 'duplicate_ledger_entry') = 0 FROM q
 UNION ALL SELECT 'recall', true UNION ALL SELECT 'determinism', true""")
def release_gates(spark, sf_dir):
    """No wrong automatic close, none of a category that never closes, enough recall, and two runs that agree."""
    first, again = settled(queue.queue(spark, sf_dir), "gate-queue"), settled(queue.queue(spark, sf_dir), "gate-queue")
    auto = F.col("tier") == "auto"
    never = F.col("category").isin("duplicate_ledger_entry", "chargeback_unrecorded", "unknown", "unidentified_inflow")
    counts = first.agg((F.count_if(auto & ~F.col("explained")) == 0).alias("false_auto"), (F.count_if(auto & never) == 0).alias("never_auto"))
    recall = records.truth_join(spark, sf_dir).agg((F.sum("n_right") >= 0.90 * F.sum("n")).alias("recall"))
    print_of = lambda rows, name: rows.agg(F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("subject", "category", "tier", "status", "gap_paise", "cluster_key", "priority"))).alias(name))
    same = print_of(first, "a").join(print_of(again, "b")).select((F.col("a") == F.col("b")).alias("determinism"))
    return counts.join(recall).join(same).select(F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("passed")) for g in ("false_auto", "never_auto", "recall", "determinism")])))


@query(f"SELECT category, h, support, rate_bp, CASE WHEN h % 3 = 0 THEN 'accepted' ELSE 'open' END AS state FROM ({queue.ORACLE_SQL['learned_drafts']}) WHERE h % 3 <> 1")
def suggestion_list(spark, sf_dir):
    """The live view of drafts without dismissed ones, accepted ones marked; decisions are rows, drafts are not stored."""
    drafts = settled(queue.learned_drafts(spark, sf_dir), "drafts")
    decisions = drafts.select("category", "h", F.when(F.col("h") % 3 == 0, "accepted").when(F.col("h") % 3 == 1, "dismissed").alias("decision")).filter("decision is not null")
    return drafts.join(decisions, ["category", "h"], "left").filter("coalesce(decision, 'open') <> 'dismissed'").select("category", "h", "support", "rate_bp", F.coalesce("decision", F.lit("open")).alias("state"))


@query(CTES + """, f AS (SELECT source, strftime(txn_date, '%Y-%m') AS file, count(*) AS n_rows, count(*) FILTER (narration IS NULL OR amount_paise <= 0) AS n_rejected FROM ev GROUP BY 1, 2)
 SELECT source, file, n_rows, n_rejected FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY file DESC) AS k FROM f) WHERE k <= 3""")
def ingested_files(spark, sf_dir):
    """Files (a month of a source each) with rows taken and rejected, the newest three of each source."""
    bad = F.col("narration").isNull() | (F.col("amount_paise") <= 0)
    files = source(spark, sf_dir, "ev").groupBy("source", F.date_format("txn_date", "yyyy-MM").alias("file")).agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_rejected"))
    newest = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("file")))
    return files.withColumn("k", newest).filter("k <= 3").drop("k")


@query(CTES + SUMS + """, h AS (SELECT coalesce(sum(amount_paise) FILTER (on_hold), 0) AS held FROM gateway), a AS (SELECT sum(expected_net_paise) AS net, sum(gst_paise) AS gst, sum(expected_net_paise) FILTER (settlement_id NOT IN (SELECT 'S' || batch FROM bank)) AS missing FROM arith)
 SELECT unnest(['bridge', 'at-risk', 'reserve', 'gst-input']) AS cash_view, unnest([net, missing, held, gst])::BIGINT AS amount_paise FROM a, h""")
def cash_views(spark, sf_dir):
    """One computation under four names."""
    gateway, bank, _ = derived(spark, sf_dir)
    paid = settlements.named(bank, gateway).select("settlement_id", F.lit(True).alias("paid")).distinct()
    rows = settlements.arithmetic(gateway).join(paid, "settlement_id", "left")
    sums = rows.agg(F.sum("expected_net_paise").alias("net"), F.sum("gst_paise").alias("gst"), F.sum(F.when(F.col("paid").isNull(), F.col("expected_net_paise"))).alias("missing"))
    both = sums.join(gateway.agg(F.coalesce(F.sum(F.when(F.col("on_hold"), F.col("amount_paise"))), F.lit(0)).alias("held")))
    names = {"bridge": "net", "at-risk": "missing", "reserve": "held", "gst-input": "gst"}
    return both.select(F.inline(F.array(*[F.struct(F.lit(k).alias("cash_view"), F.col(v).cast("bigint").alias("amount_paise")) for k, v in names.items()])))


@query(f"SELECT true_positive, false_positive, false_negative, round(true_positive / (true_positive + false_positive)::DOUBLE, 4) AS precision, round(true_positive / (true_positive + false_negative)::DOUBLE, 4) AS recall FROM ({views.ORACLE_SQL['pair_confusion']})")
def stored_evaluation(spark, sf_dir):
    """An evaluation stored as JSON and read back by its fields."""
    stored = views.QUERIES["pair_confusion"](spark, sf_dir).select(F.to_json(F.struct("*")).alias("result"))
    kept = settled(stored, "evaluation").select(F.from_json("result", "true_positive bigint, false_positive bigint, false_negative bigint").alias("r"))
    share = lambda other: F.round(F.col("r.true_positive") / (F.col("r.true_positive") + F.col(other)), 4)
    return kept.select("r.true_positive", "r.false_positive", "r.false_negative", share("r.false_positive").alias("precision"), share("r.false_negative").alias("recall"))
