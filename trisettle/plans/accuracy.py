"""Accuracy against a truth of its own: the corpus with planted faults, matched and then held against what is true."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trisettle.config import DEFAULT, Config
from trisettle.functions import text
from trisettle.operators import advise, bridge, cascade, classify, evaluate, learner, legs, paging, references, replay, rules
from trisettle.operators.shared import settled
from trisettle.sources import corpus

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Groups of the exact stage in SQL: keys that rows share, their closure, and the check of amounts.
EXACT = corpus.CTES.replace("WITH keys", "WITH RECURSIVE keys", 1) + """, facts AS (SELECT event_id, 'u' || utr AS key FROM corpus WHERE length(utr) >= 16 UNION SELECT event_id, 's' || settlement_id FROM corpus WHERE settlement_id IS NOT NULL
 UNION SELECT event_id, CASE WHEN txn_type IN ('refund', 'dispute') THEN 'r' ELSE 'p' END || order_id FROM corpus WHERE order_id IS NOT NULL UNION SELECT event_id, 's' || substr(narration, 19) FROM corpus WHERE source = 'ledger' AND narration LIKE 'Settlement credit %'),
 edges AS (SELECT DISTINCT a.key AS a, b.key AS b FROM facts a JOIN facts b USING (event_id) WHERE a.key <> b.key), reach(key, root) AS (SELECT DISTINCT key, key FROM facts UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.key),
 roots AS (SELECT key, min(root) AS root FROM reach GROUP BY key), comp AS (SELECT f.event_id, min(r.root) AS root FROM facts f JOIN roots r USING (key) GROUP BY 1),
 signed AS (SELECT c.*, comp.root, CASE WHEN (c.direction = 'credit') <> (c.source = 'ledger') THEN c.amount_paise ELSE -c.amount_paise END AS signed FROM corpus c JOIN comp USING (event_id)),
 gr AS (SELECT root, min(event_id) AS group_id, count(DISTINCT source) AS n_sources, sum(signed) FILTER (source = 'bank') AS bank, sum(signed) FILTER (source = 'gateway') AS gateway, sum(signed) FILTER (source = 'ledger') AS booked, count(*) FILTER (source <> 'bank') AS n_txns FROM signed GROUP BY root),
 good AS (SELECT root, group_id FROM gr WHERE n_sources >= 2 AND (bank IS NULL OR coalesce(gateway, booked) IS NULL OR abs(bank - coalesce(gateway, booked)) <= greatest(100, cast(floor(abs(bank) * 0.0005::DECIMAL(10,8)) AS BIGINT), n_txns))),
 member AS (SELECT g.group_id AS match_id, s.* FROM signed s JOIN good g USING (root))"""


def exact_members(events: DataFrame, columns: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the exact stage alone, with match_id (the group's smallest row) and stage; and the rows that it leaves.
    ``columns``: what is needed of either."""
    members, left = references.exact_stage(events, columns=columns)
    return members.withColumn("stage", F.lit("exact_ref")), left


@query(corpus.CTES + " SELECT scenario, label, bucket, count(*) AS n FROM truth GROUP BY scenario, label, bucket")
def corpus_faults(spark, sf_dir):
    """Rows of the corpus by planted fault, what is true of them and where they should end."""
    return corpus.truth(spark, sf_dir).groupBy("scenario", "label", "bucket").agg(F.count("*").alias("n"))


@query(EXACT + """, p AS (SELECT t.event_id, coalesce('m' || m.match_id, 'e' || t.event_id) AS grp, coalesce(t.truth_group, 'e' || t.event_id) AS truth FROM truth t LEFT JOIN member m USING (event_id)),
 a AS (SELECT sum(n * (n - 1) // 2) AS x FROM (SELECT count(*) AS n FROM p GROUP BY grp)), b AS (SELECT sum(n * (n - 1) // 2) AS x FROM (SELECT count(*) AS n FROM p GROUP BY truth)), c AS (SELECT sum(n * (n - 1) // 2) AS x FROM (SELECT count(*) AS n FROM p GROUP BY grp, truth)), t AS (SELECT count(*) * (count(*) - 1) // 2 AS x FROM p)
 SELECT c.x::BIGINT AS true_positive, (a.x - c.x)::BIGINT AS false_positive, (b.x - c.x)::BIGINT AS false_negative, (t.x - a.x - b.x + c.x)::BIGINT AS true_negative FROM a, b, c, t""")
def exact_confusion(spark, sf_dir):
    """Pairs that the exact stage puts together, against the truth."""
    events, truth = corpus.both(spark, sf_dir)
    members = exact_members(events, ("event_id",))[0].select("event_id", "match_id")
    rows = truth.join(members, "event_id", "left")
    return evaluate.pair_confusion(rows.select(F.coalesce(F.concat(F.lit("m"), "match_id"), F.concat(F.lit("e"), "event_id")).alias("group"), F.coalesce("truth_group", F.concat(F.lit("e"), "event_id")).alias("truth")))


@query(EXACT + """, cells AS (SELECT m.match_id, t.truth_group, count(*) AS n FROM member m JOIN truth t USING (event_id) GROUP BY 1, 2), g AS (SELECT match_id, sum(n) AS n, sum(CASE WHEN truth_group IS NULL THEN 0 ELSE n * (n - 1) // 2 END) AS good FROM cells GROUP BY 1)
 SELECT 'exact_ref' AS stage, count(*) AS matches, sum(n * (n - 1) // 2)::BIGINT AS pairs, sum(good)::BIGINT AS right_pairs FROM g""")
def exact_stage_accuracy(spark, sf_dir):
    events, truth = corpus.both(spark, sf_dir)
    return evaluate.stage_accuracy(exact_members(events, ("event_id",))[0].select("match_id", "event_id", "stage"), truth.select("event_id", "truth_group"))


#: Three-way resolution of the exact stage's groups in SQL.
LEGS = EXACT + """, cash AS (SELECT * FROM member WHERE source = 'ledger' AND voucher_type IN ('Receipt', 'Payment', 'Contra')),
 sig AS (SELECT *, count(*) OVER (PARTITION BY match_id, voucher_type, direction, amount_paise, txn_date, upper(trim(narration))) AS alike, count(*) OVER (PARTITION BY match_id, amount_paise) AS sized FROM cash),
 dup AS (SELECT match_id, 'duplicate_ledger_entry' AS category, sum(amount_paise) AS amount, count(*) AS n_events FROM sig WHERE alike > 1 GROUP BY 1),
 facts2 AS (SELECT match_id, count(*) FILTER (source = 'ledger') AS n_ledger, count(*) FILTER (source = 'ledger' AND voucher_type IN ('Receipt', 'Payment', 'Contra')) AS n_cash, coalesce(nullif(coalesce(sum(signed) FILTER (source = 'gateway'), 0), 0), nullif(coalesce(sum(signed) FILTER (source = 'bank'), 0), 0)) AS moved,
  coalesce(sum(signed) FILTER (source = 'ledger' AND voucher_type IN ('Receipt', 'Payment', 'Contra')), 0) AS booked, max(abs(amount_paise)) AS amount, arg_max(txn_date, (abs(amount_paise), event_id)) AS day, count(*) AS n FROM member GROUP BY 1),
 odd AS (SELECT match_id, abs(booked - moved) AS gap FROM facts2 WHERE n_cash > 0 AND moved IS NOT NULL AND match_id NOT IN (SELECT match_id FROM dup) AND abs(booked - moved) > greatest(100, cast(floor(abs(moved) * 0.0005::DECIMAL(10,8)) AS BIGINT), n_cash)),
 odd2 AS (SELECT match_id, CASE WHEN max(sized) > 1 THEN 'duplicate_ledger_entry' ELSE 'amount_variance' END AS category, any_value(gap) AS amount, CASE WHEN max(sized) > 1 THEN count(*) FILTER (sized > 1) ELSE count(*) END AS n_events FROM sig JOIN odd USING (match_id) GROUP BY 1),
 lack AS (SELECT * FROM facts2 WHERE n_ledger = 0), ids AS (SELECT DISTINCT m.match_id, unnest([settlement_id, order_id]) AS id FROM member m JOIN lack USING (match_id)), loose AS (SELECT event_id, amount_paise, txn_date, CASE WHEN narration LIKE 'Settlement credit %' THEN substr(narration, 19) END AS cites FROM ledger WHERE event_id NOT IN (SELECT event_id FROM member)),
 byref AS (SELECT DISTINCT i.match_id, f.event_id AS ledger_id FROM ids i JOIN loose f ON f.cites = i.id),
 byamount AS (SELECT l.match_id, f.event_id AS ledger_id FROM lack l JOIN loose f ON f.cites IS NULL AND f.txn_date BETWEEN l.day - 1 AND l.day + 1 AND abs(f.amount_paise - l.amount) <= greatest(100, cast(floor(l.amount * 0.0005::DECIMAL(10,8)) AS BIGINT), 1) WHERE l.match_id NOT IN (SELECT match_id FROM byref)),
 wanted AS (SELECT *, 'exact_ref' AS proof FROM byref UNION ALL SELECT *, 'fuzzy' FROM byamount), w AS (SELECT *, count(*) OVER (PARTITION BY match_id) AS n, count(*) OVER (PARTITION BY ledger_id) AS k FROM wanted),
 rival AS (SELECT w.match_id, 'duplicate_ledger_entry' AS category, sum(l.amount_paise) AS amount, any_value(f.n) + count(*) AS n_events FROM w JOIN ledger l ON l.event_id = w.ledger_id JOIN facts2 f USING (match_id) WHERE w.n > 1 GROUP BY 1),
 both_want AS (SELECT w.match_id, 'ambiguous_multi_candidate' AS category, any_value(f.amount) AS amount, any_value(f.n) + count(*) AS n_events FROM w JOIN facts2 f USING (match_id) WHERE w.n = 1 AND w.k > 1 GROUP BY 1),
 none_found AS (SELECT match_id, 'missing_in_ledger' AS category, amount, n AS n_events FROM lack WHERE match_id NOT IN (SELECT match_id FROM w)),
 refused AS (SELECT * FROM dup UNION ALL SELECT * FROM odd2 UNION ALL SELECT * FROM rival UNION ALL SELECT * FROM both_want UNION ALL SELECT * FROM none_found)"""


def leg_rows(events: DataFrame) -> DataFrame:
    """What legs are judged by; of narrations only the ledger's are read."""
    return events.select(*legs.OWN, "utr", "txn_type").withColumn("narration", F.when(F.col("source") == "ledger", F.col("narration")))


def exact_legs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = leg_rows(corpus.rows(spark, sf_dir))
    members, left = exact_members(events, legs.OWN)
    return members, *legs.resolve(members, events, left.filter("source = 'ledger'"))


@query(LEGS + " SELECT match_id AS subject, category, amount::BIGINT AS amount_paise, n_events FROM refused")
def group_refusals(spark, sf_dir):
    """What three-way resolution declines about the exact stage's groups: doubled, disagreeing, rival and missing legs."""
    return exact_legs(spark, sf_dir)[2].groupBy("subject", "category").agg(F.min("amount_paise").alias("amount_paise"), F.count("*").alias("n_events"))


@query(LEGS + " SELECT match_id, ledger_id AS event_id, proof FROM w WHERE n = 1 AND k = 1")
def attached_legs(spark, sf_dir):
    """Legs found for groups without one: by what the row says, else by amount and day among rows that cite nothing."""
    return exact_legs(spark, sf_dir)[1].select("match_id", "event_id", "proof")


@query(LEGS + """, bad AS (SELECT s.event_id FROM sig s WHERE alike > 1 UNION SELECT s.event_id FROM sig s JOIN odd2 o USING (match_id) WHERE o.category = 'duplicate_ledger_entry' AND sized > 1 UNION SELECT m.event_id FROM member m JOIN rival USING (match_id) UNION SELECT m.event_id FROM member m JOIN both_want USING (match_id)
  UNION SELECT ledger_id FROM w JOIN both_want USING (match_id) UNION SELECT ledger_id FROM w JOIN rival USING (match_id))
 SELECT m.match_id, bool_or(m.event_id IN (SELECT event_id FROM bad)) AS stopped FROM member m GROUP BY 1""")
def stopped_groups(spark, sf_dir):
    """Groups of the exact stage, and whether a refusal of a category that never closes by itself touches them."""
    members, _, refused = exact_legs(spark, sf_dir)
    # a refusal of three-way resolution has a group as its subject and names rows of it, so rows need not be looked up
    groups = members.select("match_id").distinct()
    touched = refused.filter(F.col("category").isin(*legs.NEVER_AUTO)).select(F.col("subject").alias("match_id"), F.lit(True).alias("touched")).distinct()
    return groups.join(touched, "match_id", "left").select("match_id", F.coalesce("touched", F.lit(False)).alias("stopped"))


@query(EXACT + """, rest AS (SELECT * FROM corpus WHERE event_id NOT IN (SELECT event_id FROM member)), opp AS (SELECT r.event_id, o.event_id AS other_id, row_number() OVER (PARTITION BY r.event_id ORDER BY abs(o.txn_date - r.txn_date), o.event_id) AS k FROM rest r JOIN corpus o ON o.amount_paise = r.amount_paise
 AND ((r.source = 'bank' AND o.source = 'gateway') OR (r.source = 'gateway' AND o.source = 'bank')) AND abs(o.txn_date - r.txn_date) > 3), t AS (SELECT event_id, other_id FROM opp WHERE k = 1),
 c AS (SELECT r.event_id, r.amount_paise, t.other_id, CASE WHEN r.source = 'bank' AND r.narration LIKE 'NACH%' THEN 'nach_batch_unexploded' WHEN r.source = 'gateway' AND r.txn_type = 'refund' THEN 'partial_refund' WHEN t.other_id IS NOT NULL THEN 'timing_lag' WHEN r.source = 'bank' AND length(r.utr) < 16 THEN 'reference_truncated'
  WHEN r.source = 'gateway' THEN 'missing_in_bank' WHEN r.source = 'bank' AND upper(r.counterparty) LIKE '%GATEWAY%' THEN 'missing_in_gateway' WHEN r.source = 'bank' AND r.direction = 'credit' THEN 'unidentified_inflow' WHEN r.source = 'bank' THEN 'unbooked_bank_entry' ELSE 'missing_in_bank' END AS category FROM rest r LEFT JOIN t USING (event_id))
 SELECT event_id, category, amount_paise, CASE WHEN category = 'timing_lag' THEN other_id END AS other_id FROM c""")
def unmatched_findings(spark, sf_dir):
    """What rows outside the exact stage's groups mean, with the search for the same amount at another time."""
    events = corpus.rows(spark, sf_dir)
    return classify.unmatched(exact_members(events, ("event_id", "source", "amount_paise", "txn_date", "direction", "utr", "txn_type", "narration", "counterparty"))[1], events)


@query()
def cascade_refusals(spark, sf_dir):
    """What every stage of the cascade declines, by stage and category. Greedy stages have no SQL; tests restate them."""
    return cascade.run(corpus.rows(spark, sf_dir)).tallies()


def long(df: DataFrame, key, *values: str) -> DataFrame:
    return df.select(key, F.explode(F.create_map(*[x for v in values for x in (F.lit(v), F.col(v).cast("long"))])).alias("name", "value"))


def gate_measures(done: cascade.Result, truth: DataFrame) -> DataFrame:
    """Closed matches and the confusion of pairs in one long table: measure, name, value."""
    closed = settled(cascade.closable(done.members, refused=done.named), "closed")
    closing = long(evaluate.closed_accuracy(done.members, closed, truth), F.lit("closed").alias("measure"), "closed", "closed_rows", "mixed", "open")
    rows = truth.join(done.members.select("event_id", "match_id").distinct(), "event_id", "left")
    confusion = evaluate.pair_confusion(rows.select(F.coalesce(F.concat(F.lit("m"), "match_id"), F.concat(F.lit("e"), "event_id")).alias("group"), F.coalesce("truth_group", F.concat(F.lit("e"), "event_id")).alias("truth")))
    return closing.unionByName(long(confusion, F.lit("pairs").alias("measure"), "true_positive", "false_positive", "false_negative", "true_negative"))


def measured(events: DataFrame, truth: DataFrame) -> DataFrame:
    """The cascade's accuracy in one long table: measure, name, value."""
    done, truth = cascade.run(events), settled(truth, "truth")
    pairs = evaluate.stage_accuracy(done.members, truth)
    found = done.named.unionByName(classify.unmatched(done.left, events).select("event_id", "category")).unionByName(classify.unrecorded_chargebacks(events.filter("source = 'gateway'"), events.filter("source = 'ledger'")).select("event_id", F.lit("chargeback_unrecorded").alias("category")))
    return (long(pairs, F.concat(F.lit("stage "), "stage").alias("measure"), "matches", "pairs", "right_pairs").unionByName(gate_measures(done, truth))
            .unionByName(long(evaluate.category_accuracy(found, truth), F.concat(F.lit("category "), "category").alias("measure"), "given", "true", "right")))


@query()
def cascade_accuracy(spark, sf_dir):
    """The whole cascade over the corpus against its truth: pairs by stage, closed matches, confusion, categories."""
    return measured(*corpus.both(spark, sf_dir))


@query()
def cascade_gates(spark, sf_dir):
    """Whether the cascade may be released: no match closed over two groups or a stray row, pair precision and recall."""
    events, truth = corpus.both(spark, sf_dir)
    value = {(r.measure, r.name): r.value for r in gate_measures(cascade.run(events), settled(truth, "truth")).collect()}
    right, wrong, missed = (value["pairs", k] for k in ("true_positive", "false_positive", "false_negative"))
    gates = [("no_mixed_close", value["closed", "mixed"] == 0, float(value["closed", "mixed"])), ("precision", right >= 0.99 * (right + wrong), right / max(right + wrong, 1)), ("recall", right >= 0.9 * (right + missed), right / max(right + missed, 1))]
    return spark.createDataFrame(gates, "gate string, passed boolean, value double")


#: Findings of group refusals in SQL, a row for each event; {pct} is the tolerance of the exact stage and of its legs.
FOUND = LEGS.replace("0.0005", "{pct}") + """, ev AS (SELECT match_id, 'duplicate_ledger_entry' AS category, event_id FROM sig WHERE alike > 1 UNION SELECT s.match_id, o.category, s.event_id FROM sig s JOIN odd2 o USING (match_id) WHERE o.category = 'amount_variance' OR s.sized > 1
 UNION SELECT match_id, 'duplicate_ledger_entry', event_id FROM member JOIN rival USING (match_id) UNION SELECT match_id, 'duplicate_ledger_entry', ledger_id FROM w JOIN rival USING (match_id) UNION SELECT match_id, 'ambiguous_multi_candidate', event_id FROM member JOIN both_want USING (match_id)
 UNION SELECT match_id, 'ambiguous_multi_candidate', ledger_id FROM w JOIN both_want USING (match_id) UNION SELECT match_id, 'missing_in_ledger', event_id FROM member JOIN none_found USING (match_id)),
 f AS (SELECT e.match_id, e.category, count(*) AS n_events, string_agg(e.event_id, ',' ORDER BY e.event_id) AS ids, any_value(r.amount)::BIGINT AS amount FROM ev e JOIN refused r ON r.match_id = e.match_id AND r.category = e.category GROUP BY 1, 2)
 SELECT * FROM f"""
#: The later run's tolerance: wide enough to explain some gaps.
LATER_PCT = "0.02"
BOTH_RUNS = f"WITH a AS ({FOUND.replace('{pct}', '0.0005')}), b AS ({FOUND.replace('{pct}', LATER_PCT)})"


def findings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Group findings of two runs over the corpus: by the usual tolerance, and by a wider one."""
    events = corpus.rows(spark, sf_dir)
    runs = DEFAULT, replace(DEFAULT, tolerance_pct=LATER_PCT)

    def found(members: DataFrame, left: DataFrame, cfg: Config) -> DataFrame:
        return legs.resolve(members, events, left.filter("source = 'ledger'"), cfg)[1].select(F.col("refusal_id").alias("finding"), "event_id", "category", "amount_paise")

    before, after = (found(*stage, cfg) for stage, cfg in zip(references.exact_stages(events, *runs, columns=legs.OWN), runs, strict=True))
    return before, after


@query(BOTH_RUNS + """ SELECT coalesce(split_part(a.ids, ',', 1), split_part(b.ids, ',', 1)) AS first_event, coalesce(a.n_events, b.n_events) AS n_events, CASE WHEN a.ids IS NULL THEN 'added' WHEN b.ids IS NULL THEN 'removed' WHEN a.category = b.category AND a.amount = b.amount THEN 'same' ELSE 'changed' END AS state,
 CASE WHEN a.ids = b.ids THEN nullif(concat_ws('; ', CASE WHEN a.category <> b.category THEN 'category ' || a.category || ' -> ' || b.category END, CASE WHEN a.amount <> b.amount THEN 'amount_paise ' || a.amount || ' -> ' || b.amount END), '') END AS why FROM a FULL JOIN b ON a.ids = b.ids""")
def replay_changes(spark, sf_dir):
    """What a wider tolerance changes about the findings, by the sets of their rows."""
    return replay.diff(*findings(spark, sf_dir)).select("first_event", "n_events", "state", "why")


@query(BOTH_RUNS + """, d AS (SELECT ids, CASE WHEN amount % 2 = 0 THEN 'resolved' ELSE 'written_off' END AS status FROM a WHERE amount % 5 <> 0)
 SELECT split_part(b.ids, ',', 1) AS first_event, b.category, coalesce(d.status, 'open') AS status, d.status IS NOT NULL AS carried FROM b LEFT JOIN d USING (ids)""")
def replay_decisions(spark, sf_dir):
    """Decisions of the earlier run in the later one; which were decided follows from the earlier amounts."""
    before, after = findings(spark, sf_dir)
    made = before.groupBy("finding").agg(F.min("amount_paise").alias("amount")).select("finding", F.when(F.col("amount") % 5 == 0, "open").when(F.col("amount") % 2 == 0, "resolved").otherwise("written_off").alias("status"))
    now, _ = replay.carried(replay.diff(before, after), made)
    later = after.groupBy("finding").agg(F.min("event_id").alias("first_event"), F.min("category").alias("category"))
    return now.join(later, "finding").select("first_event", "category", "status", "carried")


#: Short settlements as people resolved them, and the rules that were live then.
HISTORY = """ SELECT b.event_id AS exception_id, CASE WHEN n.k % 9 = 0 THEN 'unknown' ELSE 'amount_variance' END AS category, CASE WHEN n.sc = 17 THEN 'commission' ELSE 'rate_change' END AS resolution_category, 'party ' || cast(n.k % 3 AS varchar(2)) AS counterparty, b.rail, 'bank' AS source,
 b.amount_paise, n.net - b.amount_paise AS gap_paise, n.net AS gross_paise, n.day AS on_date FROM nets n JOIN bank b ON b.event_id = 'b' || n.sid WHERE n.sc IN (17, 18)"""
LIVE = " SELECT 'party 1' AS counterparty, cast(NULL AS varchar(10)) AS rail, cast(NULL AS date) AS date_from, cast(NULL AS date) AS date_to UNION ALL SELECT cast(NULL AS varchar(10)), 'rtgs', DATE '1997-01-01', cast(NULL AS date)"


@query(corpus.CTES + f""", h AS ({HISTORY}), live AS ({LIVE}), c AS (SELECT *, sha256(concat_ws(chr(31), category, counterparty, rail, CASE WHEN abs(amount_paise) < 100000 THEN '<1k' WHEN abs(amount_paise) < 1000000 THEN '1k-10k' WHEN abs(amount_paise) < 10000000 THEN '10k-1L' WHEN abs(amount_paise) < 100000000 THEN '1L-10L' ELSE '>10L' END,
  (half // 2) || (CASE WHEN half % 2 = 1 THEN '.5' ELSE '' END) || '-' || ((half + 1) // 2) || (CASE WHEN half % 2 = 0 THEN '.5' ELSE '' END) || '%')) AS signature, cast(round(cast(abs(gap_paise) * 100 AS DECIMAL(38,10)) / abs(gross_paise), 2) AS DECIMAL(12,2)) AS rate,
  EXISTS (SELECT 1 FROM live WHERE coalesce(live.counterparty, h2.counterparty) = h2.counterparty AND coalesce(live.rail, h2.rail) = h2.rail AND (live.date_from IS NULL OR h2.on_date >= live.date_from)) AS covered
  FROM (SELECT *, abs(gap_paise) * 200 // abs(gross_paise) AS half FROM h WHERE category <> 'unknown' AND gap_paise <> 0) h2),
 g AS (SELECT signature, resolution_category, count(*) AS occurrences, bool_and(covered) AS known, quantile_disc(rate, 0.5) AS rate FROM c GROUP BY 1, 2)
 SELECT 'learned_' || g.resolution_category || '_' || substr(g.signature, 1, 12) AS rule_id, g.occurrences, g.rate::DOUBLE AS rate_percent, max(abs(abs(c.gap_paise) - cast(round(abs(c.gross_paise) * g.rate / 100, 0) AS BIGINT))) AS tolerance_paise, arg_min(c.counterparty, c.exception_id) AS counterparty, min(c.on_date) AS effective_from
 FROM g JOIN c USING (signature, resolution_category) WHERE g.occurrences >= 3 AND NOT g.known GROUP BY ALL""")
def rule_drafts(spark, sf_dir):
    """Rules that the learner drafts from the resolutions of short settlements."""
    corpus.register(spark, sf_dir, "orders", "lineitem")
    history = settled(spark.sql(corpus.CTES + HISTORY), "resolutions")
    found = learner.drafts(history, spark.sql(LIVE))
    return found.select("rule_id", "occurrences", F.col("rate_percent").cast("double").alias("rate_percent"), "tolerance_paise", "counterparty", "effective_from")


@query(corpus.CTES + " SELECT event_id, amount_paise FROM bank WHERE direction = 'credit' ORDER BY amount_paise DESC, event_id LIMIT 2000 OFFSET 2000")
def bank_page(spark, sf_dir):
    """The second page of the largest credits, by the cursor of the first."""
    rows = corpus.rows(spark, sf_dir).filter("source = 'bank' and direction = 'credit'").select("event_id", "amount_paise")
    keys = (("amount_paise", "desc"), ("event_id", "asc"))
    first = paging.page(rows, keys, paging.MOST)
    after = rows.filter(paging.beyond(keys, paging.decode(first.next_cursor, 2))) if first.next_cursor else rows.limit(0)
    return after.orderBy(F.desc("amount_paise"), "event_id").limit(paging.MOST)


def _patterns() -> str:
    return ", ".join(f"CASE WHEN regexp_matches(narration, '{p}') THEN '{k}' END" for k, p in text.INJECTIONS.items())


@query(corpus.CTES + f", s AS (SELECT event_id, list_filter([{_patterns()}], lambda x: x IS NOT NULL) AS hits FROM corpus WHERE narration IS NOT NULL) SELECT event_id, array_to_string(hits, ',') AS hits FROM s WHERE len(hits) > 0")
def injected_narrations(spark, sf_dir):
    """Narrations that carry instructions to their reader, by all patterns."""
    rows = corpus.rows(spark, sf_dir).select("event_id", F.array_join(text.injection_hits(F.col("narration")), ",").alias("hits"))
    return rows.filter("hits <> ''")


#: A rulebook that uses every clause.
BOOK = (
    rules.Rule("gateway_neft", 1, 90, (rules.Deduction("fee", "1"),), source="bank", rail="neft", counterparties=("Gateway Payments",)),
    rules.Rule("gateway_large", 1, 90, (rules.Deduction("fee", "1"),), source="bank", counterparties=("Gateway Payments", "Other"), amount_min=20_000_000, amount_max=40_000_000, date_from="1995-01-01", date_to="1996-12-31"),
    rules.Rule("direct", 2, 80, (rules.Deduction("fee", "1"),), narrations=("direct buyer", "counter")), rules.Rule("direct", 1, 80, (rules.Deduction("fee", "1"),), narrations=("DIRECT",), effective_to="1994-12-31"),
    rules.Rule("upi", 1, 80, (rules.Deduction("fee", "1"),), method="upi", source="gateway"), rules.Rule("late", 1, 70, (rules.Deduction("fee", "1"),), effective_from="1997-06-01"), rules.Rule("off", 9, 99, (rules.Deduction("fee", "1"),), status="draft"),
)


@query(corpus.CTES + """, r AS (SELECT *, [CASE WHEN source = 'bank' AND upper(counterparty) = 'GATEWAY PAYMENTS' AND amount_paise BETWEEN 20000000 AND 40000000 AND txn_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' THEN 'gateway_large:1' END,
  CASE WHEN source = 'bank' AND rail = 'neft' AND upper(counterparty) = 'GATEWAY PAYMENTS' THEN 'gateway_neft:1' END, CASE WHEN method = 'upi' AND source = 'gateway' THEN 'upi:1' END, CASE WHEN contains(upper(narration), 'DIRECT BUYER') OR contains(upper(narration), 'COUNTER') THEN 'direct:2' END,
  CASE WHEN contains(upper(narration), 'DIRECT') AND txn_date <= DATE '1994-12-31' THEN 'direct:1' END, CASE WHEN txn_date >= DATE '1997-06-01' THEN 'late:1' END] AS hits FROM corpus)
 SELECT event_id, len(list_filter(hits, lambda x: x IS NOT NULL))::INT AS n_rules, list_filter(hits, lambda x: x IS NOT NULL)[1] AS rule FROM r""")
def scoped_rules(spark, sf_dir):
    """Every row with the rules of a book whose clauses it meets, and the first by priority, clauses and version."""
    cases = corpus.rows(spark, sf_dir).withColumnsRenamed({"amount_paise": "gross_paise", "txn_date": "on_date"})
    return rules.first_rule(cases, BOOK).select("event_id", "n_rules", "rule")


@query(LEGS + """, rest AS (SELECT * FROM corpus WHERE event_id NOT IN (SELECT event_id FROM member)), opp AS (SELECT r.event_id FROM rest r JOIN corpus o ON o.amount_paise = r.amount_paise AND ((r.source = 'bank' AND o.source = 'gateway') OR (r.source = 'gateway' AND o.source = 'bank')) AND abs(o.txn_date - r.txn_date) > 3),
 found AS (SELECT category, amount::BIGINT AS amount FROM refused UNION ALL SELECT CASE WHEN r.source = 'bank' AND r.narration LIKE 'NACH%' THEN 'nach_batch_unexploded' WHEN r.source = 'gateway' AND r.txn_type = 'refund' THEN 'partial_refund' WHEN r.event_id IN (SELECT event_id FROM opp) THEN 'timing_lag'
  WHEN r.source = 'bank' AND length(r.utr) < 16 THEN 'reference_truncated' WHEN r.source = 'gateway' THEN 'missing_in_bank' WHEN r.source = 'bank' AND upper(r.counterparty) LIKE '%GATEWAY%' THEN 'missing_in_gateway' WHEN r.source = 'bank' AND r.direction = 'credit' THEN 'unidentified_inflow'
  WHEN r.source = 'bank' THEN 'unbooked_bank_entry' ELSE 'missing_in_bank' END, r.amount_paise FROM rest r),
 pay AS (SELECT *, coalesce(fee_paise, 0) AS fee, coalesce(tax_raw, 0) // 118 AS tax FROM gateway WHERE txn_type = 'payment'),
 seg AS (SELECT 'held' AS line, amount_paise + fee AS amount FROM pay WHERE on_hold UNION ALL SELECT 'gross', amount_paise + fee FROM pay WHERE NOT on_hold UNION ALL SELECT 'mdr', fee - tax FROM pay WHERE NOT on_hold UNION ALL SELECT 'gst', tax FROM pay WHERE NOT on_hold
  UNION ALL SELECT CASE txn_type WHEN 'refund' THEN 'refunds' WHEN 'dispute' THEN 'chargebacks' ELSE txn_type END, amount_paise FROM gateway WHERE txn_type <> 'payment'
  UNION ALL SELECT 'bank', CASE WHEN direction = 'credit' THEN amount_paise ELSE -amount_paise END FROM member WHERE source = 'bank' AND match_id IN (SELECT match_id FROM member WHERE source = 'gateway')),
 sums AS (SELECT line, count(*) AS n_rows, sum(amount)::BIGINT AS amount_paise FROM seg GROUP BY line), tot AS (SELECT sum(CASE line WHEN 'gross' THEN amount_paise WHEN 'held' THEN 0 WHEN 'bank' THEN 0 ELSE -amount_paise END)::BIGINT AS expected, sum(n_rows) FILTER (line NOT IN ('held', 'bank'))::BIGINT AS n, coalesce(sum(amount_paise) FILTER (line = 'bank'), 0)::BIGINT AS bank FROM sums),
 o AS (SELECT unnest(['timing_lag', 'missing_in_bank', 'amount_variance', 'reference_truncated', 'ambiguous_multi_candidate', 'missing_in_gateway', 'partial_refund']) AS category, unnest(range(7)) AS k), wr AS (SELECT k, category, count(*) AS n_rows, sum(amount) AS worth FROM found JOIN o USING (category) GROUP BY 1, 2),
 sh AS (SELECT category, n_rows, least(worth, greatest(expected - bank - coalesce(sum(worth) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0))::BIGINT AS share FROM wr, tot)
 SELECT line, n_rows, amount_paise FROM sums UNION ALL SELECT 'expected', n, expected FROM tot UNION ALL SELECT 'rest', n, expected - bank FROM tot UNION ALL SELECT 'explained by ' || category, n_rows, share FROM sh UNION ALL SELECT 'unexplained', 0, expected - bank - coalesce((SELECT sum(share) FROM sh), 0)::BIGINT FROM tot""")
def bridge_lines(spark, sf_dir):
    """The cash bridge of the corpus after the exact stage: segments, what the bank should have credited and did, and
    which findings explain the rest."""
    events = corpus.rows(spark, sf_dir)
    # of the gateway's rows no narration and of parties only the bank's are read after this
    read = events.select(*legs.OWN, "utr", "txn_type", "counterparty").withColumns({"narration": F.when(F.col("source") != "gateway", F.col("narration")), "counterparty": F.when(F.col("source") == "bank", F.col("counterparty"))})
    members, left = exact_members(read, tuple(read.columns))
    _, refused = legs.resolve(members, events, left.filter("source = 'ledger'"))
    one = refused.groupBy(F.col("refusal_id").alias("finding")).agg(F.min("category").alias("category"), F.min("amount_paise").alias("amount_paise"))
    loose = classify.unmatched(left, events).select(F.col("event_id").alias("finding"), "category", "amount_paise")
    return bridge.bridge(events, members.select("match_id", "event_id", "source", "direction", "amount_paise"), settled(one.unionByName(loose), "bridge-findings"))


def _inr(p: str) -> str:
    w = f"({p} // 100)::VARCHAR"
    return f"""'₹' || CASE WHEN length({w}) > 3 THEN (CASE WHEN (length({w}) - 3) % 2 = 1 THEN ({w})[1] || CASE WHEN length({w}) > 4 THEN ',' ELSE '' END ELSE '' END) || array_to_string(list_transform(range(1 + (length({w}) - 3) % 2, length({w}) - 3, 2), lambda i: substr({w}, i, 2)), ',') || ',' || right({w}, 3) ELSE {w} END || '.' || lpad(({p} % 100)::VARCHAR, 2, '0')"""


@query(FOUND.replace("{pct}", "0.0005").removesuffix(" SELECT * FROM f") + f""", all_ev AS (SELECT e.match_id || e.category AS finding, e.category, e.event_id, r.amount::BIGINT AS amount FROM ev e JOIN refused r ON r.match_id = e.match_id AND r.category = e.category
  UNION ALL SELECT event_id, 'chargeback_unrecorded', event_id, amount_paise FROM gateway WHERE txn_type = 'dispute' UNION ALL SELECT event_id, 'nach_batch_unexploded', event_id, amount_paise FROM bank WHERE narration LIKE 'NACH%' UNION ALL SELECT event_id, 'reference_truncated', event_id, amount_paise FROM bank WHERE length(utr) < 16),
 g AS (SELECT finding, category, min(amount) AS amount, arg_min(c.txn_date, c.event_id) AS day, min(c.event_id) AS first_id, count(*) FILTER (c.source = 'ledger') AS n_ledger, min(c.event_id) FILTER (c.source = 'ledger') AS keep, max(c.event_id) FILTER (c.source = 'ledger') AS rev, arg_max(c.txn_date, c.event_id) FILTER (c.source = 'ledger') AS rev_day,
  arg_max(c.txn_date, (abs(c.amount_paise), c.event_id)) AS large_day, min(c.order_id) AS ord FROM all_ev a JOIN corpus c USING (event_id) GROUP BY 1, 2), p AS (SELECT *, {_inr('amount')} AS money FROM g)
 SELECT first_id, category, CASE category WHEN 'duplicate_ledger_entry' THEN CASE WHEN n_ledger = 2 THEN 'Reverse ' || rev || ' of ' || rev_day || ': it books ' || money || ' a second time after ' || keep || '.' ELSE 'Find out which of ' || n_ledger || ' rows books ' || money || '; the others are to be reversed.' END
  WHEN 'chargeback_unrecorded' THEN 'Book the chargeback of ' || money || ' for ' || coalesce(ord, 'its order') || ' (' || first_id || ') and contest it by ' || (day + 30) || '.' WHEN 'missing_in_ledger' THEN 'Book a receipt of ' || money || ' on ' || large_day || ': gateway and bank agree on it.'
  WHEN 'nach_batch_unexploded' THEN 'Book the mandate batch of ' || money || ' on ' || day || ' as one sum; the statement does not name its mandates.' WHEN 'ambiguous_multi_candidate' THEN 'Say which candidate ' || money || ' of ' || day || ' belongs to before either side closes.'
  WHEN 'reference_truncated' THEN 'Compare ' || money || ' of ' || day || ' by hand; the bank cut its reference.' WHEN 'amount_variance' THEN 'Check the difference of ' || money || '; no rule explains all of it.' END AS advice FROM p""")
def finding_advice(spark, sf_dir):
    """What to do about the exact stage's group findings, chargebacks, mandate batches and cut references."""
    events = corpus.rows(spark, sf_dir)
    members, left = exact_members(events, legs.OWN)
    refused = legs.resolve(members, events, left.filter("source = 'ledger'"))[1]
    single = lambda when, category: events.filter(when).select(F.col("event_id").alias("finding"), "event_id", F.lit(category).alias("category"), "amount_paise")
    found = (refused.select(F.col("refusal_id").alias("finding"), "event_id", "category", "amount_paise").unionByName(single("txn_type = 'dispute'", "chargeback_unrecorded"))
             .unionByName(single("source = 'bank' and narration like 'NACH%'", "nach_batch_unexploded")).unionByName(single("source = 'bank' and length(utr) < 16", "reference_truncated")))
    return advise.facts(found, events).select(F.col("first.event_id").alias("first_id"), "category", advise.advice().alias("advice"))
