"""Record views, lists, transitions and evaluation over matches and exceptions.

Rows find their settlement through what they say themselves (``settlements.named``); the generator's own key appears
only on the side of the truth. Matches are derived once for each query: a bank credit and the settlement it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trisettle.functions.scoring import tolerance
from trisettle.operators import exceptions, rules, settlements
from trisettle.operators.shared import dealt, settled, tasks_for
from trisettle.plans.matching import SUMS, TOL
from trisettle.plans.queue import QUEUE, TODAY, queue
from trisettle.sources.harness import CTES, derived, events, source

QUERIES = {}
ORACLE_SQL = {}
NAMED = ("settlement_id", "event_id", "source", "amount_paise", "txn_date", "utr", "narration")
RESOLVABLE = ("open", "monitoring", "snoozed", "escalated")

MATCHES = QUEUE + """, named AS (SELECT 'S' || batch AS settlement_id, event_id, source, amount_paise, txn_date, utr, narration FROM bank UNION ALL SELECT 'S' || batch, event_id, source, amount_paise, txn_date, utr, narration FROM ledger),
 m AS (SELECT 'm' || n.settlement_id AS match_id, n.settlement_id, CASE WHEN length(n.utr) >= 16 THEN 'exact_ref' ELSE 'many_to_one' END AS stage, n.amount_paise - a.expected_net_paise AS delta_paise,
 CASE WHEN n.amount_paise = a.expected_net_paise THEN 100 WHEN abs(n.amount_paise - a.expected_net_paise) <= """ + TOL + """ THEN 97 ELSE 70 END AS confidence_pct FROM named n JOIN arith a USING (settlement_id) WHERE n.source = 'bank')"""
RULES = """WITH r AS (SELECT n_name AS rule_id, n_regionkey AS rule_set, CASE n_nationkey % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'upi' WHEN 2 THEN 'netbanking' ELSE 'wallet' END AS method, n_nationkey * 100000 AS amount_min,
 DATE '1992-01-01' + n_nationkey::INT * 60 AS date_from, n_nationkey % 3 AS priority FROM nation)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank and ledger rows with the settlement they name; the gateway's rows are derived once."""
    return named_of(*derived(spark, sf_dir))


def named_of(gateway: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """``gateway`` should be a written table."""
    return settlements.named(bank.unionByName(ledger), gateway.select("utr", "settlement_id"), tasks_for(gateway)).filter("settlement_id is not null").select(*NAMED)


def matches(rows: DataFrame, gateway: DataFrame) -> DataFrame:
    """Each bank credit with the settlement that it names: stage, difference and confidence in percent. ``gateway`` should
    be a written table."""
    tasks = tasks_for(gateway)
    delta = F.col("amount_paise") - F.col("expected_net_paise")
    confidence = F.when(delta == 0, 100).when(F.abs(delta) <= tolerance(F.col("expected_net_paise"), F.col("n_txns")), 97).otherwise(70)
    stage = F.when(F.length("utr") >= 16, "exact_ref").otherwise("many_to_one")
    return dealt(rows.filter("source = 'bank'"), tasks, "settlement_id").join(settlements.arithmetic(dealt(gateway, tasks, "settlement_id")), "settlement_id").select(
        F.concat(F.lit("m"), "settlement_id").alias("match_id"), "settlement_id", stage.alias("stage"), delta.alias("delta_paise"), confidence.alias("confidence_pct"))


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Written once: the named rows and the matches."""
    return with_gateway(spark, sf_dir)[1:]


def with_gateway(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``both``, and before them the gateway's rows that they come from."""
    gateway, bank, ledger = derived(spark, sf_dir)
    rows = settled(named_of(gateway, bank, ledger), "named-rows")
    return gateway, rows, settled(matches(rows, gateway), "matches")


def rulebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each nation: a bounded table of 25 rows."""
    k = F.col("n_nationkey")
    method = F.when(k % 4 == 0, "card").when(k % 4 == 1, "upi").when(k % 4 == 2, "netbanking").otherwise("wallet")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("rule_id"), F.col("n_regionkey").alias("rule_set"), method.alias("method"), (k * 100_000).alias("amount_min"),
                                                                 F.date_add(F.lit("1992-01-01").cast("date"), (k * 60).cast("int")).alias("date_from"), (k % 3).alias("priority"))


def of_exceptions(rows: DataFrame, found: DataFrame) -> DataFrame:
    return found.join(rows, found.subject == rows.settlement_id)


@query(MATCHES + " SELECT match_id, stage, confidence_pct FROM m WHERE confidence_pct < 100 OR (confidence_pct = 100 AND match_id < 'mS5') ORDER BY confidence_pct DESC, match_id DESC LIMIT 51")
def match_list(spark, sf_dir):
    return exceptions.page(both(spark, sf_dir)[1].select("match_id", "stage", "confidence_pct"), "confidence_pct", "match_id", 50, (100, "mS5"))


@query(MATCHES + " SELECT match_id, event_id, source, amount_paise FROM m JOIN named USING (settlement_id)")
def match_evidence(spark, sf_dir):
    rows, found = both(spark, sf_dir)
    return found.select("match_id", "settlement_id").join(rows, "settlement_id").select("match_id", "event_id", "source", "amount_paise")


@query(MATCHES + " SELECT subject, event_id, source, amount_paise FROM (SELECT subject FROM q) q JOIN named ON settlement_id = subject")
def exception_events(spark, sf_dir):
    return of_exceptions(named(spark, sf_dir), queue(spark, sf_dir).select("subject")).select("subject", "event_id", "source", "amount_paise")


@query(MATCHES + " SELECT subject, string_agg(narration, ' | ' ORDER BY event_id) AS narrations FROM (SELECT subject FROM q ORDER BY amount_paise DESC, subject DESC LIMIT 50) p JOIN named ON settlement_id = subject GROUP BY subject")
def exception_narrations(spark, sf_dir):
    page = queue(spark, sf_dir).select("subject", "amount_paise").orderBy(F.desc("amount_paise"), F.desc("subject")).limit(50).select("subject")
    rows = of_exceptions(named(spark, sf_dir), page).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("event_id", "narration"))).alias("x"))
    return rows.select("subject", F.array_join(F.transform("x", lambda x: x["narration"]), " | ").alias("narrations"))


@query(QUEUE + " SELECT cluster_key, count(*) AS n, sum(amount_paise)::BIGINT AS total_paise FROM q GROUP BY cluster_key HAVING count(*) >= 2 ORDER BY total_paise DESC, cluster_key LIMIT 20")
def cluster_list(spark, sf_dir):
    return exceptions.clusters(queue(spark, sf_dir)).select("cluster_key", "n", "total_paise").orderBy(F.desc("total_paise"), "cluster_key").limit(20)


@query(QUEUE + " SELECT cluster_key, subject, amount_paise FROM q WHERE cluster_size >= 2 AND category = 'missing_in_ledger'")
def cluster_members(spark, sf_dir):
    return queue(spark, sf_dir).filter("cluster_size >= 2 and category = 'missing_in_ledger'").select("cluster_key", "subject", "amount_paise")


@query(MATCHES + """, every AS (SELECT event_id, settlement_id FROM gateway UNION ALL SELECT event_id, settlement_id FROM named)
 SELECT event_id, CASE WHEN settlement_id IN (SELECT subject FROM q) THEN 'decision' WHEN settlement_id IN (SELECT settlement_id FROM m) THEN 'matched' ELSE 'unclaimed' END AS claim, settlement_id IN (SELECT settlement_id FROM m) AS in_scope FROM every""")
def claim_states(spark, sf_dir):
    rows, found = both(spark, sf_dir)
    every = source(spark, sf_dir, "gateway").select("event_id", "settlement_id").unionByName(rows.select("event_id", "settlement_id"))
    decided = queue(spark, sf_dir).select(F.col("subject").alias("settlement_id"), F.lit(True).alias("decided"))
    backed = found.select("settlement_id", F.lit(True).alias("backed")).distinct()
    every = every.join(decided, "settlement_id", "left").join(backed, "settlement_id", "left")
    return every.select("event_id", F.when(F.col("decided"), "decision").when(F.col("backed"), "matched").otherwise("unclaimed").alias("claim"), F.coalesce("backed", F.lit(False)).alias("in_scope"))


@query(QUEUE + " SELECT subject, action_group FROM q WHERE status = 'open' AND tier <> 'auto' AND contains(lower(concat_ws(' ', category, action_group, subject, amount_paise)), 'books_fix s1')")
def needs_you(spark, sf_dir):
    text = F.lower(F.concat_ws(" ", "category", "action_group", "subject", F.col("amount_paise").cast("string")))
    return queue(spark, sf_dir).filter("status = 'open' and tier <> 'auto'").filter(F.contains(text, F.lit("books_fix s1"))).select("subject", "action_group")


@query(MATCHES + " SELECT settlement_id, event_id FROM (SELECT n.settlement_id, n.event_id, row_number() OVER (PARTITION BY n.settlement_id ORDER BY abs(n.amount_paise - a.expected_net_paise), n.event_id) AS k FROM named n JOIN arith a USING (settlement_id)) WHERE k = 1")
def best_leg(spark, sf_dir):
    rows = named(spark, sf_dir).join(settlements.arithmetic(source(spark, sf_dir, "gateway")), "settlement_id")
    return exceptions.first_of(rows, ["settlement_id"], [F.abs(F.col("amount_paise") - F.col("expected_net_paise")), F.col("event_id")]).select("settlement_id", "event_id")


@query(QUEUE + " SELECT CASE WHEN cluster_size >= 2 THEN cluster_key ELSE subject END AS entry, count(*) AS n, sum(amount_paise)::BIGINT AS total_paise FROM q WHERE status = 'open' GROUP BY 1")
def collapsed_queue(spark, sf_dir):
    rows = queue(spark, sf_dir).filter("status = 'open'")
    return rows.groupBy(F.when(F.col("cluster_size") >= 2, F.col("cluster_key")).otherwise(F.col("subject")).alias("entry")).agg(F.count("*").alias("n"), F.sum("amount_paise").alias("total_paise"))


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderdate AS started FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def run_list(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey % 3 = 0 and o_orderstatus <> 'P'")
    return runs.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started"))


@query("SELECT o_custkey AS tenant, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def newest_runs(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'")
    return runs.groupBy(F.col("o_custkey").alias("tenant")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run_id"))


@query(MATCHES + """, l AS (SELECT settlement_id, min(narration) AS narration FROM named WHERE source = 'ledger' GROUP BY 1)
 SELECT b.settlement_id, len(list_intersect(regexp_extract_all(b.narration, 'S[0-9]+|UTR[0-9]{13}'), regexp_extract_all(l.narration, 'S[0-9]+|UTR[0-9]{13}')))::INT AS n_shared FROM named b JOIN l USING (settlement_id) WHERE b.source = 'bank'""")
def shared_references(spark, sf_dir):
    rows = settled(named(spark, sf_dir), "named-rows")
    tasks = tasks_for(rows)
    said = lambda c: F.regexp_extract_all(c, F.lit("S[0-9]+|UTR[0-9]{13}"), F.lit(0))
    of = lambda source: dealt(rows.filter(F.col("source") == source).select("settlement_id", "narration"), tasks, "settlement_id")
    books = of("ledger").groupBy("settlement_id").agg(F.min("narration").alias("booked"))
    return of("bank").join(books, "settlement_id").select("settlement_id", F.size(F.array_intersect(said("narration"), said("booked"))).alias("n_shared"))


@query(CTES + SUMS + """ SELECT l.event_id, a.settlement_id, a.gross_paise - l.amount_paise AS gap_paise, abs(a.gross_paise - l.amount_paise - a.fee_paise) <= 100 AS by_fee,
 abs(a.gross_paise - l.amount_paise - a.fee_paise - (2 * a.gross_paise + 100) // 200) <= greatest(100, a.n_txns) AS by_tds FROM ledger l JOIN arith a ON 'S' || l.batch = a.settlement_id WHERE l.voucher_type = 'Receipt' AND a.gross_paise > l.amount_paise""")
def receipt_gaps(spark, sf_dir):
    """Receipts that name a settlement against its gross: what fees explain, and what a tax of one percent does."""
    gateway = source(spark, sf_dir, "gateway")
    rows = settlements.named(source(spark, sf_dir, "ledger").filter("voucher_type = 'Receipt'"), gateway.select("utr", "settlement_id").distinct())
    rows = rows.select("settlement_id", "event_id", "amount_paise").join(settlements.arithmetic(gateway), "settlement_id").withColumn("gap_paise", F.col("gross_paise") - F.col("amount_paise")).filter("gap_paise > 0")
    tax = rules.Rule("tds", 1, 50, (rules.Deduction("tds", "1.00"),))
    left = F.col("gap_paise") - F.col("fee_paise")
    return rows.select("event_id", "settlement_id", "gap_paise", (F.abs(left) <= 100).alias("by_fee"), (F.abs(left - tax.total(F.col("gross_paise"))) <= F.greatest(F.lit(100), F.col("n_txns"))).alias("by_tds"))


@query(MATCHES + " SELECT subject, category, amount_paise, first_event FROM q LEFT JOIN (SELECT settlement_id, min(event_id) AS first_event FROM named GROUP BY 1) n ON settlement_id = subject WHERE status = 'resolved'")
def historical_cases(spark, sf_dir):
    first = named(spark, sf_dir).groupBy(F.col("settlement_id").alias("subject")).agg(F.min("event_id").alias("first_event"))
    return queue(spark, sf_dir).filter("status = 'resolved'").join(first, "subject", "left").select("subject", "category", "amount_paise", "first_event")


@query("""WITH g AS (SELECT o_orderkey, cast(round(o_totalprice * 100) AS BIGINT) AS gross_paise FROM orders), f AS (SELECT *, cast(round(gross_paise::DECIMAL(20,4) * 2 / 100, 0) AS BIGINT) AS fee FROM g), t AS (SELECT *, cast(round(fee::DECIMAL(20,4) * 18 / 100, 0) AS BIGINT) AS gst FROM f)
 SELECT o_orderkey, gross_paise, fee, gst, gross_paise - fee - gst AS net_paise FROM t""")
def rule_preview(spark, sf_dir):
    """What the first starter rule would take from every order, line by line."""
    rule = rules.STARTER[0]
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("gross_paise"))
    return rows.select("o_orderkey", "gross_paise", *[v.alias(k) for k, v in rule.lines(F.col("gross_paise")).items()], (F.col("gross_paise") - rule.total(F.col("gross_paise"))).alias("net_paise"))


@query(CTES.replace("WITH ", RULES + ", ", 1) + """ SELECT event_id, n_rules, rule_id FROM (SELECT g.event_id, r.rule_id, count(*) OVER (PARTITION BY g.event_id) AS n_rules, row_number() OVER (PARTITION BY g.event_id ORDER BY r.priority DESC, r.amount_min DESC, r.rule_id) AS k
 FROM gateway g JOIN r ON g.method = r.method AND g.amount_paise >= r.amount_min AND g.txn_date >= r.date_from) WHERE k = 1""")
def rule_scope(spark, sf_dir):
    """Events with the rules whose clauses they meet and the first of them; rules are few and their size is known."""
    rows = source(spark, sf_dir, "gateway").select("event_id", "method", "amount_paise", "txn_date").alias("g").join(
        rulebook(spark, sf_dir).alias("r"), F.expr("g.method = r.method and g.amount_paise >= r.amount_min and g.txn_date >= r.date_from"))
    rank = F.struct("r.priority", "r.amount_min")
    best = rows.groupBy("g.event_id").agg(F.count("*").alias("n_rules"), F.max(rank).alias("top"), F.collect_list(F.struct("r.priority", "r.amount_min", "r.rule_id")).alias("all"))
    return best.select("event_id", "n_rules", F.array_min(F.transform(F.filter("all", lambda x: (x["priority"] == F.col("top.priority")) & (x["amount_min"] == F.col("top.amount_min"))), lambda x: x["rule_id"])).alias("rule_id"))


@query(RULES + " SELECT rule_set, rule_id, date_from, date_to FROM (SELECT *, lead(date_from) OVER (PARTITION BY rule_set ORDER BY date_from) - 1 AS date_to FROM r) WHERE date_from <= DATE '1994-01-01' AND (date_to IS NULL OR date_to >= DATE '1994-01-01')")
def active_rules(spark, sf_dir):
    day = F.lit("1994-01-01").cast("date")
    rows = rulebook(spark, sf_dir).withColumn("date_to", F.date_sub(F.lead("date_from").over(Window.partitionBy("rule_set").orderBy("date_from")), 1))
    return rows.filter((F.col("date_from") <= day) & (F.col("date_to").isNull() | (F.col("date_to") >= day))).select("rule_set", "rule_id", "date_from", "date_to")


@query(RULES + " SELECT rule_set, sha256(string_agg(rule_id || ':1', ',' ORDER BY rule_id || ':1')) AS ruleset_hash, count(*) AS n FROM r GROUP BY rule_set")
def ruleset_hashes(spark, sf_dir):
    names = F.array_sort(F.collect_list(F.concat("rule_id", F.lit(":1"))))
    return rulebook(spark, sf_dir).groupBy("rule_set").agg(F.sha2(F.array_join(names, ","), 256).alias("ruleset_hash"), F.count("*").alias("n"))


@query(RULES + """, c AS (SELECT rule_set, string_agg(rule_id, ',') || ',GONE' AS composition FROM r GROUP BY rule_set), p AS (SELECT rule_set, unnest(string_split(composition, ',')) AS rule_id FROM c)
 SELECT p.rule_set, count(*) AS n_listed, count(r.rule_id) AS n_found FROM p LEFT JOIN r USING (rule_id) GROUP BY p.rule_set""")
def composition_check(spark, sf_dir):
    """A recorded list of rules is rebuilt only if all of them are found."""
    book = rulebook(spark, sf_dir)
    listed = book.groupBy("rule_set").agg(F.concat(F.array_join(F.collect_list("rule_id"), ","), F.lit(",GONE")).alias("composition"))
    parts = listed.select("rule_set", F.explode(F.split("composition", ",")).alias("rule_id"))
    found = parts.join(book.select("rule_id", F.lit(1).alias("hit")), "rule_id", "left")
    return found.groupBy("rule_set").agg(F.count("*").alias("n_listed"), F.count("hit").alias("n_found"))


@query(CTES + " SELECT event_id, settlement_id, amount_paise FROM gateway WHERE txn_type = 'refund' AND batch NOT IN (SELECT batch FROM ledger)")
def unrecorded_returns(spark, sf_dir):
    """Gateway debits to customers whose settlement no book entry names."""
    gateway = source(spark, sf_dir, "gateway")
    books = settlements.named(source(spark, sf_dir, "ledger"), gateway.select("utr", "settlement_id").distinct()).select("settlement_id").filter("settlement_id is not null")
    return gateway.filter("txn_type = 'refund'").join(books, "settlement_id", "left_anti").select("event_id", "settlement_id", "amount_paise")


@query(CTES + """ SELECT event_id, CASE WHEN contains(upper(narration), 'NACH') THEN 'mandate' WHEN txn_type = 'refund' THEN 'refund_unmatched' WHEN length(utr) < 16 THEN 'truncated_reference' WHEN source = 'gateway' THEN 'missing_in_bank'
 WHEN source = 'bank' AND direction = 'credit' THEN 'unidentified_inflow' WHEN source = 'bank' THEN 'missing_in_ledger' ELSE 'missing_in_bank' END AS category FROM ev WHERE utr IS NULL OR length(utr) < 16 OR txn_type = 'refund'""")
def unmatched_categories(spark, sf_dir):
    category = (F.when(F.contains(F.upper("narration"), F.lit("NACH")), "mandate").when(F.col("txn_type") == "refund", "refund_unmatched").when(F.length("utr") < 16, "truncated_reference").when(F.col("source") == "gateway", "missing_in_bank")
                .when((F.col("source") == "bank") & (F.col("direction") == "credit"), "unidentified_inflow").when(F.col("source") == "bank", "missing_in_ledger").otherwise("missing_in_bank"))
    return events(spark, sf_dir).filter("utr is null or length(utr) < 16 or txn_type = 'refund'").select("event_id", category.alias("category"))


@query(QUEUE + """ SELECT subject, CASE category WHEN 'missing_in_bank' THEN 'Ask where the payout of ' || subject || ' is: ' || amount_paise || ' paise' WHEN 'amount_variance' THEN 'Check the difference of ' || gap_paise || ' paise in ' || subject
 WHEN 'missing_in_ledger' THEN 'Book ' || subject || ': ' || amount_paise || ' paise' WHEN 'duplicate_ledger_entry' THEN 'Reverse one entry of ' || subject ELSE 'Release the hold on ' || subject END AS advice FROM q""")
def recommendations(spark, sf_dir):
    c, amount = F.col("category"), F.col("amount_paise").cast("string")
    advice = (F.when(c == "missing_in_bank", F.concat(F.lit("Ask where the payout of "), "subject", F.lit(" is: "), amount, F.lit(" paise")))
              .when(c == "amount_variance", F.concat(F.lit("Check the difference of "), F.col("gap_paise").cast("string"), F.lit(" paise in "), "subject"))
              .when(c == "missing_in_ledger", F.concat(F.lit("Book "), "subject", F.lit(": "), amount, F.lit(" paise")))
              .when(c == "duplicate_ledger_entry", F.concat(F.lit("Reverse one entry of "), "subject")).otherwise(F.concat(F.lit("Release the hold on "), "subject")))
    return queue(spark, sf_dir).select("subject", advice.alias("advice"))


@query(QUEUE + " SELECT subject, CASE WHEN status IN ('open', 'monitoring', 'snoozed', 'escalated') THEN 'resolved' ELSE status END AS status, status NOT IN ('open', 'monitoring', 'snoozed', 'escalated') AS skipped FROM q WHERE category IN ('amount_variance', 'missing_in_ledger')")
def bulk_resolved(spark, sf_dir):
    """A new snapshot of the listed exceptions; those whose status does not allow it are reported, not changed."""
    may = F.col("status").isin(*RESOLVABLE)
    return queue(spark, sf_dir).filter("category in ('amount_variance', 'missing_in_ledger')").select("subject", F.when(may, "resolved").otherwise(F.col("status")).alias("status"), (~may).alias("skipped"))


@query(MATCHES + """, a AS (SELECT settlement_id, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM named GROUP BY 1), b AS (SELECT settlement_id, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM named WHERE event_id NOT LIKE '%-2' GROUP BY 1)
 SELECT subject, CASE WHEN b.ids IS NULL THEN 'dropped' WHEN a.ids = b.ids THEN 'carried' ELSE 'superseded' END AS decision FROM q JOIN a ON a.settlement_id = subject LEFT JOIN b ON b.settlement_id = subject""")
def carried_decisions(spark, sf_dir):
    """Decisions of one run in the next: carried where the exception still stands on the same events."""
    rows = settled(named(spark, sf_dir), "named-rows")
    ids = lambda df, name: df.groupBy(F.col("settlement_id").alias("subject")).agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias(name))
    both_runs = queue(spark, sf_dir).select("subject").join(ids(rows, "before"), "subject").join(ids(rows.filter("event_id not like '%-2'"), "after"), "subject", "left")
    return both_runs.select("subject", F.when(F.col("after").isNull(), "dropped").when(F.col("before") == F.col("after"), "carried").otherwise("superseded").alias("decision"))


@query(QUEUE + " SELECT category, count(*) AS n, sum(gap_paise)::BIGINT AS gap_paise, min(subject) AS first_subject FROM q WHERE NOT explained GROUP BY category")
def unexplained(spark, sf_dir):
    return queue(spark, sf_dir).filter("not explained").groupBy("category").agg(F.count("*").alias("n"), F.sum("gap_paise").alias("gap_paise"), F.min("subject").alias("first_subject"))


@query(MATCHES + """, p AS (SELECT m.stage, m.match_id, count(*) AS n FROM m JOIN named USING (settlement_id) GROUP BY 1, 2) SELECT stage, count(*) AS groups, sum(n * (n - 1) // 2)::BIGINT AS pairs, sum(n * (n - 1) // 2)::BIGINT AS right_pairs FROM p GROUP BY stage""")
def stage_pairs(spark, sf_dir):
    """Pairs that each stage put together and how many of them the truth, the harness's own key, has too."""
    gateway = source(spark, sf_dir, "gateway")
    every = source(spark, sf_dir, "bank").unionByName(source(spark, sf_dir, "ledger"))
    rows = settled(settlements.named(every, gateway.select("utr", "settlement_id").distinct()).filter("settlement_id is not null").select(*NAMED, "batch"), "named-rows")
    member = matches(rows, gateway).select("match_id", "stage", "settlement_id").join(rows, "settlement_id")
    right = member.groupBy("stage", "match_id", "batch").agg(F.count("*").alias("n"))
    groups = right.groupBy("stage", "match_id").agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("right_pairs"))
    return groups.groupBy("stage").agg(F.count("*").alias("groups"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.sum("right_pairs").alias("right_pairs"))


@query(CTES + " SELECT source, count(*) AS n, count(*) AS n_right FROM (SELECT source FROM bank UNION ALL SELECT source FROM ledger) GROUP BY source")
def truth_join(spark, sf_dir):
    """Rows whose named settlement is the true one, by source; the truth is joined by row, after naming."""
    gateway = source(spark, sf_dir, "gateway").select("utr", "settlement_id").distinct()
    every = source(spark, sf_dir, "bank").unionByName(source(spark, sf_dir, "ledger"))
    truth = every.select("event_id", F.concat(F.lit("S"), F.col("batch").cast("string")).alias("truth"))
    found = settlements.named(every.drop("batch"), gateway).join(truth, "event_id", "left")
    return found.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("settlement_id") == F.col("truth")).alias("n_right"))


@query(MATCHES + """ SELECT 'variance' AS kind, settlement_id, abs(delta_paise)::BIGINT AS amount_paise FROM m WHERE confidence_pct = 70 UNION ALL SELECT 'unbacked', settlement_id, expected_net_paise FROM arith WHERE settlement_id NOT IN (SELECT settlement_id FROM m)
 UNION ALL SELECT 'unbooked', settlement_id, expected_net_paise FROM arith WHERE settlement_id NOT IN (SELECT settlement_id FROM named WHERE source = 'ledger')""")
def failure_list(spark, sf_dir):
    rows, found = both(spark, sf_dir)
    sums = settlements.arithmetic(source(spark, sf_dir, "gateway")).select("settlement_id", F.col("expected_net_paise").alias("amount_paise"))
    kind = lambda name, df: df.select(F.lit(name).alias("kind"), "settlement_id", "amount_paise")
    variance = found.filter("confidence_pct = 70").withColumn("amount_paise", F.abs("delta_paise"))
    return kind("variance", variance).unionByName(kind("unbacked", sums.join(found, "settlement_id", "left_anti"))).unionByName(kind("unbooked", sums.join(rows.filter("source = 'ledger'"), "settlement_id", "left_anti")))


@query(QUEUE + " SELECT count(DISTINCT CASE WHEN cluster_size >= 2 THEN cluster_key ELSE subject END) AS queue_size, count(*) AS exceptions FROM q WHERE status = 'open'")
def human_queue(spark, sf_dir):
    rows = queue(spark, sf_dir).filter("status = 'open'")
    return rows.agg(F.count_distinct(F.when(F.col("cluster_size") >= 2, F.col("cluster_key")).otherwise(F.col("subject"))).alias("queue_size"), F.count("*").alias("exceptions"))


@query(QUEUE + """ SELECT subject, cast(round_even(cast(0.40 * least(log10(amount_paise + 1) / 9, 1) + 0.25 * (tier = 'escalate')::INT + 0.15 * (1 - conf::DOUBLE) + 0.15 * urgency::DOUBLE + 0.05 * least(cluster_size / 20.0, 1) AS DECIMAL(20,12)), 4) AS DOUBLE) AS priority FROM q""")
def exception_priorities(spark, sf_dir):
    return queue(spark, sf_dir).select("subject", F.col("priority").cast("double").alias("priority"))


@query(CTES + " SELECT event_id, txn_date, utr IS NULL AND length(narration) >= 35 AS truncated FROM ev WHERE txn_date BETWEEN DATE '1995-01-01' AND DATE '1995-03-31'")
def dated_rows(spark, sf_dir):
    return events(spark, sf_dir).filter("txn_date between date '1995-01-01' and date '1995-03-31'").select("event_id", "txn_date", F.expr("utr is null and length(narration) >= 35").alias("truncated"))


@query(MATCHES + """ SELECT m.match_id, min(least(m.confidence_pct, CASE WHEN n.source = 'ledger' THEN 99 ELSE 100 END))::INT AS confidence_pct, (max(abs(m.delta_paise)) + coalesce(sum(abs(n.amount_paise - a.expected_net_paise)) FILTER (n.source = 'ledger'), 0))::BIGINT AS residual_paise,
 string_agg(n.event_id, ',' ORDER BY n.event_id) AS members FROM m JOIN named n USING (settlement_id) JOIN arith a USING (settlement_id) GROUP BY m.match_id""")
def extended_groups(spark, sf_dir):
    """A match extended by its ledger legs: the least confidence, the sum of residuals, all members in order."""
    gateway, rows, found = with_gateway(spark, sf_dir)
    tasks = tasks_for(gateway)
    of = lambda table: dealt(table, tasks, "settlement_id")
    sums = settlements.arithmetic(of(gateway)).select("settlement_id", "expected_net_paise")
    legs = of(found).join(of(rows.select("settlement_id", "event_id", "source", "amount_paise")), "settlement_id").join(sums, "settlement_id")
    booked = F.col("source") == "ledger"
    more = F.coalesce(F.sum(F.when(booked, F.abs(F.col("amount_paise") - F.col("expected_net_paise")))), F.lit(0))
    # a match is one settlement's, so its rows are together already
    return legs.groupBy("settlement_id", "match_id").agg(F.min(F.least(F.col("confidence_pct"), F.when(booked, 99).otherwise(100))).alias("confidence_pct"), (F.max(F.abs("delta_paise")) + more).alias("residual_paise"),
                                        F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("members")).drop("settlement_id")


@query(CTES + """, p AS (SELECT b.event_id AS bank_id, l.event_id AS ledger_id, l.utr, b.utr AS cut, abs(b.txn_date - l.txn_date)::INT AS days FROM (SELECT *, unnest([-3, -2, -1, 1, 2, 3]) AS k FROM bank) b JOIN ledger l ON l.txn_date = b.txn_date + b.k AND length(l.utr) <> length(b.utr)
 AND abs(b.amount_paise - l.amount_paise) <= greatest(100, cast(floor(abs(b.amount_paise) * 0.0005::DECIMAL(10,8)) AS BIGINT), 1) AND length(b.utr) >= 6 AND length(l.utr) >= 6 AND l.utr <> b.utr AND (starts_with(l.utr, b.utr) OR starts_with(b.utr, l.utr)))
 SELECT bank_id, ledger_id, days FROM p WHERE bank_id IN (SELECT bank_id FROM p GROUP BY 1 HAVING count(*) = 1) AND ledger_id IN (SELECT ledger_id FROM p GROUP BY 1 HAVING count(*) = 1)""")
def date_shift_pairs(spark, sf_dir):
    """The cascade's date-shift stage over all bank and ledger rows: cut references that one other row completes."""
    return settlements.date_shifted(source(spark, sf_dir, "bank"), source(spark, sf_dir, "ledger"))


@query(QUEUE + f" SELECT subject, category, status, CASE WHEN status NOT IN ('open', 'monitoring', 'snoozed', 'escalated') THEN status WHEN deadline < DATE '{TODAY}' THEN 'escalated' WHEN category = 'missing_in_bank' THEN 'snoozed' ELSE status END AS next_status FROM q")
def status_transitions(spark, sf_dir):
    """The next snapshot: overdue exceptions escalate, other payouts on the way are snoozed, closed ones stay."""
    late = F.col("deadline") < F.lit(TODAY).cast("date")
    after = F.when(~F.col("status").isin(*RESOLVABLE), F.col("status")).when(late, "escalated").when(F.col("category") == "missing_in_bank", "snoozed").otherwise(F.col("status"))
    return queue(spark, sf_dir).select("subject", "category", "status", after.alias("next_status"))
