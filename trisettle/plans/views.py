"""Lists, summaries, audit, evaluation and event-stream queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trisettle.operators import audit, evaluate, exceptions, settlements
from trisettle.operators.shared import settled
from trisettle.plans.matching import SUMS
from trisettle.sources.harness import CTES, derived, events, source
from trisettle.streaming import windows

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(CTES + " SELECT coalesce(source, 'all') AS source, count(*) AS n, sum(amount_paise)::BIGINT AS amount_paise FROM ev GROUP BY GROUPING SETS ((source), ())")
def events_by_source(spark, sf_dir):
    return events(spark, sf_dir).rollup("source").agg(F.count("*").alias("n"), F.sum("amount_paise").alias("amount_paise")).withColumn("source", F.coalesce("source", F.lit("all")))


@query(CTES + " SELECT event_id, coalesce(utr, settlement_id, order_id) AS reference FROM ev")
def best_reference(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.coalesce("utr", "settlement_id", "order_id").alias("reference"))


@query(CTES + " SELECT event_id, amount_paise FROM ev WHERE contains(lower(concat_ws(' ', utr, settlement_id, order_id, narration, counterparty)), 'customer 12') OR amount_paise // 100 = 12345")
def record_search(spark, sf_dir):
    found = F.contains(F.lower(F.concat_ws(" ", "utr", "settlement_id", "order_id", "narration", "counterparty")), F.lit("customer 12"))
    return events(spark, sf_dir).filter(found | (F.expr("amount_paise div 100") == 12345)).select("event_id", "amount_paise")


@query(CTES + " SELECT event_id, source, direction, settlement_id FROM ev WHERE source = 'gateway' AND direction = 'credit' AND settlement_id LIKE 'S1%'")
def event_list(spark, sf_dir):
    return events(spark, sf_dir).filter("source = 'gateway' and direction = 'credit' and settlement_id like 'S1%'").select("event_id", "source", "direction", "settlement_id")


@query(CTES + """, k AS (SELECT 'utr' AS kind, utr AS value FROM ev UNION SELECT 'settlement_id', settlement_id FROM ev UNION SELECT 'order_id', order_id FROM ev)
 SELECT kind, value FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value) AS r FROM k WHERE value LIKE '%12%') WHERE r <= 3""")
def near_references(spark, sf_dir):
    names = ["utr", "settlement_id", "order_id"]
    rows = events(spark, sf_dir).select(*[F.when(F.col(c).like("%12%"), F.col(c)).alias(c) for c in names]).dropna("all")
    return exceptions.smallest(settled(rows, "reference-values"), names, 3)


@query(CTES + SUMS + """ SELECT a.settlement_id, a.expected_net_paise, b.amount_paise AS bank_paise, l.booked AS ledger_paise, l.n AS ledger_rows,
 CASE WHEN b.amount_paise IS NULL THEN 'missing in bank' WHEN l.booked IS NULL THEN 'missing in books' WHEN l.n > 1 THEN 'booked twice' WHEN abs(b.amount_paise - a.expected_net_paise) <= 100 THEN 'settled' ELSE 'differs' END AS state
 FROM arith a LEFT JOIN bank b ON 'S' || b.batch = a.settlement_id LEFT JOIN (SELECT batch, sum(amount_paise)::BIGINT AS booked, count(*) AS n FROM ledger GROUP BY batch) l ON 'S' || l.batch = a.settlement_id""")
def settlement_register(spark, sf_dir):
    from trisettle.operators.settlements import arithmetic, named

    gateway, credits, ledger = derived(spark, sf_dir)
    bank = named(credits, gateway).select("settlement_id", F.col("amount_paise").alias("bank_paise"))
    books = named(ledger, gateway).groupBy("settlement_id").agg(F.sum("amount_paise").alias("ledger_paise"), F.count("*").alias("ledger_rows"))
    state = (F.when(F.col("bank_paise").isNull(), "missing in bank").when(F.col("ledger_paise").isNull(), "missing in books").when(F.col("ledger_rows") > 1, "booked twice")
             .when(F.abs(F.col("bank_paise") - F.col("expected_net_paise")) <= 100, "settled").otherwise("differs"))
    rows = arithmetic(gateway).join(bank, "settlement_id", "left").join(books, "settlement_id", "left")
    return rows.select("settlement_id", "expected_net_paise", "bank_paise", "ledger_paise", "ledger_rows", state.alias("state"))


@query("""WITH t AS (SELECT user_id, event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS behind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 s AS (SELECT user_id, event_id, before, event_id % 997 = 5 AS edited, CASE WHEN event_id % 983 = 11 AND before IS NOT NULL THEN before WHEN behind % 983 = 11 THEN behind ELSE event_id END AS seq FROM t),
 l AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY seq, event_id) AS stands_after FROM s WHERE event_id % 991 <> 7)
 SELECT user_id, min(seq) AS first_bad FROM l WHERE edited OR stands_after IS DISTINCT FROM before GROUP BY user_id""")
def chain_breaks(spark, sf_dir):
    """All events chained by user, then some edited, some taken out and some put before their predecessor."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lag("event_id").over(order).alias("before"), F.lead("event_id").over(order).alias("behind"))
    chained = settled(audit.append(rows.select(F.col("user_id").cast("string").alias("tenant"), F.col("event_id").alias("seq"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("payload"))), "events-chained")
    log = chained.join(rows.select(F.col("event_id").alias("seq"), "user_id", "before", "behind"), "seq").filter("seq % 991 <> 7")
    log = log.withColumn("payload", F.when(F.col("seq") % 997 == 5, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
    moved = F.when((F.col("seq") % 983 == 11) & F.col("before").isNotNull(), F.col("before")).when(F.col("behind") % 983 == 11, F.col("behind")).otherwise(F.col("seq"))
    return audit.verify(log.withColumn("seq", moved)).select(F.col("tenant").cast("long").alias("user_id"), "first_bad")


@query("""SELECT user_id, seq, before FROM (SELECT user_id, seq, lag(seq) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id FROM events) WHERE event_id % 50 <> 7) WHERE seq <> before + 1""")
def sequence_gaps(spark, sf_dir):
    own = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(own.orderBy("event_id")).cast("bigint").alias("seq")).filter("event_id % 50 <> 7")
    return rows.withColumn("before", F.lag("seq").over(own.orderBy("seq"))).filter("seq <> before + 1").select("user_id", "seq", "before")


@query("""SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id)""")
def activity_rollup(spark, sf_dir):
    return table(spark, sf_dir, "events").rollup("event_type", "user_id").agg(F.count("*").alias("n"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def hourly_events(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("""WITH h AS (SELECT unnest(generate_series(0, 2)) AS k), e AS (SELECT time_bucket(INTERVAL '20 minutes', ts) - k * INTERVAL '20 minutes' AS start, value FROM events, h) SELECT start, count(*) AS n, round(max(value), 4) AS top FROM e GROUP BY start""")
def sliding_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "20 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top"))
    return rows.select(F.col("w.start").alias("start"), "n", "top")


GROUPS = CTES + """, pred AS (SELECT event_id, CASE WHEN source = 'gateway' OR length(utr) >= 16 THEN batch END AS grp, batch AS truth FROM ev WHERE source <> 'ledger'), p AS (SELECT event_id, coalesce(grp::VARCHAR, event_id) AS grp, truth FROM pred)"""


@query(GROUPS + """, a AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM p GROUP BY grp)), b AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM p GROUP BY truth)), c AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM p GROUP BY grp, truth)), t AS (SELECT count(*) * (count(*) - 1) / 2 AS x FROM p)
 SELECT c.x::BIGINT AS true_positive, (a.x - c.x)::BIGINT AS false_positive, (b.x - c.x)::BIGINT AS false_negative, (t.x - a.x - b.x + c.x)::BIGINT AS true_negative FROM a, b, c, t""")
def pair_confusion(spark, sf_dir):
    rows = events(spark, sf_dir).filter("source <> 'ledger'")
    known = (F.col("source") == "gateway") | F.coalesce(F.length("utr") >= 16, F.lit(False))
    return evaluate.pair_confusion(rows.select(F.when(known, F.col("batch").cast("string")).otherwise(F.col("event_id")).alias("group"), F.col("batch").cast("string").alias("truth")))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, (700 + (l_orderkey * 7 + l_linenumber) % 301) AS score FROM lineitem), t AS (SELECT unnest(generate_series(700, 1000, 10)) AS threshold) SELECT threshold, count(*) FILTER (score >= threshold) AS closed, count(*) AS total FROM c, t GROUP BY threshold""")
def coverage_curve(spark, sf_dir):
    score = 700 + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 301
    return evaluate.coverage(table(spark, sf_dir, "lineitem").select(score.alias("score")), range(700, 1001, 10))


@query(CTES + """, m AS (SELECT batch, count(DISTINCT source) AS n_sources, count(*) AS n FROM ev GROUP BY batch) SELECT n_sources, count(*) AS groups, sum(n)::BIGINT AS events FROM m GROUP BY n_sources""")
def source_coverage(spark, sf_dir):
    gateway, bank, ledger = derived(spark, sf_dir)
    rows = settlements.named(bank.unionByName(ledger), gateway).select("settlement_id", "source").unionByName(gateway.select("settlement_id", "source"))
    groups = rows.groupBy("settlement_id").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n"))
    return groups.groupBy("n_sources").agg(F.count("*").alias("groups"), F.sum("n").alias("events"))


@query(CTES + """ SELECT batch, min(event_id) AS first_event, arg_min(event_id, lpad((1000000000000 - amount_paise)::BIGINT::VARCHAR, 14, '0') || event_id) AS largest_event, array_to_string(list_sort(list(event_id)), ',') AS members FROM ev WHERE source <> 'gateway' GROUP BY batch""")
def match_members(spark, sf_dir):
    rows = events(spark, sf_dir).filter("source <> 'gateway'")
    return rows.groupBy("batch").agg(F.min("event_id").alias("first_event"), F.min(F.struct((-F.col("amount_paise")).alias("a"), "event_id")).getField("event_id").alias("largest_event"), F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("members"))


@query("""SELECT p_brand, p_partkey AS version, p_retailprice, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS until_version FROM part""")
def version_windows(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("version"), "p_retailprice", (F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("until_version"))


@query("""SELECT n_name, o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS closed FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def orders_by_nation(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))
