"""Three sources derived from the test tables ``orders`` and ``lineitem``.

A test harness, not evidence of reconciliation: the bank and ledger sides are the gateway's with keyed perturbations.
One text of integer SQL that Spark and DuckDB both run, so that both sides of a check start from the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trisettle.operators.shared import dealt, settled, tasks_for

GATEWAY = """
SELECT 'g' || lpad(cast(o.o_orderkey AS varchar(20)), 13, '0') || '-' || cast(x.l_linenumber AS varchar(5)) AS event_id,
       'gateway' AS source, x.amount AS amount_paise, 'credit' AS direction, cast(o.o_orderdate AS date) AS txn_date,
       'UTR' || lpad(cast(o.o_orderkey AS varchar(20)), 13, '0') AS utr, 'S' || cast(o.o_orderkey AS varchar(20)) AS settlement_id,
       'O' || cast(o.o_orderkey AS varchar(20)) || '-' || cast(x.l_linenumber AS varchar(5)) AS order_id,
       CASE WHEN o.o_orderkey % 37 = 0 AND x.l_linenumber = 1 THEN 'refund' ELSE 'payment' END AS txn_type,
       'Customer ' || cast(o.o_custkey AS varchar(20)) AS counterparty,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'upi' WHEN 2 THEN 'netbanking' ELSE 'wallet' END AS method,
       cast(NULL AS varchar(10)) AS rail, 'order ' || cast(o.o_orderkey AS varchar(20)) AS narration, x.fee AS fee_paise,
       (x.fee * 18 - (x.fee * 18) % 118) AS tax_raw, o.o_orderkey % 41 = 0 AS on_hold, cast(NULL AS varchar(30)) AS ledger_account,
       cast(NULL AS varchar(10)) AS voucher_type, o.o_orderkey AS batch
FROM (SELECT l_orderkey, l_linenumber, sum(cents - fee) AS amount, sum(fee) AS fee
      FROM (SELECT l_orderkey, l_linenumber, cents, cast((cents * pct - (cents * pct) % 100) / 100 AS bigint) AS fee
            FROM (SELECT l_orderkey, l_linenumber, cast(round(l_extendedprice * 100) AS bigint) AS cents, cast(round(l_discount * 100) AS bigint) AS pct FROM lineitem) c) f
      GROUP BY l_orderkey, l_linenumber) x
JOIN orders o ON o.o_orderkey = x.l_orderkey
"""

BANK = """
SELECT 'b' || lpad(cast(batch AS varchar(20)), 13, '0') AS event_id, 'bank' AS source,
       CASE WHEN batch % 13 = 0 THEN net + 50 WHEN batch % 19 = 0 THEN net - cast((net - net % 100) / 100 AS bigint) ELSE net END AS amount_paise,
       'credit' AS direction, txn_date + cast(batch % 4 AS int) AS txn_date,
       CASE WHEN batch % 7 = 0 THEN NULL WHEN batch % 11 = 0 THEN substr('UTR' || lpad(cast(batch AS varchar(20)), 13, '0'), 1, 9)
            ELSE 'UTR' || lpad(cast(batch AS varchar(20)), 13, '0') END AS utr,
       cast(NULL AS varchar(20)) AS settlement_id, cast(NULL AS varchar(20)) AS order_id, cast(NULL AS varchar(10)) AS txn_type,
       'Gateway Payments' AS counterparty, cast(NULL AS varchar(10)) AS method, CASE batch % 3 WHEN 0 THEN 'neft' WHEN 1 THEN 'rtgs' ELSE 'imps' END AS rail,
       CASE WHEN batch % 5 = 0 THEN 'NEFT/UTR' || lpad(cast(batch AS varchar(20)), 13, '0') || '/Settlement credit S' || cast(batch AS varchar(20))
            ELSE 'NEFT-UTR' || lpad(cast(batch AS varchar(20)), 13, '0') || '-GATEWAY PAYMENTS' END AS narration,
       cast(NULL AS bigint) AS fee_paise, cast(NULL AS bigint) AS tax_raw, false AS on_hold, cast(NULL AS varchar(30)) AS ledger_account,
       cast(NULL AS varchar(10)) AS voucher_type, batch
FROM (SELECT batch, min(txn_date) AS txn_date, sum(amount_paise) AS net FROM gateway GROUP BY batch) s
WHERE batch % 17 <> 0
"""

LEDGER = """
SELECT 'l' || lpad(cast(batch AS varchar(20)), 13, '0') || '-' || cast(copy AS varchar(2)) AS event_id, 'ledger' AS source,
       CASE WHEN batch % 31 = 0 THEN net - cast((net - net % 100) / 100 AS bigint) ELSE net END AS amount_paise, 'debit' AS direction,
       txn_date + cast(batch % 2 AS int) AS txn_date, CASE WHEN batch % 3 = 0 THEN NULL ELSE 'UTR' || lpad(cast(batch AS varchar(20)), 13, '0') END AS utr,
       cast(NULL AS varchar(20)) AS settlement_id, cast(NULL AS varchar(20)) AS order_id, cast(NULL AS varchar(10)) AS txn_type,
       'Gateway Payments' AS counterparty, cast(NULL AS varchar(10)) AS method, cast(NULL AS varchar(10)) AS rail,
       'Settlement credit S' || cast(batch AS varchar(20)) AS narration, cast(NULL AS bigint) AS fee_paise, cast(NULL AS bigint) AS tax_raw, false AS on_hold,
       CASE batch % 6 WHEN 0 THEN 'Bank Charges' WHEN 1 THEN 'Current A/c 12' ELSE 'Main Bank' END AS ledger_account,
       CASE batch % 5 WHEN 0 THEN 'Journal' WHEN 1 THEN 'Sales' ELSE 'Receipt' END AS voucher_type, batch
FROM (SELECT batch, min(txn_date) AS txn_date, sum(amount_paise) AS net FROM gateway GROUP BY batch) s
CROSS JOIN (SELECT 1 AS copy UNION ALL SELECT 2 AS copy) c
WHERE batch % 23 <> 0 AND (copy = 1 OR batch % 29 = 0)
"""

#: Common table expressions that an oracle starts with.
CTES = f"WITH gateway AS ({GATEWAY}), bank AS ({BANK}), ledger AS ({LEDGER}), ev AS (SELECT * FROM gateway UNION ALL SELECT * FROM bank UNION ALL SELECT * FROM ledger)"


KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """The tables as views; those of orders are dealt by order, into as many tasks as the largest asks for, so that lines are
    summed and joined with their order in one shuffle and come out beside each other."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}
    tasks = max(tasks_for(table) for table in tables.values())
    for name, table in tables.items():
        (dealt(table, tasks, KEYS[name]) if name in KEYS else table).createOrReplaceTempView(name)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``gateway``, ``bank``, ``ledger`` or ``ev``, all three."""
    register(spark, sf_dir, "orders", "lineitem")
    return spark.sql(f"{CTES} SELECT * FROM {name}")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "ev")


def derived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gateway, bank and ledger rows; the gateway's are written once, the others derived from that table."""
    gateway = settled(source(spark, sf_dir, "gateway"), "gateway")
    view = f"gateway_{uuid.uuid4().hex}"
    gateway.createOrReplaceTempView(view)
    bank, ledger = (spark.sql(text.replace("FROM gateway", f"FROM {view}")) for text in (BANK, LEDGER))
    return gateway, bank, ledger
