"""Parsing and scanning queries: narrations, references, money text, scans of free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from trisettle.functions import money, text
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


@query(CTES + r""" SELECT event_id, 'neft' AS rail, 'UTR' || lpad(batch::VARCHAR, 13, '0') AS reference, CASE WHEN batch % 5 = 0 THEN 'Settlement credit S' || batch ELSE 'GATEWAY PAYMENTS' END AS counterparty FROM bank""")
def narration_fields(spark, sf_dir):
    return source(spark, sf_dir, "bank").select("event_id", text.parse_narration(F.col("narration")).alias("x")).select("event_id", "x.rail", "x.reference", "x.counterparty")


@query(CTES + r""" SELECT event_id, CASE WHEN len(list_distinct(list_filter(regexp_extract_all(upper(narration), '[A-Z0-9]{8,}'), lambda x: regexp_matches(x, '[0-9]{4}')))) = 1
 THEN list_filter(regexp_extract_all(upper(narration), '[A-Z0-9]{8,}'), lambda x: regexp_matches(x, '[0-9]{4}'))[1] END AS document FROM ev""")
def document_references(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", text.document_reference(F.col("narration")).alias("document"))


@query(CTES + r""" SELECT event_id, length(repeat(narration, 3)) >= 98 AND rail IS NOT NULL AND (utr IS NULL OR length(utr) < CASE rail WHEN 'imps' THEN 12 ELSE 16 END) AS truncated FROM bank""")
def truncated_narrations(spark, sf_dir):
    return source(spark, sf_dir, "bank").select("event_id", text.is_truncated(F.repeat("narration", F.lit(3)), F.col("rail"), F.col("utr")).alias("truncated"))


@query(CTES + r""" SELECT trim(regexp_replace(regexp_replace(upper(counterparty), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name, count(*) AS n FROM ev GROUP BY 1""")
def counterparty_names(spark, sf_dir):
    return events(spark, sf_dir).groupBy(text.normalise_counterparty(F.col("counterparty")).alias("name")).agg(F.count("*").alias("n"))


@query(r"""WITH c AS (SELECT c_custkey, cast(round(c_acctbal * 100) AS BIGINT) AS p FROM customer), t AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'INR ' ELSE '' END || CASE WHEN p < 0 THEN '(-)' ELSE '' END || (abs(p) // 100) || '.' || lpad((abs(p) % 100)::VARCHAR, 2, '0') AS txt FROM c)
 SELECT c_custkey, p AS paise FROM t""")
def rupee_text(spark, sf_dir):
    paise = F.round(F.col("c_acctbal") * 100).cast("bigint")
    size = F.abs(paise)
    written = F.concat(F.when(F.col("c_custkey") % 3 == 0, "INR ").otherwise(""), F.when(paise < 0, "(-)").otherwise(""), ((size - size % 100) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", money.to_paise(written).alias("paise"))


@query(r"""WITH c AS (SELECT o_orderkey, cast(round(o_totalprice * 100) AS BIGINT) * (1 + (o_orderkey % 3)) AS p FROM orders), d AS (SELECT *, (p // 100)::VARCHAR AS w FROM c)
 SELECT o_orderkey, '₹' || CASE WHEN length(w) > 3 THEN (CASE WHEN (length(w) - 3) % 2 = 1 THEN w[1] || CASE WHEN length(w) > 4 THEN ',' ELSE '' END ELSE '' END) ||
 array_to_string(list_transform(range(1 + (length(w) - 3) % 2, length(w) - 3, 2), lambda i: substr(w, i, 2)), ',') || ',' || right(w, 3) ELSE w END || '.' || lpad((p % 100)::VARCHAR, 2, '0') AS printed FROM d""")
def indian_money(spark, sf_dir):
    paise = F.round(F.col("o_totalprice") * 100).cast("bigint") * (1 + F.col("o_orderkey") % 3)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", money.fmt_inr(paise).alias("printed"))


@query(r"""WITH s AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, 'https?://', 'i') THEN 'url' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9+/]{60,}={0,2}') THEN 'encoded' END], lambda x: x IS NOT NULL) AS hits FROM documents) SELECT doc_id, array_to_string(hits, ',') AS hits FROM s WHERE len(hits) > 0""")
def injection_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hits = F.filter(text.injection_hits(F.col("text")), lambda x: x.isin("url", "encoded"))
    return docs.select("doc_id", F.array_join(hits, ",").alias("hits")).filter("hits <> ''")


@query(r"""SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS n_numbers FROM conversations""")
def numbers_in_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)))).cast("bigint").alias("n_numbers"))


@query(CTES + r""" SELECT event_id, sha256(concat_ws('|', txn_date::VARCHAR, amount_paise::VARCHAR, narration)) AS idempotency_key FROM bank""")
def idempotency_keys(spark, sf_dir):
    return source(spark, sf_dir, "bank").select("event_id", F.sha2(F.concat_ws("|", F.col("txn_date").cast("string"), F.col("amount_paise").cast("string"), "narration"), 256).alias("idempotency_key"))


@query(r"""SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+'))::VARCHAR IS NOT NULL AND coalesce(len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda x: NOT contains(text, x))), 0) = 0 AS grounded FROM documents""")
def grounded_in_itself(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", text.grounded(F.col("text"), F.col("text")).alias("grounded"))


@query(r"""WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
 SELECT l_orderkey, l_linenumber, n - 1 AS skipped FROM r WHERE k = 1""")
def load_once(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy("l_orderkey", "l_linenumber").agg((F.count("*") - 1).alias("skipped"))


@query(r"""WITH v AS (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice <= 1000 THEN 'amount too small' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status unknown' END, CASE WHEN o_orderkey % 97 = 0 THEN 'reserved key' END], lambda x: x IS NOT NULL) AS reasons FROM orders)
 SELECT o_orderkey, array_to_string(reasons, '; ') AS reasons FROM v WHERE len(reasons) > 0""")
def typed_rejects(spark, sf_dir):
    from trisettle.sources.readers import rejects

    rules = {"amount too small": F.col("o_totalprice") <= 1000, "status unknown": ~F.col("o_orderstatus").isin("F", "O"), "reserved key": F.col("o_orderkey") % 97 == 0}
    _, bad = rejects(spark.read.parquet(f"{sf_dir}/orders.parquet"), rules)
    return bad.select("o_orderkey", F.array_join("reasons", "; ").alias("reasons"))
