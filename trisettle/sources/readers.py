"""Readers for the three source files, and writers for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trisettle.functions import money, text

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()
#: Fixed schema of the gateway report; nothing is inferred.
GATEWAY = T.StructType([T.StructField(n, t) for n, t in (
    ("entity_id", _S), ("type", _S), ("debit", _L), ("credit", _L), ("amount", _L), ("fee", _L), ("tax", _L), ("currency", _S), ("on_hold", _B), ("settled", _B),
    ("created_at", _L), ("settled_at", _L), ("posted_at", _L), ("credit_type", _S), ("settlement_id", _S), ("payment_id", _S), ("order_id", _S), ("order_receipt", _S),
    ("settlement_utr", _S), ("description", _S), ("dispute_id", _S), ("method", _S), ("card_network", _S), ("card_issuer", _S), ("card_type", _S), ("notes", _S))])
PREFIXES = ("pay_", "order_", "rfnd_", "setl_", "setlod_", "dp_", "disp_")
VOUCHERS = ("Sales", "Receipt", "Payment", "Journal", "Credit Note", "Debit Note", "Contra")
LEDGER_COLUMNS = ("voucher_date", "voucher_type", "voucher_number", "ledger_name", "party_ledger_name", "debit", "credit", "narration", "reference_number", "cost_centre", "gstin", "voucher_guid")
BANK_DATES = ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yy", "dd-MMM-yyyy")
LEDGER_DATES = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyyMMdd")


def parse_date(value: Column, formats: tuple[str, ...]) -> Column:
    """The first format that fits; each is tried only on text of its shape."""
    shape = {f: "^" + f.replace("dd", "[0-9]{2}").replace("yyyy", "[0-9]{4}").replace("yy", "[0-9]{2}").replace("MMM", "[A-Za-z]{3}").replace("MM", "[0-9]{2}") + "$" for f in formats}
    return F.coalesce(*[F.when(value.rlike(shape[f]), F.try_to_timestamp(value, F.lit(f)).cast("date")) for f in formats])


def rejects(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with the reasons of all rules they break; nothing is dropped."""
    marked = rows.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items()])))
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def gateway_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Gateway settlement report, a JSON array: events and rejects (unreadable, unknown id kinds, no amount)."""
    schema = T.StructType([*GATEWAY.fields, T.StructField("_corrupt_record", _S)])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    amount = F.when(F.coalesce("credit", F.lit(0)) > 0, F.col("credit")).when(F.coalesce("debit", F.lit(0)) > 0, F.col("debit")).otherwise(F.abs("amount"))
    direction = F.when(F.coalesce("credit", F.lit(0)) > 0, "credit").when(F.coalesce("debit", F.lit(0)) > 0, "debit").when(F.col("amount") < 0, "debit").otherwise("credit")
    known = F.coalesce(F.regexp_like("entity_id", F.lit("^(?:" + "|".join(PREFIXES) + ")")), F.lit(False))
    good, bad = rejects(rows, {"unreadable row": F.col("_corrupt_record").isNotNull(), "unknown id kind": ~known, "no amount": amount.isNull() | (amount == 0), "no creation time": F.col("created_at").isNull()})
    events = good.select(F.concat(F.lit("g-"), "entity_id").alias("event_id"), F.lit("gateway").alias("source"), F.col("entity_id").alias("source_row_id"), amount.alias("amount_paise"), direction.alias("direction"),
                         F.timestamp_seconds("created_at").cast("date").alias("txn_date"), F.timestamp_seconds("settled_at").alias("settled_at"), F.col("settlement_utr").alias("utr"), "settlement_id", "order_id", "payment_id",
                         F.col("type").alias("txn_type"), "method", F.col("fee").alias("fee_paise"), F.col("tax").alias("tax_paise"), F.coalesce("on_hold", F.lit(False)).alias("on_hold"), F.col("description").alias("narration"))
    return events, bad


def bank_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bank statement with unquoted commas in the narration: two fields in front and four behind are fixed, what is
    between them is narration. Deposits win over withdrawals; rows with neither are rejected."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("txn_date") & (F.trim("value") != ""))
    parts = lines.select("value", F.split("value", ",").alias("p")).withColumn("n", F.size("p"))
    at = lambda k: F.trim(F.get("p", F.col("n") - k))
    rows = parts.select("value", "n", parse_date(F.trim(F.get("p", F.lit(0))), BANK_DATES).alias("txn_date"), parse_date(F.trim(F.get("p", F.lit(1))), BANK_DATES).alias("value_date"),
                        F.trim(F.array_join(F.slice("p", F.lit(3), F.greatest(F.col("n") - 6, F.lit(0))), ",")).alias("narration"), at(4).alias("document"), money.to_paise(at(3)).alias("withdrawal"), money.to_paise(at(2)).alias("deposit"), money.to_paise(at(1)).alias("closing_paise"))
    amount = F.when(F.coalesce("deposit", F.lit(0)) > 0, F.col("deposit")).when(F.coalesce("withdrawal", F.lit(0)) > 0, F.col("withdrawal"))
    good, bad = rejects(rows, {"too few fields": F.col("n") < 7, "no date": F.col("txn_date").isNull(), "no amount": amount.isNull()})
    parsed = text.parse_narration(F.col("narration"))
    events = good.withColumn("x", parsed).select(
        F.sha2(F.concat_ws("|", F.col("txn_date").cast("string"), amount.cast("string"), "narration", F.col("closing_paise").cast("string")), 256).alias("source_row_id"), F.lit("bank").alias("source"), amount.alias("amount_paise"),
        F.when(F.coalesce("deposit", F.lit(0)) > 0, "credit").otherwise("debit").alias("direction"), "txn_date", "value_date", "narration", "closing_paise", F.col("x.rail").alias("rail"),
        F.when(F.col("x.rail").isin("neft", "rtgs") & (F.length("x.reference") == 16), F.col("x.reference")).alias("utr"), F.coalesce(F.when(~F.col("x.rail").isin("neft", "rtgs"), F.col("x.reference")), F.nullif("document", F.lit(""))).alias("rrn"), F.col("x.counterparty").alias("counterparty"))
    return events, bad


def ledger_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accounting day book: net is debit minus credit, zero rows and unknown voucher types are rejected."""
    schema = T.StructType([T.StructField(c, _S) for c in LEDGER_COLUMNS])
    return ledger_rows(spark.read.schema(schema).option("header", True).csv(path))


def ledger_xml(spark: SparkSession, path: str, row_tag: str = "VOUCHER") -> tuple[DataFrame, DataFrame]:
    """The day book as XML, one element for each voucher row; tags by column name in capitals."""
    names = {c.upper().replace("_", ""): c for c in LEDGER_COLUMNS}
    schema = T.StructType([T.StructField(c, _S) for c in names])
    rows = spark.read.schema(schema).option("rowTag", row_tag).format("xml").load(path)
    return ledger_rows(rows.select(*[F.col(k).alias(v) for k, v in names.items()]))


def ledger_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    amount = lambda c: F.coalesce(money.to_paise(F.col(c)), money.to_paise(F.concat(F.col(c), F.lit(".00"))), F.lit(0))
    rows = rows.withColumn("net", amount("debit") - amount("credit")).withColumn("txn_date", parse_date(F.trim("voucher_date"), LEDGER_DATES))
    good, bad = rejects(rows, {"no date": F.col("txn_date").isNull(), "unknown voucher type": ~F.col("voucher_type").isin(*VOUCHERS), "zero row": F.col("net") == 0})
    short = F.length(F.coalesce("reference_number", F.lit(""))) < 6
    reference = F.when(short, text.document_reference(F.col("narration"))).otherwise(F.col("reference_number"))
    events = good.withColumn("ref", reference).select(
        F.coalesce("voucher_guid", F.sha2(F.concat_ws("|", "voucher_date", "voucher_number", "ledger_name", F.col("net").cast("string")), 256)).alias("source_row_id"), F.lit("ledger").alias("source"), F.abs("net").alias("amount_paise"), F.when(F.col("net") > 0, "debit").otherwise("credit").alias("direction"),
        "txn_date", "voucher_type", "voucher_number", F.col("ledger_name").alias("ledger_account"), F.col("party_ledger_name").alias("counterparty"), "narration", F.when(F.length("ref") == 16, F.col("ref")).alias("utr"), F.when(F.length("ref") != 16, F.col("ref")).alias("rrn"))
    return events, bad


def bank_format(spark: SparkSession, path: str) -> DataFrame:
    """What kind of statement each file is, by its first bytes and its name."""
    files = spark.read.format("binaryFile").load(path)
    head = F.substring("content", 1, 5)
    return files.select("path", F.when(head == F.lit(bytearray(b"%PDF-")), "pdf").when(F.lower("path").rlike(r"\.(?:csv|txt)$"), "csv").otherwise("unknown").alias("format"))


def breaks(rows: DataFrame, opening: int, order: str) -> DataFrame:
    """Rows whose balance is not the one before plus deposit minus withdrawal; the stated balance goes on."""
    from pyspark.sql import Window

    before = F.lag("closing_paise", 1, opening).over(Window.partitionBy("account").orderBy(order))
    return rows.withColumn("expected_paise", before + F.col("deposit_paise") - F.col("withdrawal_paise")).filter("expected_paise <> closing_paise")


def save_run(df: DataFrame, path: str) -> None:
    """Results of a run, partitioned by run."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def export_audit(df: DataFrame, path: str, kind: str = "csv") -> None:
    """The audit log in sequence order, as CSV with a header or as JSON lines."""
    rows = df.repartitionByRange("seq").sortWithinPartitions("seq")
    (rows.write.option("header", True).csv(path) if kind == "csv" else rows.write.json(path))


def register_csv(register: DataFrame, path: str, key: str = "settlement_id") -> None:
    """The settlement register as CSV with a header, one line per settlement, in the order of its key by ranges."""
    register.repartitionByRange(key).sortWithinPartitions(key).write.option("header", True).csv(path)
