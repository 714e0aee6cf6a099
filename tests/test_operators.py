"""Matching, rules, queue, readers and streams on small hand-made cases."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from trisettle.operators import evaluate, exceptions, references, rules, settlements
from trisettle.operators.shared import components
from trisettle.sources import readers
from trisettle.streaming import windows


def test_components_follow_shared_keys(spark):
    rows = [("e1", "a"), ("e2", "a"), ("e2", "b"), ("e3", "b"), ("e9", "z"), ("e4", "c"), ("e5", "c"), ("e4", "c")]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "node string, key string")).collect()}
    assert got == {"e1": "e1", "e2": "e1", "e3": "e1", "e9": "e9", "e4": "e4", "e5": "e4"}
    assert components(spark.createDataFrame([], "node string, key string")).count() == 0


def test_prefix_completion(spark):
    fragments = spark.createDataFrame([("UTR0001",), ("UTR0002",), ("UTR9999",), ("UT",)], "fragment string")
    values = spark.createDataFrame([("UTR0001AAA",), ("UTR0002A",), ("UTR0002B",), ("UTR0001",)], "value string")
    got = {r.fragment: (r.n_values, r.completion) for r in references.completions(fragments, values).collect()}
    assert got == {"UTR0001": (1, "UTR0001AAA"), "UTR0002": (2, None), "UTR9999": (0, None)}


def test_blocked_pairs_match_brute_force(spark):
    rows = [(f"e{i}", ("a", "b", "c")[i % 3], (i * 7919) % 900_000, date.fromordinal(728_000 + (i * 31) % 25)) for i in range(80)]
    got = {(r.left_id, r.right_id) for r in references.blocked_pairs(spark.createDataFrame(rows, "event_id string, source string, amount_paise long, txn_date date")).collect()}
    want = {(x[0], y[0]) for x in rows for y in rows if x[1] < y[1] and abs(x[2] // 100_000 - y[2] // 100_000) <= 2 and abs((x[3] - y[3]).days) <= 6}
    assert got == want and want


GATE = "event_id string, settlement_id string, amount_paise long, fee_paise long, tax_raw long, direction string, txn_type string, txn_date date, utr string"
BANK = "event_id string, amount_paise long, direction string, utr string, txn_date date, narration string"


def batch(spark):
    day = date(2024, 1, 5)
    gateway = spark.createDataFrame([("g1", "S1", 98_000, 2_000, 300, "credit", "payment", day, "U" * 16), ("g2", "S1", 49_000, 1_000, 150, "credit", "payment", day, "U" * 16),
                                     ("g3", "S1", 10_000, None, None, "debit", "refund", day, "U" * 16), ("g4", "S2", 137_050, 0, 0, "credit", "payment", day, "V" * 16), ("g5", None, 5, 0, 0, "credit", "payment", day, None)], GATE)
    bank = spark.createDataFrame([("b1", 137_000, "credit", "U" * 16, day, "x Settlement credit S1"), ("b2", 137_020, "credit", None, day, ""), ("b3", 500, "credit", None, day, ""), ("b4", 137_000, "debit", None, day, "")], BANK)
    return gateway, bank


def test_settlement_arithmetic_and_refusal(spark):
    gateway, bank = batch(spark)
    sums = settlements.arithmetic(gateway)
    s1 = sums.filter("settlement_id = 'S1'").first()
    assert (s1.gross_paise, s1.fee_paise, s1.gst_paise, s1.deductions_paise, s1.expected_net_paise, s1.n_txns) == (150_000, 3_000, 450, 10_000, 137_000, 2)
    got = {r.credit_id: r for r in settlements.reconciled(settlements.candidates(bank, sums)).collect()}
    assert got["b1"].settlement_id == "S1" and got["b1"].confidence == 0.97
    assert got["b2"].n_candidates == 2 and got["b2"].settlement_id is None and "b3" not in got and "b4" not in got
    assert [(r.credit_id, r.settlement_id) for r in settlements.grouped(bank, sums).collect()] == [("b1", "S1")]


def test_running_balance_and_breaks(spark):
    rows = spark.createDataFrame([("a", 1, 100, 0, 1100), ("a", 2, 0, 50, 1000), ("a", 3, 5, 0, 1005)], "account string, seq int, deposit_paise long, withdrawal_paise long, closing_paise long")
    assert [(r.seq, r.expected_paise) for r in readers.breaks(rows, 1000, "seq").collect()] == [(2, 1050)]


def case(spark, **k):
    row = {"gross_paise": 100_000, "gap_paise": 2_360, "method": "card", "counterparty": "c", "on_date": date(2024, 1, 1), "n_txns": 1} | k
    return spark.createDataFrame([tuple(row.values())], "gross_paise long, gap_paise long, method string, counterparty string, on_date date, n_txns int")


def test_rules_explain_shrink_and_skip(spark):
    full = rules.apply_rules(case(spark), rules.STARTER).first()
    assert full.fully_explained and full.explained_paise == 2_360 and full.rules_applied == ["fee_card:2"]
    part = rules.apply_rules(case(spark, gap_paise=19_000), rules.STARTER).first()
    assert not part.fully_explained and part.residual_paise == 19_000 - part.explained_paise > 0 and part.rules_applied[0] == "fee_card:2"
    none = rules.apply_rules(case(spark, gap_paise=0), rules.STARTER).first()
    assert none.explained_paise == 0 and none.rules_applied == []
    late = rules.Rule("r", 1, 9, (rules.Deduction("x", "2.36"),), date_from="2025-01-01")
    assert not rules.apply_rules(case(spark), [late]).first().fully_explained


def test_chained_basis_is_rounded_by_line(spark):
    rule = rules.Rule("r", 1, 1, (rules.Deduction("commission", "1.5"), rules.Deduction("gst", "18", "commission"), rules.Deduction("tcs", "1", "net")))
    got = spark.createDataFrame([(333,)], "g long").select(*[v.alias(k) for k, v in rule.lines(F.col("g")).items()]).first()
    assert (got.commission, got.gst, got.tcs) == (5, 1, 3)


def test_rule_file(spark):
    text = json.dumps([{"id": "a", "version": 1, "priority": 1, "deductions": [{"type": "x", "rate": 1.50}, {"type": "y", "rate": 18, "basis": "x"}]}])
    loaded = rules.load_rules(text)
    assert loaded[0].deductions[0].rate == "1.5" and len(rules.version_hash(loaded[0])) == 64
    for bad in ('[{"id": "a", "version": 1, "priority": 1, "deductions": [{"type": "x", "rate": 101}]}]', '[{"id": "a", "version": 1, "priority": 1, "deductions": [{"type": "x", "rate": 1, "basis": "y"}]}]', '[{"id": "a", "version": 1, "priority": 1, "deductions": [], "other": 1}]'):
        with pytest.raises((ValueError, TypeError)):
            rules.load_rules(bad)
    order = rules.candidate_order([rules.Rule("b", 1, 5, ()), rules.Rule("a", 1, 5, ()), rules.Rule("c", 2, 5, (), method="card"), rules.Rule("d", 1, 9, ())])
    assert [r.id for r in order] == ["d", "c", "a", "b"]


def test_backtest_vetoes(spark):
    good = [case(spark).withColumn("category", F.lit("amount_variance"))] * 4
    rows = good[0]
    for g in good[1:]:
        rows = rows.union(g)
    assert rules.backtest(rows, rules.STARTER[0]).first().advice == "activate"
    assert rules.backtest(rows.union(case(spark).withColumn("category", F.lit("chargeback_unrecorded"))), rules.STARTER[0]).first().advice == "discard"
    assert rules.backtest(rows.limit(2), rules.STARTER[0]).first().advice == "adjust"


def test_diff_and_pages(spark):
    schema = "subject string, category string, gap_paise long"
    a = spark.createDataFrame([("x", "c", 1), ("y", "c", 2), ("z", "c", 3)], schema)
    b = spark.createDataFrame([("x", "c", 1), ("y", "c", 1), ("w", "c", 9)], schema)
    assert {r.subject: r.change for r in exceptions.changed(a, b).collect()} == {"x": "unchanged", "y": "changed", "z": "removed", "w": "added"}
    rows = spark.createDataFrame([(i, f"k{i % 4}") for i in (5, 5, 4, 4, 3)], "v int, k string")
    assert len(exceptions.page(rows, "v", "k", 2).collect()) == 3 and [r.v for r in exceptions.page(rows, "v", "k", 5, (4, "k0")).collect()] == [3]


def test_confusion_by_counting(spark):
    rows = [("a", "1"), ("a", "1"), ("a", "2"), ("b", "2"), ("c", "3")]
    got = evaluate.pair_confusion(spark.createDataFrame(rows, "group string, truth string")).first()
    pairs = [(x, y) for i, x in enumerate(rows) for y in rows[:i]]
    want = [sum((x[0] == y[0]) == p and (x[1] == y[1]) == t for x, y in pairs) for p, t in ((True, True), (True, False), (False, True), (False, False))]
    assert list(got) == want
    assert evaluate.gates({"false_auto": 0, "never_auto": 0, "recall": 0.95}) == {"no_false_auto": True, "no_never_auto": True, "recall": True}


def test_bank_text(spark, tmp_path):
    (tmp_path / "bank.csv").write_text("txn_date,value_date,narration,chq_ref_no,withdrawal_amt,deposit_amt,closing_balance\n"
                                       "01/02/2024,02/02/2024,NEFT-SBIN0123456789AB-ACME, CORP, LTD,,,\"x\",1\n01/02/2024,02/02/2024,NEFT-SBIN0123456789AB-ACME, CO, X,D1,,500.00,1500.00\n"
                                       "2024-02-03,,UPI/123456789012/BOB,,25.50,,1474.50\n99/99/2024,,bad,,1.00,,1.00\n01-02-2024,,nothing,,,,5.00\nshort,row\n")
    events, bad = readers.bank_text(spark, str(tmp_path / "bank.csv"))
    got = {r.narration: r for r in events.collect()}
    first = got["NEFT-SBIN0123456789AB-ACME, CO, X"]
    assert (first.amount_paise, first.direction, first.utr, first.rail, first.txn_date) == (50_000, "credit", "SBIN0123456789AB", "neft", date(2024, 2, 1))
    assert got["UPI/123456789012/BOB"].rrn == "123456789012" and got["UPI/123456789012/BOB"].direction == "debit"
    assert events.count() == 2 and bad.count() == 4


def test_gateway_json_and_ledger_files(spark, tmp_path):
    row = {"entity_id": "pay_1", "type": "payment", "debit": 0, "credit": 900, "amount": 1000, "fee": 100, "tax": 15, "created_at": 1704067200, "on_hold": False}
    (tmp_path / "g.json").write_text(json.dumps([row, row | {"entity_id": "zz_1"}, row | {"credit": 0, "amount": 0}]))
    events, bad = readers.gateway_json(spark, str(tmp_path / "g.json"))
    assert [(r.amount_paise, r.direction, r.txn_date) for r in events.collect()] == [(900, "credit", date(2024, 1, 1))] and bad.count() == 2
    head = ",".join(readers.LEDGER_COLUMNS)
    (tmp_path / "l.csv").write_text(head + '\n2024-01-02,Receipt,V1,Main Bank,Acme,"1,000.50",,Settlement credit S1,SBIN0123456789AB,,,guid1\n2024-01-02,Odd,V2,x,y,1.00,,,,,,g2\n2024-01-02,Sales,V3,x,y,1.00,1.00,,,,,g3\n')
    events, bad = readers.ledger_csv(spark, str(tmp_path / "l.csv"))
    assert [(r.amount_paise, r.direction, r.utr, r.source_row_id) for r in events.collect()] == [(100_050, "debit", "SBIN0123456789AB", "guid1")] and bad.count() == 2
    (tmp_path / "l.xml").write_text("<L><VOUCHER><VOUCHERDATE>20240102</VOUCHERDATE><VOUCHERTYPE>Receipt</VOUCHERTYPE><LEDGERNAME>Cash</LEDGERNAME><CREDIT>5.00</CREDIT><NARRATION>bill INV20240001</NARRATION></VOUCHER></L>")
    got = readers.ledger_xml(spark, str(tmp_path / "l.xml"))[0].first()
    assert (got.amount_paise, got.direction, got.rrn) == (500, "credit", "INV20240001")
    (tmp_path / "s.pdf").write_bytes(b"%PDF-1.7")
    assert {r.format for r in readers.bank_format(spark, str(tmp_path)).collect()} == {"pdf", "csv", "unknown"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i % 5, i % 60), i % 3, ("a", "b")[i % 2], float(i)) for i in range(200)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows + rows[:20], schema).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    query = windows.ingest_once(stream, "event_id").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    once = spark.table("once")
    assert once.count() == 200
    batch_rows = windows.tumbling(spark.createDataFrame(rows, schema), "1 hour")
    assert sorted(map(tuple, windows.tumbling(once, "1 hour").collect())) == sorted(map(tuple, batch_rows.collect()))


def test_components_of_long_chains(spark):
    from trisettle.operators.shared import components

    chain = [(f"n{k:05d}", f"k{k + j}") for k in range(1000) for j in (0, 1)]
    got = components(spark.createDataFrame([*chain, ("z", "alone")], "node string, key string")).collect()
    assert {(r.node, r.root) for r in got} == {(f"n{k:05d}", "n00000") for k in range(1000)} | {("z", "z")}


def test_date_shifted_pairs(spark):
    schema = "event_id string, amount_paise long, txn_date string, utr string"
    bank = spark.createDataFrame([("b1", 500_000, "2024-01-03", "REF123"), ("b2", 500_000, "2024-01-09", "REF999"), ("b3", 70_000, "2024-01-03", "XY1234"), ("b4", 90_000, "2024-01-02", "LONGREF77"), ("b5", 1, "2024-01-02", None)], schema)
    books = spark.createDataFrame([("l1", 500_050, "2024-01-01", "REF12345"), ("l2", 500_000, "2024-01-01", "REF99988"), ("l3", 70_000, "2024-01-02", "XY12345"), ("l4", 70_000, "2024-01-02", "XY12346"), ("l5", 90_000, "2024-01-01", "LONGREF"), ("l6", 500_000, "2024-01-02", "REF123")], schema)
    dated = [x.withColumn("txn_date", F.to_date("txn_date")) for x in (bank, books)]
    assert {tuple(r) for r in settlements.date_shifted(*dated).collect()} == {("b1", "l1", 2), ("b4", "l5", 1)}
