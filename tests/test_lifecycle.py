"""Rule lifecycle, classifier steps, replay, clean-up, the register and matching of streams on small fixtures."""

from __future__ import annotations

import datetime

from trisettle.functions.text import sanitised
from trisettle.operators import classify, lifecycle, rules
from trisettle.sources import readers
from trisettle.streaming import windows

DAY = datetime.date
VERSION = "rule_set int, rule_id string, version int, status string, date_from date, date_to date, hash string"


def book(spark):
    return spark.createDataFrame([(1, "a", 1, "retired", DAY(2024, 1, 1), DAY(2024, 6, 1), "h1"), (1, "a", 2, "active", DAY(2024, 6, 1), None, "h2"),
                                  (2, "b", 1, "draft", DAY(2024, 1, 1), None, "h3"), (2, "c", 1, "active", DAY(2024, 1, 1), None, "h4")], VERSION)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_follow_and_start_after_the_live_one(spark):
    assert rows(lifecycle.successors(book(spark), "2024-06-01").select("rule_id", "next_version", "accepted")) == [("a", 3, False), ("b", 2, True), ("c", 2, True)]


def test_import_retires_only_its_own_set(spark):
    new = spark.createDataFrame([(1, "a", "n1"), (1, "z", "n2")], "rule_set int, rule_id string, hash string")
    got = rows(lifecycle.imported(book(spark), new, "2024-09-01").select("rule_id", "version", "status", "date_to"))
    assert got == sorted([("a", 1, "retired", DAY(2024, 6, 1)), ("a", 2, "retired", DAY(2024, 9, 1)), ("a", 3, "active", None), ("b", 1, "draft", None), ("c", 1, "active", None), ("z", 1, "active", None)], key=repr)


def test_only_drafts_go_and_active_versions_never_change(spark):
    every = book(spark)
    assert rows(lifecycle.withdrawn(every, every.version > 0).select("rule_id", "version", "outcome")) == [("a", 1, "refused"), ("a", 2, "retired"), ("b", 1, "deleted"), ("c", 1, "retired")]
    after = every.filter("rule_id <> 'c' and version = 1 or rule_id = 'b'").replace("h3", "other", ["hash"])
    assert rows(lifecycle.altered(every, after).select("rule_id", "version", "fault")) == [("a", 2, "missing"), ("c", 1, "missing")]
    assert rows(lifecycle.altered(every, every.replace("h4", "other", ["hash"])).select("rule_id", "fault")) == [("c", "changed")]
    assert lifecycle.resolved(every, none=True).count() == 0 and lifecycle.resolved(every, 2).count() == 1


def test_disputes_without_a_book_entry(spark):
    gateway = spark.createDataFrame([("d1", "O1-1", 5, "dispute", "debit"), ("d2", "O1-2", 6, "dispute", "debit"), ("d3", None, 7, "dispute", "debit"), ("p", "O2-1", 8, "payment", "credit")],
                                    "event_id string, order_id string, amount_paise long, txn_type string, direction string")
    ledger = spark.createDataFrame([("Disputes O1-1, O9-9",), ("sales O1-2",), (None,)], "narration string")
    assert rows(classify.unrecorded_chargebacks(gateway, ledger).select("event_id")) == [("d2",), ("d3",)]


def test_rows_alike_without_an_order(spark):
    members = spark.createDataFrame([("m", "a", None, 10), ("m", "b", None, 10), ("m", "c", "O1-1", 10), ("m", "d", None, 11), ("n", "e", None, 10), ("n", "f", None, None), ("n", "g", None, None)],
                                    "match_id string, event_id string, order_id string, gross_paise long")
    assert rows(classify.ambiguous_attribution(members)) == [("m", "a", 10, 2), ("m", "b", 10, 2)]


def test_only_quiet_matches_are_left_out(spark):
    groups = spark.createDataFrame([("quiet", False, 0, -3, 1), ("gateway", True, 0, 0, 1), ("rest", False, 1, 0, 1), ("late", False, 0, 4, 1), ("two", False, 0, 0, 2), ("unknown", None, 0, 0, 1)],
                                   "name string, has_gateway boolean, residual_paise long, shift_days int, n_candidates int")
    assert rows(classify.worth_reporting(groups).select("name")) == [("gateway",), ("late",), ("rest",), ("two",), ("unknown",)]


def test_replay_and_ceiling(spark):
    cases = spark.createDataFrame([("x", "card", None, DAY(2024, 1, 1), 100_000, 2_360, 1, "0.99"), ("y", "wallet", None, DAY(2024, 1, 1), 100_000, 1_000, 1, "0.90"), ("z", "wallet", None, DAY(2024, 1, 1), 100_000, 1, 1, "0.99")],
                                  "event_id string, method string, counterparty string, on_date date, gross_paise long, gap_paise long, n_txns int, confidence string")
    got = {r[0]: tuple(r)[1:] for r in rules.replayed(cases, rules.STARTER, rules.STARTER[3:], "event_id").collect()}
    assert got == {"x": ("fee_card:2", "tds:1", "reopened", 1_360)}
    done = rules.with_ceiling(rules.apply_rules(cases, rules.STARTER), rules.STARTER)
    assert {r.event_id: str(r.confidence) for r in done.collect()} == {"x": "0.9500", "y": "0.9000", "z": "0.9900"}


def test_clean_text(spark):
    texts = ["ﬁne​\x07 Ａ", "", None, "a" * 600, "a\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(sanitised("t")).collect()] == ["fine A", "", None, "a" * 500, "ab"]


def test_register_goes_out_and_comes_back(spark, tmp_path):
    df = spark.createDataFrame([("S2", 5, None), ("S1", 7, "a, \"b\"")], "settlement_id string, net_paise long, state string")
    readers.register_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", "\\").schema(df.schema).csv(str(tmp_path / "out"))
    assert rows(back) == rows(df)


def test_stream_matches_as_batch_does(spark, tmp_path):
    at = lambda d: datetime.datetime(2024, 1, d)
    schema = "event_id string, utr string, ts timestamp"
    sides = {"a": [("c1", "U1", at(5)), ("c2", "U2", at(5)), ("c3", None, at(5))], "b": [("l1", "U1", at(8)), ("l2", "U2", at(9)), ("l3", None, at(5)), ("l4", "U1", at(2))]}
    for name, data in sides.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name))
    batch = windows.matched_within(*(spark.read.schema(schema).parquet(str(tmp_path / n)) for n in sides))
    assert rows(batch) == [("U1", "c1", "l1", 3), ("U1", "c1", "l4", -3)]
    stream = windows.matched_within(*(spark.readStream.schema(schema).parquet(str(tmp_path / n)) for n in sides))
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)
