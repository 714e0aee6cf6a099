"""The cash bridge adds up for any rows."""

from __future__ import annotations

import datetime
import random

import pytest

from trisettle.operators import bridge

EVENT = "event_id string, source string, direction string, txn_type string, amount_paise long, fee_paise long, tax_raw long, on_hold boolean, txn_date date"
DAY = datetime.date(2024, 1, 1)


def lines(spark, events, members, findings):
    got = bridge.bridge(spark.createDataFrame(events, EVENT), spark.createDataFrame(members, "match_id string, event_id string"), spark.createDataFrame(findings, "finding string, category string, amount_paise long")).collect()
    assert len({r.line for r in got}) == len(got)
    return {r.line: r.amount_paise for r in got}


def gateway(i, kind, amount, direction="credit", fee=None, tax=None, held=False):
    return f"g{i}", "gateway", direction, kind, amount, fee, tax, held, DAY


def test_segments_and_shares(spark):
    events = [gateway(1, "payment", 9_764, fee=236, tax=36 * 118), gateway(2, "payment", 5_000), gateway(3, "refund", 1_000, "debit"), gateway(4, "dispute", 500, "debit"), gateway(5, "dispute", 200), gateway(6, "reserve", 300, "debit"), gateway(7, "payment", 800, held=True),
              gateway(8, "fee note", 50, "debit"), gateway(9, None, 20), ("b1", "bank", "credit", None, 9_764, None, None, False, DAY), ("b2", "bank", "credit", None, 77, None, None, False, DAY)]
    members = [("m", "g1"), ("m", "b1"), ("x", "b2")]
    got = lines(spark, events, members, [("f1", "missing_in_bank", 2_000), ("f2", "timing_lag", 1_000), ("f3", "unidentified_inflow", 9_999), ("f4", "amount_variance", 9_999)])
    assert got["gross"] == 15_000 and got["mdr"] == 200 and got["gst"] == 36 and got["refunds"] == 1_000 and got["chargebacks"] == 300 and got["reserve"] == 300 and got["held"] == 800 and got["other_charges"] == 50 and got["other_credits"] == 20
    assert got["expected"] == 13_134 and got["bank"] == 9_764 and got["rest"] == 3_370
    assert got["explained by timing_lag"] == 1_000 and got["explained by missing_in_bank"] == 2_000 and got["explained by amount_variance"] == 370 and got["unexplained"] == 0


@pytest.mark.parametrize("seed", range(6))
def test_it_adds_up_for_any_rows(spark, seed):
    rnd = random.Random(seed)
    kinds = ["payment", "refund", "dispute", "reserve", "adjustment", None]
    events = [gateway(i, rnd.choice(kinds), rnd.randint(0, 9_999), rnd.choice(["credit", "debit"]), rnd.choice([None, rnd.randint(0, 300)]), rnd.choice([None, 118 * rnd.randint(0, 50)]), rnd.random() < 0.2) for i in range(rnd.choice([0, 1, 60]))]
    events += [(f"b{i}", "bank", rnd.choice(["credit", "debit"]), None, rnd.randint(1, 9_999), None, None, False, DAY) for i in range(20)]
    members = [(f"m{rnd.randint(0, 9)}", e[0]) for e in events if rnd.random() < 0.5]
    findings = [(f"f{i}", rnd.choice([*bridge.EXPLAINS, "unknown"]), rnd.randint(0, 5_000)) for i in range(rnd.choice([0, 3, 30]))]
    got = lines(spark, events, members, findings)
    assert got["expected"] == sum(sign * got.get(name, 0) for name, sign in bridge.SEGMENTS.items()) and got["rest"] == got["expected"] - got.get("bank", 0)
    shares = {k: v for k, v in got.items() if k.startswith("explained by ")}
    assert sum(shares.values()) + got["unexplained"] == got["rest"] and all(v >= 0 for v in shares.values())
    worth = {}
    for _, category, amount in findings:
        worth[f"explained by {category}"] = worth.get(f"explained by {category}", 0) + amount
    assert all(v <= worth[k] for k, v in shares.items())
    # every gateway row is in the bridge: what it says moved is what it adds or takes
    signed = sum((e[4] if e[2] == "credit" else -e[4]) for e in events if e[1] == "gateway" and not (e[7] and e[3] == "payment" and e[2] == "credit"))
    assert got["expected"] == signed


def test_members_that_have_their_events_columns_are_not_joined(spark):
    rows = spark.createDataFrame([("b1", "bank", "credit", 700), ("b2", "bank", "debit", 200), ("g1", "gateway", "credit", 700), ("b3", "bank", "credit", 9)], "event_id string, source string, direction string, amount_paise long")
    members = spark.createDataFrame([("m", "b1"), ("m", "b2"), ("m", "g1"), ("m", "b1"), ("n", "b3")], "match_id string, event_id string")
    joined = bridge.credited(rows, members)
    plain = bridge.credited(rows.limit(0), members.join(rows, "event_id"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, joined.collect())) != []
