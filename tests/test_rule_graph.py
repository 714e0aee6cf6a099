"""Rule files whose lines must chain, and scopes of all clauses."""

from __future__ import annotations

import datetime
import json
from decimal import Decimal

import pytest

from trisettle.operators import rules

CASE = "method string, counterparty string, gross_paise long, on_date date, source string, rail string, narration string"


def book(*lines, **rule):
    return json.dumps([{"id": "r", "version": 1, "priority": 1, "deductions": list(lines)} | rule])


@pytest.mark.parametrize("lines, reason", [
    ([{"type": "a", "rate": "1", "basis": "a"}], "itself"), ([{"type": "a", "rate": "1", "basis": "b"}, {"type": "b", "rate": "1", "basis": "a"}], "itself"),
    ([{"type": "a", "rate": "1", "basis": "b"}, {"type": "b", "rate": "1", "basis": "c"}, {"type": "c", "rate": "1", "basis": "a"}], "itself"), ([{"type": "a", "rate": "1", "basis": "b"}, {"type": "b", "rate": "1"}], "later"),
    ([{"type": "a", "rate": "1", "basis": "zz"}], "no line"), ([{"type": "a", "rate": "1"}, {"type": "a", "rate": "2"}], "twice"), ([{"type": "net", "rate": "1"}], "twice"), ([{"type": "a", "rate": "-1"}], "negative"),
    ([{"type": "a", "fixed_paise": -1}], "negative"), ([{"type": "a", "rate": "60"}, {"type": "b", "rate": "41", "basis": "net"}], "gross"), ([{"type": "a", "rat": "1"}], "unknown keys"),
])
def test_books_that_do_not_chain_are_refused(lines, reason):
    with pytest.raises(ValueError, match=reason):
        rules.load_rules(book(*lines))


def test_rate_card_names_become_the_rulebooks(spark):
    lines = [{"type": "commission", "rate": "10"}, {"type": "Tax", "rate": "18", "basis": "commission"}, {"type": "rolling_reserve", "rate": "5", "basis": "net"}]
    rule = rules.load_rules(book(*lines), rules.ALIASES)[0]
    assert [(d.type, d.basis) for d in rule.deductions] == [("commission", "gross"), ("gst_on_fee", "commission"), ("reserve", "net")]
    row = spark.range(1).selectExpr("100000L AS g").select(*[c.alias(k) for k, c in rule.lines(rules.F.col("g")).items()]).first()
    assert row.asDict() == {"commission": 10_000, "gst_on_fee": 1_800, "reserve": 4_410}
    with pytest.raises(ValueError, match="twice"):
        rules.load_rules(book({"type": "tax", "rate": "1"}, {"type": "gst", "rate": "1"}), rules.ALIASES)
    assert [d.type for d in rules.load_rules(book({"type": "tax", "rate": "1"}, {"type": "gst", "rate": "1"}))[0].deductions] == ["tax", "gst"]


def test_rates_stay_exact_and_lists_become_clauses():
    rule = rules.load_rules(book({"type": "a", "rate": Decimal("0.1").__float__()}, counterparties=["A", "B"], narrations=["x"], rail="neft"))[0]
    assert rule.deductions[0].rate == "0.1" and rule.specificity == 3 and rule.counterparties == ("A", "B")
    assert rules.version_hash(rule) != rules.version_hash(rules.load_rules(book({"type": "a", "rate": "0.1"}, counterparties=["A"], narrations=["x"], rail="neft"))[0])


def test_each_clause_by_itself_and_what_is_missing(spark):
    day = datetime.date(2024, 5, 5)
    full = ("upi", "Acme Pvt Ltd", 500, day, "bank", "neft", "paid for Widgets")
    rows = spark.createDataFrame([full, (None,) * 7], CASE)
    one = lambda **k: rules.Rule("r", 1, 1, (rules.Deduction("a", "1"),), **k)
    hit = lambda rule: [r.n_rules for r in rules.first_rule(rows, [rule]).collect()]
    for good in ({"method": "upi"}, {"counterparties": ("x", "ACME PVT LTD")}, {"amount_min": 500}, {"amount_max": 500}, {"date_from": "2024-05-05"}, {"date_to": "2024-05-05"}, {"source": "bank"}, {"rail": "neft"}, {"narrations": ("nothing", "WIDGET")}, {"effective_from": "2024-05-05", "effective_to": "2024-05-05"}):
        assert hit(one(**good)) == [1, 0], good
    for bad in ({"method": "card"}, {"counterparties": ("x",)}, {"amount_min": 501}, {"amount_max": 499}, {"date_from": "2024-05-06"}, {"date_to": "2024-05-04"}, {"source": "ledger"}, {"rail": "rtgs"}, {"narrations": ("gadget",)}, {"effective_from": "2024-05-06"}, {"effective_to": "2024-05-04"}):
        assert hit(one(**bad)) == [0, 0], bad
    assert hit(one()) == [1, 1]


def test_old_rates_hold_when_an_old_month_is_closed_again(spark):
    rows = spark.createDataFrame([("upi", "A", 500, datetime.date(2024, 6, 10), "bank", None, None)], CASE)
    old, new = (rules.Rule("rate", v, 1, (rules.Deduction("a", "1"),), effective_from=a, effective_to=b) for v, a, b in ((1, "2024-01-01", "2024-06-30"), (2, "2024-07-01", None)))
    day = lambda text: rules.F.lit(text).cast("date")
    assert [rules.first_rule(rows, [old, new], day(d)).first().rule for d in ("2024-06-30", "2024-07-01")] == ["rate:1", "rate:2"]


def test_priority_then_clauses_then_version_then_id(spark):
    rows = spark.createDataFrame([("upi", "A", 500, datetime.date(2024, 6, 10), "bank", "neft", "n")], CASE)
    make = lambda id, version=1, priority=5, **k: rules.Rule(id, version, priority, (rules.Deduction("a", "1"),), **k)
    first = lambda *book: rules.first_rule(rows, book).first().rule
    assert first(make("a", priority=6), make("b", method="upi", rail="neft")) == "a:1"
    assert first(make("a", method="upi"), make("b", method="upi", rail="neft")) == "b:1"
    assert first(make("a", 1, method="upi"), make("b", 2, rail="neft")) == "b:2"
    assert first(make("b", method="upi"), make("a", rail="neft")) == "a:1" and first(make("a", source="ledger")) is None
