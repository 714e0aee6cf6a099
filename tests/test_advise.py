"""A sentence for every category."""

from __future__ import annotations

import datetime

from trisettle.operators import advise

EVENT = "event_id string, source string, amount_paise long, txn_date date, utr string, order_id string, counterparty string"
FOUND = "finding string, event_id string, category string, amount_paise long, residual_paise long, gross_paise long, rules_reason string, expected_on date"
DAY = datetime.date(2024, 3, 5)


def said(spark, category, events, amount=1_234_567, residual=5, gross=None, reason=None, expected=None):
    rows = spark.createDataFrame(events, EVENT)
    found = spark.createDataFrame([("f", e[0], category, amount, residual, gross, reason, expected) for e in events] or [("f", "gone", category, amount, residual, gross, reason, expected)], FOUND)
    return advise.facts(found, rows).select(advise.advice().alias("a")).first().a


def row(i, source="bank", amount=5, utr=None, order=None, party=None, day=DAY):
    return i, source, amount, day, utr, order, party


def test_every_branch(spark):
    assert said(spark, "duplicate_ledger_entry", [row("v2", "ledger"), row("v1", "ledger"), row("b")]) == "Reverse v2 of 2024-03-05: it books ₹12,345.67 a second time after v1."
    assert said(spark, "duplicate_ledger_entry", [row(f"v{k}", "ledger") for k in range(3)]) == "Find out which of 3 rows books ₹12,345.67; the others are to be reversed."
    assert said(spark, "chargeback_unrecorded", [row("d", "gateway", order="O1")]) == "Book the chargeback of ₹12,345.67 for O1 (d) and contest it by 2024-04-04."
    assert said(spark, "missing_in_bank", [row("g", "gateway", utr="U1")]) == "₹12,345.67 of 2024-03-05 (reference U1) is not in the bank; ask the gateway if it is not there by 2024-03-07."
    assert said(spark, "missing_in_gateway", [row("b")]) == "Find the settlement behind the credit of ₹12,345.67 on 2024-03-05, or book it as paid directly by an unknown party."
    assert said(spark, "missing_in_ledger", [row("a", amount=3), row("z", amount=-9, day=datetime.date(2024, 3, 9))]) == "Book a receipt of ₹12,345.67 on 2024-03-09: gateway and bank agree on it."
    assert said(spark, "partial_refund", [row("r", "gateway")]) == "Check the refund of ₹12,345.67 for its order; what remains of the sale stays revenue."
    assert said(spark, "nach_batch_unexploded", [row("n")]) == "Book the mandate batch of ₹12,345.67 on 2024-03-05 as one sum; the statement does not name its mandates."
    assert said(spark, "timing_lag", [row("t")], expected=DAY) == "Nothing to do: ₹12,345.67 should arrive by 2024-03-05 and is looked up again."
    assert said(spark, "timing_lag", [row("t")]).startswith("Nothing to do: ₹12,345.67 should arrive soon")
    assert said(spark, "ambiguous_multi_candidate", [row("a", order="O1"), row("b", order="O2")], residual=0).startswith("The cash is settled; say whether O1 or O2")
    assert said(spark, "ambiguous_multi_candidate", [row("a", order="O1"), row("b", order="O2")]) == "Say which candidate ₹12,345.67 of 2024-03-05 belongs to before either side closes."
    assert said(spark, "reference_truncated", [row("c")]) == "Compare ₹12,345.67 of 2024-03-05 by hand; the bank cut its reference."
    assert said(spark, "amount_variance", [row("v")], gross=100_000) == "Check the difference of ₹12,345.67 against ₹1,000.00 gross; no rule explains all of it."
    assert said(spark, "amount_variance", [row("v")], reason="Rule x takes it") == "Rule x takes it"
    assert said(spark, "unknown", []) == "Look at ₹12,345.67 of an unknown day by hand; it fits no category."
