"""The corpus with its truth, ledger legs, refusals and the measures on them, against plain Python."""

from __future__ import annotations

import datetime
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from trisettle.functions.scoring import NEVER_AUTO
from trisettle.operators import cascade, classify, evaluate, legs, settlements
from trisettle.plans import accuracy
from trisettle.sources import corpus

DIR = "/root/testdata/sf0.001"
DAY = datetime.date
EVENT = "event_id string, source string, amount_paise long, direction string, txn_date date, utr string, settlement_id string, order_id string, txn_type string, counterparty string, method string, rail string, narration string, fee_paise long, tax_raw long, on_hold boolean, ledger_account string, voucher_type string"


def event(event_id, source, amount, day=1, **more):
    row = dict.fromkeys([c.split()[0] for c in EVENT.split(", ")]) | {"event_id": event_id, "source": source, "amount_paise": amount, "txn_date": DAY(2024, 1, day), "on_hold": False}
    row |= {"gateway": {"direction": "credit", "txn_type": "payment", "fee_paise": 0, "tax_raw": 0}, "bank": {"direction": "credit"}, "ledger": {"direction": "debit", "ledger_account": "Main Bank", "voucher_type": "Receipt"}}[source]
    return tuple((row | more).values())


@pytest.fixture(scope="module")
def world(spark):
    rows, truth = corpus.rows(spark, DIR), corpus.truth(spark, DIR)
    return rows, truth, cascade.run(rows)


def test_every_fault_is_planted_and_every_row_has_one_truth(spark, world):
    rows, truth, _ = world
    assert {r.scenario for r in truth.select("scenario").distinct().collect()} == set(range(len(corpus.FAULTS)))
    assert rows.count() == truth.count() == rows.select("event_id").distinct().count() == rows.join(truth, "event_id").count()
    assert not {"k", "scenario", "truth_group", "batch"} & set(rows.columns)


def test_no_row_is_in_two_matches_or_matched_and_left(world):
    rows, _, done = world
    ids = [r.event_id for r in done.members.collect()]
    left = {r.event_id for r in done.left.collect()}
    assert len(ids) == len(set(ids)) and not left & set(ids) and len(left) + len(ids) == rows.count()


def test_measures_against_counting_in_python(spark, world):
    rows, truth, done = world
    members, true = done.members.collect(), {r.event_id: r for r in truth.collect()}
    of = defaultdict(list)
    for m in members:
        of[m.match_id].append(m)
    stages = defaultdict(Counter)
    for group in of.values():
        stage = min(m.stage for m in group)
        pairs = list(combinations([true[m.event_id].truth_group for m in group], 2))
        stages[stage].update(matches=1, pairs=len(pairs), right_pairs=sum(a is not None and a == b for a, b in pairs))
    got = {r.stage: (r.matches, r.pairs, r.right_pairs) for r in evaluate.stage_accuracy(done.members, truth).collect()}
    assert got == {s: (c["matches"], c["pairs"], c["right_pairs"]) for s, c in stages.items()}
    assert any(c["right_pairs"] < c["pairs"] for c in stages.values())  # the planted misquotes
    stopped = {r.event_id for r in done.refusals.collect() if r.category in NEVER_AUTO}
    closes = {k for k, g in of.items() if min(m.confidence for m in g) >= 0.94 and all(m.stage in cascade.CLOSING for m in g) and not stopped & {m.event_id for m in g}}
    closed = cascade.closable(done.members, refused=done.refusals)
    assert {r.match_id for r in closed.collect()} == closes and len(closes) < cascade.closable(done.members).count()
    total = evaluate.closed_accuracy(done.members, closed, truth).first()
    groups = {k: {true[m.event_id].truth_group for m in of[k]} for k in closes}
    assert total.closed == len(closes) and total.mixed == sum(len(g) > 1 or None in g for g in groups.values()) > 0
    assert total.open == sum(any(true[m.event_id].bucket == "exception" for m in of[k]) for k in closes)


def test_misquotes_alone_close_wrongly(world):
    _, truth, done = world
    closed = done.members.join(cascade.closable(done.members, refused=done.refusals).select("match_id"), "match_id").join(truth, "event_id")
    mixed = closed.groupBy("match_id").agg(F.count_distinct("truth_group").alias("k"), F.array_contains(F.collect_set("scenario"), 22).alias("misquoted")).filter("k > 1")
    assert mixed.count() > 0 and mixed.filter("not misquoted").count() == 0


def test_twin_settlements_are_refused_not_guessed(world):
    rows, truth, done = world
    twins = rows.filter("source = 'bank'").join(truth.filter("scenario = 16"), "event_id")
    assert twins.count() > 0 and twins.join(done.members, "event_id").count() == 0
    refused = done.refusals.filter("category = 'ambiguous_multi_candidate'").select("event_id").distinct()
    assert twins.join(refused, "event_id").count() == twins.count()


def test_category_accuracy_counts(spark):
    found = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "z")], "event_id string, category string")
    truth = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("d", "w")], "event_id string, label string")
    assert sorted(map(tuple, evaluate.category_accuracy(found, truth).collect())) == [("w", 0, 1, 0), ("x", 2, 1, 1), ("y", 1, 1, 1), ("z", 1, 0, 0)]


def resolved(spark, members, events):
    rows = spark.createDataFrame(events, EVENT)
    groups = spark.createDataFrame(members, "match_id string, event_id string")
    free = rows.filter("source = 'ledger'").join(groups, "event_id", "left_anti")
    attached, refused = legs.resolve(groups, rows, free)
    return sorted((r.match_id, r.event_id, r.proof) for r in attached.collect()), sorted({(r.subject, r.category) for r in refused.collect()}), refused


def test_legs_of_groups(spark):
    both = lambda m, day=5, amount=10_000: ([(m, f"{m}g"), (m, f"{m}b")], [event(f"{m}g", "gateway", amount, day, settlement_id=f"S{m}1", order_id=f"O{m}-1"), event(f"{m}b", "bank", amount, day)])
    members, events = [], []
    for k, m in enumerate("abcdefgh"):
        own, rows = both(m, amount=10_000 * (k + 1))
        members, events = members + own, events + rows
    events += [event("a1", "ledger", 999, narration="Settlement credit Sa1"), event("b1", "ledger", 20_000, 6, narration="Gateway receipt"), event("c1", "ledger", 30_000, 5, narration="x"), event("c2", "ledger", 30_050, 4, narration="y"),
               event("d1", "ledger", 40_000, 7, narration="late by two days"), event("e1", "ledger", 50_000, 5, narration="Settlement credit S99"), event("f1", "ledger", 60_000, 5, narration="settlement Sf1 for settlement S77"),
               event("g1", "ledger", 70_000, 5, narration="booked"), event("g2", "ledger", 70_000, 5, narration=" BOOKED "), event("h1", "ledger", 80_500, 5, narration="wrong")]
    members += [("g", "g1"), ("g", "g2"), ("h", "h1")]
    attached, refused, rows = resolved(spark, members, events)
    assert attached == [("a", "a1", "exact_ref"), ("b", "b1", "fuzzy")]
    assert refused == [("c", "duplicate_ledger_entry"), ("d", "missing_in_ledger"), ("e", "missing_in_ledger"), ("f", "missing_in_ledger"), ("g", "duplicate_ledger_entry"), ("h", "amount_variance")]
    assert {r.event_id for r in rows.filter("subject = 'c'").collect()} == {"cg", "cb", "c1", "c2"}
    assert {r.event_id for r in rows.filter("subject = 'g'").collect()} == {"g1", "g2"} and rows.filter("subject = 'h'").first().amount_paise == 500


def test_a_leg_that_two_groups_want_goes_to_neither(spark):
    events = [event("xb", "bank", 5_000), event("xg", "gateway", 5_000, settlement_id="S1"), event("yb", "bank", 5_000), event("yg", "gateway", 5_000, settlement_id="S2"), event("l", "ledger", 5_000, narration="receipt")]
    attached, refused, rows = resolved(spark, [("x", "xb"), ("x", "xg"), ("y", "yb"), ("y", "yg")], events)
    assert attached == [] and refused == [("x", "ambiguous_multi_candidate"), ("y", "ambiguous_multi_candidate")]
    assert {r.event_id for r in legs.never_auto(rows).collect()} == {"xb", "xg", "yb", "yg", "l"}


def test_a_credit_joins_the_match_of_its_settlement(spark):
    """Gateway and ledger meet by reference, the credit only by its amount: one match, not two. A second credit of the
    same amount finds the settlement paid."""
    utr = "UTR0000000000001"
    events = [event("g1", "gateway", 70_000, utr=utr, settlement_id="S1"), event("l1", "ledger", 70_000, utr=utr, narration="Settlement credit S1"), event("b1", "bank", 70_000, narration="CREDIT")]
    done = cascade.run(spark.createDataFrame(events, EVENT))
    assert len({r.match_id for r in done.members.collect()}) == 1 and {r.event_id for r in done.members.collect()} == {"g1", "l1", "b1"}
    paid = events[:2] + [event("b1", "bank", 70_000, utr=utr), event("b2", "bank", 70_000, narration="CREDIT")]
    done = cascade.run(spark.createDataFrame(paid, EVENT))
    assert {r.event_id for r in done.left.collect()} == {"b2"}
    two = events + [event("b2", "bank", 70_000, narration="CREDIT")]
    done = cascade.run(spark.createDataFrame(two, EVENT))
    assert {r.event_id for r in done.left.collect()} == {"b1", "b2"} and {r.event_id for r in done.refusals.filter("stage = 'fee_adjusted'").collect()} == {"b1", "b2"}


def test_empty_events(spark):
    done = cascade.run(spark.createDataFrame([], EVENT))
    assert done.members.count() == done.left.count() == done.refusals.count() == 0


@pytest.mark.parametrize("days", [0, 3])
def test_nearest_beyond_against_every_pair(spark, days):
    rnd = random.Random(days)
    side = lambda n, s: [(f"{s}{k}", rnd.choice([5, 5, 5, 7, None, 9]), None if k % 17 == 3 else DAY(2024, 1, 1) + datetime.timedelta(rnd.randint(0, 40))) for k in range(n)]
    left, right = side(80, "a"), side(120, "b")
    schema = "event_id string, amount_paise long, txn_date date"
    got = sorted(map(tuple, settlements.nearest_opposite(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), days).collect()))
    want = []
    for i, amount, at in left:
        far = [(abs((d - at).days), j) for j, other, d in right if amount is not None and at and d and other == amount and abs((d - at).days) > days]
        if far:
            want.append((i, min(far)[1], min(far)[0]))
    assert got == sorted(want) and len(got) > 20


def test_unmatched_rows_in_order_of_the_questions(spark):
    events = [event("n", "bank", 5, narration="NACH-1"), event("r", "gateway", 6, txn_type="refund"), event("t", "bank", 7, day=1), event("s", "gateway", 7, day=9), event("c", "bank", 8, utr="UTR1"), event("m", "gateway", 9),
              event("w", "bank", 10, counterparty="Gateway Payments"), event("u", "bank", 11, counterparty="Ann"), event("p", "bank", 12, direction="debit"), event("l", "ledger", 7)]
    rows = spark.createDataFrame(events, EVENT)
    got = {r.event_id: (r.category, r.other_id) for r in classify.unmatched(rows, rows).collect()}
    assert got == {"n": ("nach_batch_unexploded", None), "r": ("partial_refund", None), "t": ("timing_lag", "s"), "s": ("timing_lag", "t"), "c": ("reference_truncated", None), "m": ("missing_in_bank", None),
                   "w": ("missing_in_gateway", None), "u": ("unidentified_inflow", None), "p": ("unbooked_bank_entry", None), "l": ("missing_in_bank", None)}


def test_accuracy_table_holds_every_measure(spark, world):
    rows, truth, _ = world
    got = {(r.measure, r.name): r.value for r in accuracy.measured(rows, truth).collect()}
    assert got["pairs", "false_positive"] > 0 and got["pairs", "true_positive"] > 20 * got["pairs", "false_positive"]
    assert got["category chargeback_unrecorded", "right"] == got["category chargeback_unrecorded", "true"] > 0
