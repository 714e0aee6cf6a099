"""The learner over resolutions, and pages by cursor."""

from __future__ import annotations

import datetime
import decimal
import random

import pytest

from trisettle.operators import learner, paging

DAY = datetime.date
CASE = "exception_id string, category string, resolution_category string, counterparty string, rail string, source string, amount_paise long, gap_paise long, gross_paise long, on_date date"
LIVE = "counterparty string, rail string, date_from date, date_to date"


def case(i, gap=1_800, gross=100_000, party="acme", category="amount_variance", said="commission", rail="neft", day=1):
    return f"e{i}", category, said, party, rail, "bank", gross - gap, gap, gross, DAY(2024, 1, day)


def learnt(spark, cases, live=()):
    return sorted((r.occurrences, float(r.rate_percent), r.tolerance_paise, r.counterparty, r.rail, r.status) for r in learner.drafts(spark.createDataFrame(cases, CASE), spark.createDataFrame(list(live), LIVE)).collect())


def test_three_alike_give_a_draft_and_two_none(spark):
    assert learnt(spark, [case(1), case(2, 1_810), case(3, 1_850)]) == [(3, 1.81, 40, "acme", "neft", "draft")]
    assert learnt(spark, [case(1), case(2)]) == []
    assert learnt(spark, [case(1), case(2), case(3, said="fee")]) == []
    assert learnt(spark, [case(1), case(2), case(3, party="other")]) == []
    assert learnt(spark, [case(1), case(2), case(3, gap=2_600)]) == []


def test_lower_median_and_widest_miss(spark):
    assert learnt(spark, [case(k, g) for k, g in enumerate((1_510, 1_520, 1_880, 1_990))]) == [(4, 1.52, 470, "acme", "neft", "draft")]
    assert learnt(spark, [case(k, 150_000, 10_000_000, rail="by hand") for k in range(3)]) == [(3, 1.5, 0, "acme", None, "draft")]


def test_what_teaches_nothing(spark):
    assert learnt(spark, [case(k, category="unknown") for k in range(5)]) == []
    assert learnt(spark, [case(k, gap=0) for k in range(5)]) == learnt(spark, []) == []


def test_live_rules_must_cover_every_case(spark):
    cases = [case(1, day=1), case(2, day=10), case(3, day=20)]
    assert learnt(spark, cases, [("acme", None, None, None)]) == []
    assert learnt(spark, cases, [(None, "neft", DAY(2024, 1, 1), DAY(2024, 1, 20))]) == []
    assert len(learnt(spark, cases, [("acme", "neft", DAY(2024, 1, 5), None)])) == 1
    assert learnt(spark, cases, [("acme", "neft", DAY(2024, 1, 5), None), (None, None, None, DAY(2024, 1, 4))]) == []
    assert len(learnt(spark, cases, [("other", None, None, None), (None, "upi", None, None)])) == 1


def test_walking_all_pages_gives_every_row_once(spark):
    rnd = random.Random(1)
    rows = [(f"id{k:03d}", rnd.choice([1, 1, 2, 3, None]), rnd.choice([DAY(2024, 1, 1), DAY(2024, 1, 2), None]), decimal.Decimal(rnd.randint(0, 2))) for k in range(97)]
    df = spark.createDataFrame(rows, "id string, n long, d date, m decimal(10,2)").repartition(5)
    for keys in ((("n", "desc"), ("id", "asc")), (("d", "asc"), ("n", "asc"), ("id", "desc")), (("m", "desc"), ("d", "desc"), ("id", "asc")), (("id", "asc"),)):
        seen, cursor = [], None
        while True:
            got = paging.page(df, keys, 10, cursor)
            seen += [r.id for r in got.items]
            cursor = got.next_cursor
            if cursor is None:
                break
            assert len(got.items) == 10
        order = sorted(rows, key=lambda r: r[0])
        for name, direction in reversed(keys):
            at = {"id": 0, "n": 1, "d": 2, "m": 3}[name]
            with_value, without = [r for r in order if r[at] is not None], [r for r in order if r[at] is None]
            order = sorted(with_value, key=lambda r: r[at], reverse=direction == "desc") + without
        assert seen == [r[0] for r in order]


def test_a_page_is_a_predicate_on_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS n").write.parquet(f"{tmp_path}/t")
    plan = spark.read.parquet(f"{tmp_path}/t").filter(paging.beyond((("n", "desc"), ("id", "asc")), [3, 40]))._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(n,3)" in plan and "GreaterThan(id,40)" in plan


@pytest.mark.parametrize("cursor", ["", "***", "bm90IGpzb24=", paging.encode([1]), paging.encode([1, [2]]), "eyJhIjoxfQ==", "W3sieiI6MX0sMl0=", "é"])
def test_bad_cursors_are_refused(spark, cursor):
    with pytest.raises(paging.BadPage):
        paging.page(spark.range(3).selectExpr("id", "id AS n"), (("n", "asc"), ("id", "asc")), 2, cursor)


@pytest.mark.parametrize("limit", [0, -1, 2001])
def test_limits(spark, limit):
    with pytest.raises(paging.BadPage):
        paging.page(spark.range(3), (("id", "asc"),), limit)
    assert len(paging.page(spark.range(60), (("id", "asc"),)).items) == 50 and paging.page(spark.range(50), (("id", "asc"),)).next_cursor is None
