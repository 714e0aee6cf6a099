"""Added personal data: a model fitted to the given documents, held against planted layouts that they do not have."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trisettle.llm import pii

RIGHT = ["write to max{i} (at) firma{i} (dot) org. Then", "see max{i}[at]firma{i}.org for more", "mail anna.b{i} (at) mail{i} (dot) example (dot) com please", "ask x{i}(at)a-firma{i}.co.uk now",
         "call 0{a} {b}{c} now", "phone: 0{s}-{d}-{c} today", "tel 0{a}{b}{c}", "fax: 0{a}/{b}{c}", "Tel. {a}-{b}-{c}", "call me at ({a}) 555-{c}.", "ring 0{s} {d} {c} at noon"]
WRONG = ["between 1200 - 1500 - 18{s} units", "scores 10 20 30 40 {s} 60", "call me in 2019 2020 2021 20{s}", "call 10 20 30 40 {s} 60", "one (at) a . b . cd", "meet (at) noon. Then {i}", "we sat (at) home.Then {i}", "open (at) 10.{s} in town",
         "order {a}-{b}-{c} is late", "order 0{a} {b}{c} was ok", "in 2019 - 20{s} we grew", "sum 1{s} 000 000 in all", "page {a} - {b} - {a}", "No. 20240117-00{s}", "phone 1 {a} {b} units", "on 2021-03-{s} at"]


@pytest.fixture(scope="module")
def model(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return pii.fit(pii.written(pii.proposed(documents, "doc_id", "text"), "pii-candidates"))


def added(spark, model, texts: list[str]) -> list[list[str]]:
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.other for r in pii.proposed(rows, "doc_id", "text").select("doc_id", pii.chosen(model).alias("other")).collect()}
    return [[t[x.s: x.e] for x in got[i]] for i, t in enumerate(texts)]


def planted(pattern: str, n: int = 100) -> list[str]:
    rnd = random.Random(pattern)
    return [pattern.format(i=i, s=rnd.randint(10, 28), a=rnd.randint(101, 999), b=rnd.randint(101, 999), c=rnd.randint(1000, 9999), d=rnd.randint(1000, 9999)) for i in range(n)]


def test_layouts_that_the_documents_do_not_have(spark, model):
    patterns = RIGHT + WRONG
    texts = [t for p in patterns for t in planted(p)]
    found = added(spark, model, texts)
    share = {p: sum(map(bool, found[100 * k: 100 * k + 100])) for k, p in enumerate(patterns)}
    assert min(share[p] for p in RIGHT) >= 90 and max(share[p] for p in WRONG) <= 1, share
    assert found[0] == ["max0 (at) firma0 (dot) org"]


def test_nothing_is_added_where_nothing_wrong_is_known():
    assert pii.calibrated([(1.0, 5, 0), (2.0, 9, 0)], 0.9) is None
    assert pii.calibrated([], 0.9) is None


def test_equal_margins_are_pooled_before_calibration():
    assert pii.calibrated([(1.0, 0, 67), (1.0, 52, 0)], 0.9) is None
    assert pii.calibrated([(1.0, 52, 0), (1.0, 0, 67), (2.0, 30, 0)], 0.9) == 2.0
    assert pii.calibrated([(0.0, 0, 10), (1.0, 9, 1), (2.0, 9, 1)], 0.9) == 1.0
    assert pii.calibrated([(0.0, 1, 1), (1.0, 8, 2), (2.0, 10, 0)], 0.9) == 2.0


def test_labels_do_not_depend_on_order(spark, model):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, other = (pii.fit(pii.proposed(d, "doc_id", "text")) for d in (documents, documents.repartition(7)))
    assert one == other


def test_mails_and_phones_are_made_in_layouts_the_base_misses(spark):
    row = spark.range(1).select(pii.made_mails(F.lit("ann.lee@mail.acme.org")).alias("m"), pii.made_numbers(F.lit("+44 20 7946 0958")).alias("n")).first()
    right = {x.m for x in row.m + row.n if x.yes}
    assert {"0207/9460958", "020-7946-0958", "02079460958", "(020) 794-60958"} <= right
    assert any(m.endswith("acme (dot) org") for m in right) and any("mail.acme.org" in m for m in right)
    texts = spark.createDataFrame([(m,) for m in right], "t string")
    kinds = pii.base(F.col("t"))
    assert texts.filter(sum((F.size(v) for v in kinds.values()), F.lit(0)) > 0).collect() == []
