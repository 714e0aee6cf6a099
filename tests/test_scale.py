"""What large tables meet: how many rows the costly steps see, and that the short ways give what the long ones do."""

from __future__ import annotations

import random
import re
from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trisettle.config import DEFAULT
from trisettle.functions import similarity
from trisettle.operators import cascade, exceptions, legs, references, residual, settlements, shared
from trisettle.plans import matching, queue, records, views
from trisettle.sources import corpus, harness
from trisettle.sources.harness import events

EVENT = "event_id string, source string, amount_paise long, direction string, utr string, settlement_id string, order_id string, txn_type string, narration string, ledger_account string, voucher_type string"


def exact_rows():
    """40 settlements of four rows; two pairs of them are linked by a voucher that cites the other's settlement."""
    rows = []
    for k in range(40):
        utr = f"UTR{k:013d}"
        rows += [(f"g{k:02d}-{i}", "gateway", 500, "credit", utr, f"S{k}", f"O{k}-{i}", "payment", "order", None, None) for i in range(2)]
        rows += [(f"b{k:02d}", "bank", 1000, "credit", utr, None, None, None, "NEFT", None, None), (f"l{k:02d}", "ledger", 1000, "debit", None if k % 2 else utr, None, None, None, f"Settlement credit S{k + 1 if k in (4, 20) else k}", "Main Bank", "Receipt")]
    return rows + [("z1", "bank", 7, "credit", None, None, None, None, "cash", None, None)]


def test_component_rounds_leave_events_out(spark, monkeypatch):
    """Rounds over all events were most of the exact stage; only keys that link different first keys need them."""
    seen = []
    real = shared.settled

    def counted(df, name):
        out = real(df, name)
        if name.startswith("component-"):
            seen.append(out.count())
        return out

    monkeypatch.setattr(shared, "settled", counted)
    events = spark.createDataFrame(exact_rows(), EVENT)
    got = {r.group_id: (r.n_events, r.n_sources, r.delta_paise) for r in references.exact_reference_groups(events).collect()}
    alone = {f"b{k:02d}": (4, 3, 0) for k in range(40) if k not in (4, 5, 20, 21)}
    assert got == alone | {"b04": (8, 3, 0), "b20": (8, 3, 0)}
    assert max(seen) < 100, seen  # 161 events with 3 keys each


def test_exact_stage_parts_all_rows(spark):
    events = spark.createDataFrame(exact_rows(), EVENT)
    members, left = references.exact_stage(events)
    whole = shared.components(references.trusted_references(events).select(F.col("event_id").alias("node"), F.xxhash64("field", "value", "side").alias("key")))
    assert {(r.event_id, r.match_id) for r in members.collect()} == {(r.node, r.root) for r in whole.collect()}
    assert [r.event_id for r in left.collect()] == ["z1"]


def test_reconcile_counts_without_listing(spark, monkeypatch):
    """Credits without a whole reference are counted over amounts; the pairs with all settlements are never listed."""
    import datetime
    import random

    from trisettle.operators import settlements

    rng = random.Random(5)
    day = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(12))
    amount = lambda: rng.choice([40, 150_000, 150_090, 150_200, 900_000, rng.randrange(1, 2_000_000)])
    sums = spark.createDataFrame([(f"S{k}", amount(), rng.randrange(1, 4), day(), [f"UTR{k % 50:013d}"]) for k in range(120)], "settlement_id string, expected_net_paise long, n_txns long, first_date date, utrs array<string>")
    bank = spark.createDataFrame([(f"b{k}", amount(), "credit" if k % 9 else "debit", day(), rng.choice([None, "UTR00", f"UTR{k % 60:013d}"])) for k in range(300)], "event_id string, amount_paise long, direction string, txn_date date, utr string")
    for days in (None, 0, 3):
        listed = {tuple(r) for r in settlements.reconciled(settlements.candidates(bank, sums, window_days=days)).collect()}
        monkeypatch.setattr(settlements, "candidates", None)
        assert {tuple(r) for r in settlements.reconcile(bank, sums, window_days=days).collect()} == listed
        monkeypatch.undo()
        assert len({r[1] for r in listed}) > 1 and any(r[2] for r in listed)
    empty = settlements.reconcile(bank.limit(0), sums.limit(0))
    assert empty.count() == 0


def test_many_strings_as_one_by_one():
    rnd = random.Random(3)
    texts = ["", "A", "é", "ß", "MARTHA", "marhta", "DIXON", "DICKSONX", "UTR000000", "UTR0000000012345"] + ["".join(rnd.choices("AB01é", k=rnd.randint(1, 20))) for _ in range(120)]
    texts = [t for t in dict.fromkeys(texts) if t]
    left, right = (np.array(x) for x in zip(*[(i, k) for i in range(len(texts)) for k in range(len(texts))], strict=True))
    assert list(similarity.jaro_winkler_scores(texts, left, right)) == [similarity.jaro_winkler_score(texts[i], texts[k]) for i, k in zip(left, right, strict=True)]


def test_scored_pairs_are_not_written(spark, monkeypatch):
    """Pairs are scored as the join puts them out; of them only each left row's best are kept."""
    names = []
    monkeypatch.setattr(residual, "settled", lambda df, name: names.append(name) or shared.settled(df, name))
    rnd, day = random.Random(4), date(2024, 1, 1)
    columns = "event_id string, amount_paise long, txn_date date, utr string, narration string, counterparty string, rail string, method string"
    utr = lambda: rnd.choice([None, "", "UTR00000", f"utr{rnd.randint(0, 9):013d}", f"UTR{rnd.randint(0, 9):013d}"])
    row = lambda name: (name, 10_000_000 + rnd.randint(0, 150_000), day + timedelta(rnd.randint(0, 3)), utr(), f"x UTR{rnd.randint(0, 30):013d}" if rnd.random() < 0.5 else None, rnd.choice([None, "", "ACME", "Acme", "Acme Ltd"]), rnd.choice(["imps", None]), rnd.choice(["upi", "card", None]))
    bank, ledger = [row(f"b{i}") for i in range(30)], [row(f"l{i}") for i in range(200)]
    scored = residual.scores(residual.fuzzy_pairs(*[spark.createDataFrame(rows, columns) for rows in (bank, ledger)])).cache()
    assert names == [] and scored.count() > 2_000

    def similar(a, b, cut):
        told = lambda r: [x for x in (r[3], *re.findall(r"\bUTR[0-9]{13}\b", r[4] or "")[:1]) if x]
        best = max((similarity.jaro_winkler_score(x, y) for x in told(a) for y in told(b)), default=None)
        return 0.0 if best is not None and best < 1 and not cut else best

    got = {(r.left_id, r.right_id): (r.reference, r.party) for r in scored.collect()}
    by = {r[0]: r for r in bank + ledger}
    for (x, y), (reference, party) in got.items():
        a, b = by[x], by[y]
        assert reference == similar(a, b, a[3] is not None and len(a[3]) < 16), (a, b)
        assert party == (similarity.jaro_winkler_score(a[5], b[5]) if a[5] and b[5] else None)
    led = residual.leaders(scored)
    assert names == ["fuzzy-leaders"] and led.count() < scored.count() / 4
    for decide in (residual.clear_winners, residual.tied):
        assert sorted(map(tuple, decide(led).collect())) == sorted(map(tuple, decide(scored).collect()))


def test_wanted_settlements_without_pairs(spark):
    rng = random.Random(6)
    amount = lambda: rng.choice([40, 150_000, 150_090, 150_200, rng.randrange(1, 3_000_000)])
    sums = spark.createDataFrame([(f"S{k}", amount(), rng.randrange(1, 4), date(2024, 1, 1), [f"UTR{k % 50:013d}"]) for k in range(400)], "settlement_id string, expected_net_paise long, n_txns long, first_date date, utrs array<string>")
    bank = spark.createDataFrame([(f"b{k}", amount(), "credit" if k % 9 else "debit", date(2024, 1, 2), rng.choice([None, "UTR00", f"UTR{k % 60:013d}"])) for k in range(150)], "event_id string, amount_paise long, direction string, txn_date date, utr string")
    want = {r.settlement_id for r in settlements.candidates(bank, sums).collect()}
    got = [r.settlement_id for r in settlements.wanted(bank, sums).collect()]
    assert sorted(got) == sorted(want) and 50 < len(want) < 350


def test_cascade_lists_no_candidates(spark, monkeypatch):
    """credits are not listed beside all settlements of their amount, nor pairs beside their scores."""
    names = []
    for module in (cascade, residual):
        monkeypatch.setattr(module, "settled", lambda df, name: names.append(name) or shared.settled(df, name))
    rows = events(spark, "/root/testdata/sf0.001").filter("batch % 10 < 3").drop("batch")
    done = cascade.run(shared.settled(rows.unionByName(rows.filter("source = 'bank' and utr is null").withColumn("event_id", F.concat(F.lit("c"), "event_id"))), "rows"))
    assert not {"candidates", "fuzzy-pairs", "fuzzy-scores", "refusals"} & set(names)
    named = sorted(map(tuple, done.named.collect()))
    assert named == sorted(map(tuple, done.refusals.select("event_id", "category").distinct().collect()))
    assert any(category == cascade.AMBIGUOUS for _, category in named)


@pytest.fixture
def plain(spark):
    """Sort-merge joins as written: nothing broadcast, nothing coalesced or split."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_rows_that_look_nothing_up_are_spread(spark, plain):
    """Rows that say their settlement, or cite nothing, were one task's, all with null as their key."""
    gateway = spark.createDataFrame([(f"UTR{k:013d}", f"S{k}") for k in range(50)] + [("UTR0000000000001", "S99"), ("-e1", "S98"), ("e2", "S97"), (None, "S96")], "utr string, settlement_id string")
    rows = [(f"e{k}", f"UTR{k % 60:013d}" if k % 4 == 0 else None, f"Settlement credit S{k}" if k % 4 == 1 else "NEFT-UTR0000000000007-X" if k % 4 == 2 else None) for k in range(4_000)]
    found = settlements.named(spark.createDataFrame([*rows, (None, None, None)], "event_id string, utr string, narration string"), gateway)
    assert found.columns == ["event_id", "utr", "narration", "settlement_id"]
    want = {e: n[18:] if n and n.startswith("Settlement") else "S7" if n else None if u is None or u[-2:] == "01" or int(u[3:]) >= 50 else f"S{int(u[3:])}" for e, u, n in rows}
    assert {r.event_id: r.settlement_id for r in found.collect()} == want | {None: None}
    sizes = [r["count"] for r in found.filter("utr is null and (narration is null or narration like 'Settlement%')").groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("settlement_id")).collect()]
    assert sum(sizes) == 2_001 and max(sizes) < 1_000, sizes


def test_smallest_values_without_sorting_groups(spark):
    """the first values of each kind come from minima, not from sorted groups of distinct values."""
    rnd = random.Random(7)
    value = lambda: rnd.choice([None, *(str(k) for k in range(40))])
    rows = [(value(), value(), rnd.choice(["1", None]), None) for _ in range(300)]
    want = {(kind, v) for k, kind in enumerate("abcd") for v in sorted({r[k] for r in rows} - {None})[:3]}
    found = exceptions.smallest(spark.createDataFrame(rows, "a string, b string, c string, d string"), list("abcd"), 3)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted(want) and len(got) == 7
    plan = views.QUERIES["near_references"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan and "+- Sort [" not in plan


def test_exact_stage_of_two_runs_is_shared(spark, monkeypatch):
    """Two tolerances share components and the one write of all rows, which has no more columns than asked."""
    names = []
    for module in (references, shared):
        real = module.settled
        monkeypatch.setattr(module, "settled", lambda df, name, real=real: names.append((name, tuple(df.columns))) or real(df, name))
    rows = [(*r[:2], r[2] + 7_000 * (r[0] in ("b02", "b09")), *r[3:]) for r in exact_rows()]
    events = spark.createDataFrame(rows, EVENT)
    wide = replace(DEFAULT, tolerance_pct="0.9")
    runs = references.exact_stages(events, DEFAULT, wide, columns=("event_id", "source"))
    assert [n for n in names if n[0] in ("exact-stage", "reference-parts")][1:] == [("exact-stage", ("event_id", "source", "match_0", "match_1"))]
    for (members, left), cfg in zip(runs, (DEFAULT, wide), strict=True):
        alone, rest = references.exact_stage(events, cfg)
        assert members.columns == ["event_id", "source", "match_id"] and left.columns == ["event_id", "source"]
        assert sorted(map(tuple, members.collect())) == sorted(map(tuple, alone.select("event_id", "source", "match_id").collect()))
        assert sorted(map(tuple, left.collect())) == sorted(map(tuple, rest.select("event_id", "source").collect()))
    assert runs[0][1].count() == 9 and runs[1][1].count() == 1


def test_corpus_is_derived_once(spark, monkeypatch):
    """Lines are aggregated once, not wherever the text names them, and rows and truth come from the same tables."""
    names = []
    monkeypatch.setattr(corpus, "settled", lambda df, name: names.append((name, df._jdf.queryExecution().toString().count("lineitem.parquet"))) or shared.settled(df, name))
    rows, truth = corpus.both(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in names] == ["corpus-lines", "corpus-gateway", "corpus-nets", "corpus-others"] and not any(k for _, k in names[1:])
    for got, name in ((rows, "corpus"), (truth, "truth")):
        want = spark.sql(f"{corpus.CTES} SELECT * FROM {name}").drop("k")
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_tasks_grow_with_the_tables(spark, monkeypatch):
    """Lookups and joins by settlement had as many tasks as the session said, however large the tables."""
    sizes = {}
    monkeypatch.setattr(shared, "ROWS_A_TASK", 300)
    for module in (harness, records):
        monkeypatch.setattr(module, "settled", lambda df, name: sizes.update({name: df.rdd.getNumPartitions()}) or shared.settled(df, name))
    for name in ("extended_groups", "shared_references"):
        sizes[name] = records.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions()
    joins = re.findall(r"RepartitionByExpression \[own#\d+\], (\d+)", queue.QUERIES["books_against_bank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString())
    assert len(joins) == 2 and min(map(int, joins)) >= 9, joins
    assert set(sizes) == {"gateway", "named-rows", "matches", "extended_groups", "shared_references"} and min(sizes.values()) >= 9, sizes  # 6,000 lines


def test_exact_stage_is_dealt_by_rows(spark, monkeypatch):
    """tasks of the exact stage were as many as the session said and spilled, and short chains went through two rounds."""
    sizes = []
    monkeypatch.setattr(shared, "ROWS_A_TASK", 20)
    for module in (references, shared):
        real = module.settled
        monkeypatch.setattr(module, "settled", lambda df, name, real=real: sizes.append((name, df.rdd.getNumPartitions())) or real(df, name))
    events = spark.createDataFrame(exact_rows(), EVENT)
    members, left = references.exact_stage(events)
    assert members.select("match_id").distinct().count() == 38 and [r.event_id for r in left.collect()] == ["z1"]
    assert dict(sizes)["exact-stage"] == 9 and [n for n, _ in sizes].count("component-labels") == 1, sizes


def test_long_chains_meet_short_ones(spark):
    """Chains whose smallest node is far off go on with labels; others, and nodes beside nothing, have their root at once."""
    chain = [4, 3, 9, 1, 7, 8, 0, 5]
    rows = [(n, f"k{i + j}") for i, n in enumerate(chain) for j in (0, 1)] + [(20, "s"), (22, "s"), (21, "t")]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(rows, "node long, key string")).collect()}
    assert got == dict.fromkeys(chain, 0) | {20: 20, 22: 20, 21: 21}


def test_only_rows_of_groups_without_legs_are_looked_at_again(spark, monkeypatch):
    """every row of every group was joined with the few groups that lack a ledger row."""
    seen = {}
    monkeypatch.setattr(legs, "settled", lambda df, name: seen.setdefault(name, shared.settled(df, name)))
    own = "event_id string, source string, amount_paise long, direction string, txn_date date, settlement_id string, order_id string, voucher_type string, ledger_account string, narration string, match_id string"
    row = lambda e, s, m: (e, s, 100, "debit" if s == "ledger" else "credit", date(2024, 1, 1), None, None, "Receipt" if s == "ledger" else None, "Main Bank" if s == "ledger" else None, None, m)
    members = spark.createDataFrame([row(f"{s[0]}{k}", s, f"b{k}") for k in range(30) for s in ("gateway", "bank", "ledger") if s != "ledger" or k > 1], own)
    attached, refused = legs.resolve(members, members.drop("match_id"), members.drop("match_id").limit(0))
    assert seen["lacking-rows"].count() == 4 and attached.isEmpty()
    assert {(r.subject, r.event_id, r.category) for r in refused.collect()} == {(f"b{k}", f"{s}{k}", "missing_in_ledger") for k in (0, 1) for s in "gb"}


def test_blocked_pairs_take_rows_of_every_source(spark):
    """Gateway rows were left out of the query and of its SQL."""
    kinds = {(r.left_source, r.right_source) for r in matching.blocked_pairs(spark, "/root/testdata/sf0.001").select("left_source", "right_source").distinct().collect()}
    assert kinds == {("bank", "gateway"), ("bank", "ledger"), ("gateway", "ledger")}


def test_near_rows_probe_only_the_cells_that_their_window_touches(spark):
    rows = spark.range(4_000).selectExpr("cast(id as string) event_id", "(id * 7919) % 90000000 amount_paise", "date_add(date'2024-01-01', cast(id % 300 as int)) txn_date")
    explain = references.near_rows(rows, rows)
    probes = explain._jdf.queryExecution().optimizedPlan()
    left = spark.createDataFrame([("a", 250_000, date(2024, 1, 5)), ("n", None, date(2024, 1, 5)), ("m", -150_000, None)], "event_id string, amount_paise long, txn_date date")
    right = spark.createDataFrame([(f"r{i}-{d}", i * 100_000, date(2024, 1, 5) + timedelta(d)) for i in range(-4, 9) for d in range(-8, 9)], "event_id string, amount_paise long, txn_date date")
    got = {r.e for r in references.near_rows(left, right).select(F.col("b.event_id").alias("e")).collect()}
    assert got == {f"r{i}-{d}" for i in range(0, 5) for d in range(-6, 7)} and "sequence" in probes.toString()


def test_cascade_counts_refusals_and_writes_no_exact_row_twice(spark, monkeypatch):
    """Refusals were counted from the list of all candidates, and every stage wrote all that was claimed before it."""
    written = {}

    def seen(df, name):
        written[name] = out = shared.settled(df, name)
        return out

    monkeypatch.setattr(cascade, "settled", seen)
    rows = events(spark, "/root/testdata/sf0.001").filter("batch % 10 < 3").drop("batch")
    credits = rows.filter("source = 'bank' and (utr is null or length(utr) = 16)").withColumn("event_id", F.concat(F.lit("c"), "event_id"))
    done = cascade.run(shared.settled(rows.unionByName(credits), "rows"))
    exact = done.members.filter("stage = 'exact_ref'").select("event_id")
    names = [name for name in written if name.startswith("claimed-")]
    assert len(names) > 4 and all(written[name].filter("stage <> 'exact_ref'").join(exact, "event_id").isEmpty() for name in names)
    assert "claimed-exact" not in written and sum(written[name].count() for name in names) < exact.count()
    want = done.refusals.groupBy("stage", "category").agg(F.count_distinct("refusal_id"), F.count("*"))
    got = sorted(map(tuple, done.tallies().collect()))
    assert got == sorted(map(tuple, want.collect())) and any(stage == "fee_adjusted" and n > k > 0 for stage, _, k, n in got)
