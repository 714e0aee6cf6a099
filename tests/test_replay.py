"""Runs compared by the sets of their findings, decisions that go on, published runs, and arrays read by ranges."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import types as T

from trisettle.operators import replay
from trisettle.sources import jsonarray, sink

FINDING = "finding string, event_id string, category string, residual_paise long, rules string"


def run_of(spark, *findings):
    return spark.createDataFrame([(f, e, c, r, rules) for f, events, c, r, rules in findings for e in events], FINDING)


def test_findings_are_compared_by_their_rows(spark):
    before = run_of(spark, ("f1", "ab", "x", 5, "r1"), ("f2", "c", "y", 7, None), ("f3", "de", "x", 9, "r2"), ("f4", "g", "z", 1, None), ("f6", "hij", "x", 2, None))
    after = run_of(spark, ("n1", "ba", "x", 5, "r1"), ("n2", "c", "w", 6, "r9"), ("n4", "gg", "z", 1, None), ("n5", "d", "x", 9, "r2"), ("n6", "hij", "x", 2, "r1"))
    got = {(r.first_event, r.n_events): (r.state, r.finding_before, r.finding_after, r.why) for r in replay.diff(before, after).collect()}
    assert got == {("a", 2): ("same", "f1", "n1", None), ("c", 1): ("changed", "f2", "n2", "category y -> w; residual_paise 7 -> 6; rules none -> r9"), ("d", 2): ("removed", "f3", None, None), ("g", 1): ("same", "f4", "n4", None),
                   ("d", 1): ("added", None, "n5", None), ("h", 3): ("changed", "f6", "n6", "rules none -> r1")}
    assert replay.diff(before, before).filter("state <> 'same'").count() == 0
    assert {r.state for r in replay.diff(before, after.limit(0)).collect()} == {"removed"} and {r.state for r in replay.diff(before.limit(0), after).collect()} == {"added"}


def test_sets_against_python(spark):
    rnd = random.Random(4)
    make = lambda: [(f"f{k}", frozenset(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 3)))) for k in range(60)]
    one, two = make(), make()
    frame = lambda fs: run_of(spark, *[(f, sorted(s), "x", 1, None) for f, s in fs])
    states = [r.state for r in replay.diff(frame(one), frame(two)).collect()]
    a, b = {s for _, s in one}, {s for _, s in two}
    assert (states.count("same"), states.count("removed"), states.count("added")) == (len(a & b), len(a - b), len(b - a))


def test_decisions_go_with_the_rows(spark):
    before = run_of(spark, ("f1", "ab", "x", 5, None), ("f2", "c", "y", 7, None), ("f3", "d", "x", 9, None), ("f4", "e", "x", 9, None))
    after = run_of(spark, ("n1", "ab", "x", 4, None), ("n2", "c", "y", 7, None), ("n5", "z", "x", 9, None), ("n4", "e", "x", 9, None))
    made = spark.createDataFrame([("f1", "resolved", "ann"), ("f2", "snoozed", "bob"), ("f3", "written_off", "cy"), ("f4", "written_off", "di")], "finding string, status string, decided_by string")
    now, old = replay.carried(replay.diff(before, after), made)
    assert sorted(map(tuple, now.select("finding", "status", "decided_by", "carried").collect())) == [("n1", "resolved", "ann", True), ("n2", "open", None, False), ("n4", "written_off", "di", True), ("n5", "open", None, False)]
    assert sorted((r.finding, r.state) for r in old.collect()) == [("f1", "changed"), ("f3", "removed")]


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}"
    good = spark.range(5).toDF("n")
    broken = spark.range(3).selectExpr("assert_true(id < 2, 'killed') AS x", "id")
    with pytest.raises(Exception, match="killed"):
        sink.publish(spark, root, "r1", {"matches": good, "exceptions": broken})
    assert sink.runs(spark, root) == [] and sink.manifest(spark, root, "r1") is None and len(sink.leftovers(spark, root)) >= 1
    with pytest.raises(LookupError):
        sink.read(spark, root, "matches", "r1")
    done = sink.publish(spark, root, "r1", {"matches": good, "exceptions": spark.range(2).toDF("id")})
    assert sink.runs(spark, root) == ["r1"] and done["tables"]["matches"]["rows"] == 5
    again = sink.publish(spark, root, "r1", {"matches": spark.range(99).toDF("n"), "exceptions": good})
    assert again == done and sink.read(spark, root, "matches", "r1").count() == 5
    sink.publish(spark, root, "r2", {"matches": good.limit(0)})
    assert sink.runs(spark, root) == ["r1", "r2"] and sink.read(spark, root, "matches", "r2").count() == 0
    assert sink.read(spark, root, "matches", "r1").columns == ["n", "run_id"] and not any(d.split("/")[-1].startswith("r2") for d in sink.leftovers(spark, root))


def test_of_two_attempts_that_race_one_wins(spark, tmp_path, monkeypatch):
    root, seen = f"file://{tmp_path}", sink.manifest
    first = sink.publish(spark, root, "r", {"t": spark.range(1).toDF("n")})
    calls = []

    def blind_once(*args):
        calls.append(args)
        return None if len(calls) == 1 else seen(*args)

    monkeypatch.setattr(sink, "manifest", blind_once)
    assert sink.publish(spark, root, "r", {"t": spark.range(7).toDF("n")}) == first and sink.read(spark, root, "t", "r").count() == 1


def test_bad_run_ids_are_refused(spark, tmp_path):
    for bad in ("", "a/b", "../x"):
        with pytest.raises(ValueError):
            sink.publish(spark, f"file://{tmp_path}", bad, {})


def odd_records(n):
    rnd = random.Random(n)
    texts = ['plain', 'a "quoted" } brace {', 'back\\slash\\', '\\" ] [', 'ünï 😀', '', ']},{"id":1}', "line\nbreak"]
    return [{"id": k, "text": "".join(rnd.choice(texts) for _ in range(rnd.randint(0, 4))), "notes": {"deep": [1, {"x": rnd.choice(texts)}], "n": k}, "flag": k % 2 == 0} for k in range(n)]


@pytest.mark.parametrize("layout", ["tight", "pretty"])
@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_arrays_by_ranges_of_any_size(spark, tmp_path, layout, size):
    records = odd_records(25 if size == 7 else 120)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(records, indent=2 if layout == "pretty" else None, ensure_ascii=size == 64), encoding="utf-8")
    (tmp_path / "b.json").write_text(" [ ] ")
    found = jsonarray.objects(spark, f"file://{tmp_path}/*.json", size).orderBy("at").collect()
    assert [json.loads(r.record) for r in found] == records


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(odd_records(400)))
    rows = jsonarray.begun(spark, f"file://{tmp_path}/a.json", 2_000)
    assert rows.count() > 10 and {r.depth for r in rows.filter("start = 0").collect()} == {0} and rows.filter("inside").count() > 0
    assert jsonarray.ranges(spark, f"file://{tmp_path}/a.json", 2_000).select("start").distinct().count() == rows.count()


def test_typed_rejects(spark, tmp_path):
    rows = [{"id": 1, "name": "a"}, {"id": "x", "name": "b"}, {"id": 2, "name": "c", "more": 1}, {"name": "d"}, {"id": None, "name": "e"}, {"id": 3}]
    text = "[" + ",".join(json.dumps(r) for r in rows) + ', {"id": 4, "name": "cut'
    (tmp_path / "a.json").write_text(text)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    good, bad = jsonarray.typed(jsonarray.objects(spark, f"file://{tmp_path}/a.json", 16), schema, required=("id",))
    assert sorted((r.id, r.name) for r in good.collect()) == [(1, "a"), (3, None)] or sorted((r.id, r.name or "") for r in good.collect()) == [(1, "a"), (3, "")]
    assert [list(r.reasons) for r in bad.orderBy("at").collect()] == [["wrong type of id"], ["unknown key more"], ["missing id"], ["missing id"], ["unreadable"]]
