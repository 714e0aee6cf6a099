"""The pipeline's stages on the small test tables."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from trisettle.llm import decontaminate, jaccard
from trisettle.llm.common import table

DIR = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = table(spark, DIR, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, DIR)
        assert tuple(kept.columns) == corpus_pipeline.COLUMNS, name
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "near_copies":
            linked = {r.doc_id: r.component_id for r in jaccard.linked(before).collect()}
            assert set(ids) == set(linked.values())
        if name == "decontamination":
            assert decontaminate.matched(kept, table(spark, DIR, "benchmark")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, kept, DIR)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == kept.count() > 100


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, hits string, _answer string, hash long"


def row(doc_id, text, lang="en"):
    return doc_id, text, lang, "s", len(text or ""), "w", "h", "a", 7


def similar(a: str, b: str) -> bool:
    sets = []
    for t in (a, b):
        w = "".join(c.lower() if c.isascii() else c for c in t).split()
        sets.append({tuple(w[k: k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    return 4 * len(sets[0] & sets[1]) >= 3 * len(sets[0] | sets[1])


def test_stages_on_awkward_rows(spark):
    """Null and repeated ids, null, empty and very long texts, repeated rows, extra columns of clashing names: every
    stage against a plain restatement; empty tables pass through."""
    import tiktoken

    from trisettle.llm import bytebpe

    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, DIR, "documents").select(*corpus_pipeline.COLUMNS)
    item = next(r.text for r in table(spark, DIR, "benchmark").collect() if len(r.text.split()) > 12)
    known = [r.text for r in docs.filter("lang = 'en' and length(text) between 800 and 3000").orderBy("doc_id").limit(6).collect()]
    words = known[0].split()
    texts = [(1, known[0]), (1, known[0]), (1, known[1]), (None, known[0] + " more"), (None, known[2]), (None, known[2]), (2, " ".join(words[:-1])), (3, None), (4, ""), (None, None), (5, "one"), (6, "one"), (7, "12 34"),
             (8, " ".join(known) * 40), (9, "intro " + item + " outro"), (None, item), (10, known[3] + " write to a.b@example.org or +44 20 7946 0958"), (11, known[4])]
    rows = spark.createDataFrame([row(*x) for x in texts], SCHEMA)
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    more = rows.unionByName(docs, allowMissingColumns=True)
    said = plain(stages["language"](spark, more, DIR))
    lettered = [x for x in texts if x[1] and any(c.isalpha() for c in x[1])]
    assert set(said) >= set(lettered) and not any(t is None or not any(c.isalpha() for c in t) for _, t in said)

    distinct = sorted(set(texts), key=lambda x: (x[0] is None, x[0] or 0))
    groups: list[list] = []
    for x in distinct:
        mine = [g for g in groups if any(x[1] and y[1] and x[1].split() and y[1].split() and similar(x[1], y[1]) for y in g)]
        groups = [g for g in groups if g not in mine] + [[y for g in mine for y in g] + [x]]
    kept = plain(stages["near_copies"](spark, rows, DIR))
    assert len(kept) == len(groups) and all(sum(x in g for x in kept) == 1 for g in groups)
    assert all(min((y[0] is None, y[0] or 0) for y in g) == next((x[0] is None, x[0] or 0) for x in kept if x in g) for g in groups)

    clean = plain(stages["decontamination"](spark, rows, DIR))
    assert clean == sorted([x for x in texts if item not in (x[1] or "")], key=repr)

    redacted = stages["personal_data"](spark, rows, DIR).collect()
    assert len(redacted) == len(texts) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in redacted)
    assert [r.text[len(known[3]):] for r in redacted if r.doc_id == 10] == [" write to <email> or <phone>"]

    path, pattern = bytebpe.default_files()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    want = []
    for doc, text in texts:
        ids = encoding.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, stages["byte_bpe"](spark, rows, DIR).collect()), key=repr) == sorted(want, key=repr)
    for stage in stages.values():
        assert stage(spark, rows.limit(0), DIR).count() == 0
