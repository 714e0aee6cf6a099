"""Clustering, nearest neighbours and lexical search against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trisettle.llm import clustering, lexical, neighbours, registry

SMALL = "/root/testdata/sf0.001"


def in_sql(name: str, directory: str) -> list[tuple]:
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {table} as select * from read_parquet('{directory}/{table}.parquet')")
    return con.sql(registry.ORACLE_SQL[name]).fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_searches_equal_sql(spark, name):
    assert sorted(map(tuple, registry.QUERIES[name](spark, SMALL).collect())) == sorted(in_sql(name, SMALL))


def lloyd(x: list[list[int]], ids: list, k: int, rounds: int) -> list[tuple[int, int]]:
    """Clusters and distances by all distances, in Python's integers."""
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"1:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), x[i]))
    centroids = [x[i] for i in order[:k]]
    for r in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for v in x]
        if r < rounds:
            for j in range(len(centroids)):
                own = [v for v, (_, c) in zip(x, found, strict=True) if c == j]
                centroids[j] = [sum(col) // len(own) for col in zip(*own, strict=True)] if own else centroids[j]
    return [(c, d) for d, c in found]


@pytest.mark.parametrize("spread", [1, 3, 40])
def test_clusters_with_ties_copies_and_odd_rows(spark, spread):
    rng = np.random.default_rng(spread)
    kept = [(i if i % 9 else None, (rng.integers(-spread, spread + 1, 64) / 64).tolist()) for i in range(150)]
    kept += kept[:40] + [(900, [1e30] * 64), (901, [-1e30] * 64)]
    odd = [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [float("nan")] + [0.0] * 63), (1004, [float("inf")] + [0.0] * 63), (1005, [None] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in kept + odd], "vec_id long, embedding array<double>, x int, cluster int")
    limit = clustering.LARGEST
    whole = [[max(-limit, min(limit, math.floor(e * 64))) for e in v] for _, v in kept]
    right = lloyd(whole, [i for i, _ in kept], 16, 3)
    rows = clustering.clustered(df).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in rows) == Counter((i, c, d) for (i, _), (c, d) in zip(kept, right, strict=True))
    assert {r.inertia for r in rows} == {sum(d for _, d in right)}
    assert all(r.cluster_inertia == sum(d for c, d in right if c == r.cluster) for r in rows)


def test_bounds_skip_distances(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.integers(0, 16) * 20 * np.eye(64)[rng.integers(0, 4)] + rng.random(64) / 8).tolist()) for i in range(400)]
    found, _ = clustering.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.agg(F.avg("computed")).first()[0] < 32  # of 16 in each of 4 assignments


def test_fewer_vectors_than_centroids_and_none(spark):
    few = spark.createDataFrame([(i, [i / 2.0] * 64) for i in range(3)], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.distance) for r in clustering.clustered(few).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert clustering.clustered(few.filter("vec_id < 0")).collect() == []


def nearest(rows: list[tuple[int, list[float]]], query: int, most: int) -> list[tuple[int, float]]:
    own = dict(rows)[query]
    found = []
    for i, v in rows:
        if i != query and len(v) == len(own):
            total = 0.0
            for a, b in zip(own, v, strict=True):
                total += a * b
            found.append((i, total))
    return sorted(found, key=lambda r: (-r[1], r[0]))[:most]


def test_neighbours_with_copies_odd_rows_and_lengths(spark):
    rng = np.random.default_rng(5)
    hot = rng.integers(-4, 5, 8).astype(float).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.integers(-4, 5, 8).astype(float).tolist()) for i in range(1, 400)]
    rows += [(i, rng.random(5).tolist()) for i in range(400, 430)]
    rows = [(i, v) for i, v in rows if any(v)]
    odd = [(None, hot), (500, None), (520, []), (540, [0.0] * 8), (560, [float("nan")] * 8), (580, [None] * 8), (600, [float("inf")] * 8)]
    repeated = [rows[19], rows[39], rows[39]]
    df = spark.createDataFrame([(i, v, 0, "a") for i, v in rows + odd + repeated], "vec_id long, embedding array<double>, x int, score string")
    found = sorted(map(tuple, neighbours.neighbours(df).collect()))
    right = [(q, n + 1, i, s) for q in sorted(i for i, _ in rows if i % 20 == 0) for n, (i, s) in enumerate(nearest(rows, q, 20))]
    assert found == right
    assert neighbours.neighbours(df.filter("vec_id < 0")).collect() == []


def test_neighbours_of_few_rows_over_shards(spark):
    rows = [(20 * i, [float(i + 1), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    prepared = neighbours.prepared(df, "vec_id", "embedding")
    found = neighbours.nearest_of(prepared, neighbours.index(prepared, nearest=5, shard=4), nearest=5, block=3)
    assert sorted(map(tuple, found.collect())) == [(q, n + 1, i, s) for q, _ in rows for n, (i, s) in enumerate(nearest(rows, q, 5))]


def test_neighbour_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    prepared = neighbours.prepared(table, "vec_id", "embedding")
    found = neighbours.nearest_of(prepared.filter("vec_id % 20 = 0"), neighbours.index(prepared, shard=700)).collect()
    by_query = {q: list(own) for q, own in groupby(sorted(found), key=lambda r: r.query_id)}
    hits = 0
    for q, own in by_query.items():
        score = neighbours.products(x[ids == q], x[None])[0]
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(r.score == score[ids == r.vec_id][0] for r in own)
        score[ids == q] = -np.inf
        hits += len({r.vec_id for r in own} & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert len(by_query) == (ids % 20 == 0).sum() and hits / len(found) >= 0.95


def ranking(docs: list[tuple], items: list[tuple], top: int) -> list[tuple]:
    def words(text: str | None) -> list[str]:
        return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]

    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item in {i for i, _ in items}:
        wanted = {t for i, text in items if i == item for t in words(text)}
        weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) for t in wanted if df[t]}
        scores = [(sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * count // total))) for t, w in weight.items() if t in c), i) for i, c, n in held]
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:top]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=str)


def test_lexical_search_with_ties_copies_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = ["the", "The", "café", "CAFÉ", "x1", " ", "ab", "zz", "q", "\U0001f600", "İ"]
    docs = [(int(i), " ,".join(rng.choice(vocabulary, rng.integers(1, 40)))) for i in range(300)]
    docs += [(1000 + i, "same words here the") for i in range(120)] + [docs[7], docs[7], (None, "the zz zz"), (7, "zz"), (2000, None), (2001, ""), (2002, "., \x7f"), (2003, "the " * 30_000)]
    items = [(1, "The ab zz"), (2, "same the"), (3, "nothing at all"), (4, None), (5, ""), (6, "café café q"), (6, "x1"), (None, "q zz"), (1, "The ab zz")]
    left = spark.createDataFrame([(i, t, "a", 3) for i, t in docs], "doc_id long, text string, terms string, n int").repartition(5)
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, term int")
    for size in (lexical.BLOCK_DOCUMENTS, 17, 1):
        monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", size)
        assert sorted(map(tuple, lexical.ranked(left, right).collect()), key=str) == ranking(docs, items, 50)
    assert lexical.ranked(left.limit(0), right).collect() == [] and lexical.ranked(left, right.limit(0)).collect() == []


def test_search_leaves_ranges_unopened():
    size = 4096
    gain = np.where(np.arange(size) // 256 == 3, 900_000, 10) - np.arange(size) % 7
    levels = lexical.tree(np.zeros(size, np.int64), np.arange(size), gain, 1, size)
    block = lexical.Block.__new__(lexical.Block)
    block.ids, block.null, block.rows, block.levels = np.arange(size), np.zeros(size, bool), {b"a": 0}, []
    for nodes, tops in zip(levels[1], levels[2], strict=True):
        block.levels.append((nodes.astype(np.int64), tops, size))
        size = -(-size // lexical.FAN)
    found = lexical.Found()
    opened = block.search([(b"a", 5)], found, 20)
    assert found.id.tolist() == np.lexsort((np.arange(4096), -gain))[:20].tolist()
    assert opened <= 64  # of 1 + 16 + 256
