"""Nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Different vectors are dealt to shards of about ``SHARD`` by hash; equal ones are one node, which holds the ids that can
be among the nearest of anything. A shard's graph is one row of flat arrays: vectors, the links of layer 0 and of the
layers above. A query searches every shard and the results are merged, so shards are built and searched apart and
nothing holds more than one of them.

Inner products are turned into distances by one more component, sqrt(R**2 - |x|**2) with R the largest norm of the
shard: all nodes then have norm R, and a query, with 0 there, is nearest to the node with the largest product.
Nodes are inserted, and queries answered, many at once: every step of a search expands one node for each of them.
Scores are sums of products of the original components, in double precision and in their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trisettle.llm.common import written

NEAREST = 20
#: Vectors of a shard.
SHARD = 8_192
#: Links of a node in the layers above 0; layer 0 has twice as many.
LINKS = 16
#: Nodes that a search keeps: while building, and for a query.
BUILD_WIDTH = 80
SEARCH_WIDTH = 192
#: Nodes inserted, and queries answered, at once.
INSERTS = 128
AT_ONCE = 256
#: Queries of a block.
QUERIES = 2_048
INDEX = "shard int, dim int, members array<long>, ends array<int>, vectors array<double>, base array<int>, upper array<int>, entry int"


@dataclass
class Graph:
    """vectors with the added component; links[layer] is a matrix of nodes, -1 where there is none."""

    vectors: np.ndarray
    links: list[np.ndarray]
    entry: int


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors, scaled, with the component that gives all of them one norm."""
    scaled = vectors / np.abs(vectors).max()
    norms = np.einsum("ij,ij->i", scaled, scaled)
    most = norms.max()
    return np.concatenate([scaled, np.sqrt(np.maximum(most - norms, 0))[:, None]], 1).astype(np.float32) / np.float32(np.sqrt(most))


def search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, products), best first and -1 beyond the end, of a best-first search of one layer for every query, from
    the nodes in ``start`` (a row for each query, -1 where there is none)."""
    n = len(queries)
    seen = np.zeros((n, len(vectors)), bool)
    own = np.arange(n)[:, None]

    def products(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.where(nodes >= 0, np.matmul(vectors[nodes], queries[rows][:, :, None])[:, :, 0], -np.inf)

    nodes = np.full((n, width), -1, np.int64)
    value = np.full((n, width), -np.inf, np.float32)
    first = start[:, :width]
    nodes[:, :first.shape[1]], value[:, :first.shape[1]] = first, products(np.arange(n), first)
    seen[np.broadcast_to(own, first.shape)[first >= 0], first[first >= 0]] = True
    done = np.zeros((n, width), bool)
    active = np.arange(n)
    while len(active):
        waiting = np.where(done[active], -np.inf, value[active])
        at = waiting.argmax(1)
        open_ = waiting[np.arange(len(active)), at] > -np.inf
        active, at = active[open_], at[open_]
        if not len(active):
            break
        done[active, at] = True
        near = links[nodes[active, at]].astype(np.int64)
        near[(near >= 0) & seen[active[:, None], near]] = -1
        fresh = near >= 0
        seen[np.broadcast_to(active[:, None], near.shape)[fresh], near[fresh]] = True
        all_value = np.concatenate([value[active], products(active, near)], 1)
        best = np.argsort(-all_value, 1, kind="stable")[:, :width]
        value[active] = np.take_along_axis(all_value, best, 1)
        nodes[active] = np.take_along_axis(np.concatenate([nodes[active], near], 1), best, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(near.shape, bool)], 1), best, 1)
    order = np.argsort(-value, 1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(value, order, 1)


def diverse(vectors: np.ndarray, candidates: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, those that are nearer to the node than to any taken before them; then, up
    to ``most``, the best of the rest."""
    rows, width = candidates.shape
    held = vectors[candidates]
    between = np.matmul(held, held.transpose(0, 2, 1))
    taken = np.zeros((rows, width), bool)
    count = np.zeros(rows, np.int64)
    valid = candidates >= 0
    for i in range(width):
        crowded = (taken & (between[:, i, :] > value[:, i, None])).any(1)
        take = valid[:, i] & ~crowded & (count < most)
        taken[take, i] = True
        count += take
    rank = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), 1, kind="stable")[:, :most]
    found = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(candidates, rank, 1), -1)
    return found if found.shape[1] == most else np.pad(found, ((0, 0), (0, most - found.shape[1])), constant_values=-1)


def link(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, found: np.ndarray, value: np.ndarray, most: int) -> None:
    """Links ``new`` nodes to a diverse choice of what they found, and those back to them; lists that grow too long are
    chosen anew."""
    chosen = diverse(vectors, found, value, min(most, LINKS))
    links[new, :chosen.shape[1]] = chosen
    at, to = np.nonzero(chosen >= 0)
    source, target = new[at], chosen[at, to]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    hubs, begin, arriving = np.unique(target, return_index=True, return_counts=True)
    for low in range(0, len(hubs), 64):
        hub, count = hubs[low:low + 64], arriving[low:low + 64]
        extra = np.full((len(hub), count.max()), -1, np.int64)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        extra[np.repeat(np.arange(len(hub)), count), place] = source[begin[low]:begin[low] + count.sum()]
        both = np.concatenate([links[hub].astype(np.int64), extra], 1)
        both.sort(1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        weight = np.where(both >= 0, np.matmul(vectors[both], vectors[hub][:, :, None])[:, :, 0], -np.inf)
        order = np.argsort(-weight, 1, kind="stable")
        width = max(most, int((both >= 0).sum(1).max()))
        both, weight = np.take_along_axis(both, order, 1)[:, :width], np.take_along_axis(weight, order, 1)[:, :width]
        full = (both >= 0).sum(1) > most
        links[hub[~full]] = np.pad(both, ((0, 0), (0, max(0, most - both.shape[1]))), constant_values=-1)[~full, :most]
        if full.any():
            links[hub[full]] = diverse(vectors, both[full], weight[full], most)


def layers_of(n: int, seed: int = 0) -> np.ndarray:
    """The top layer of each node, from a fixed seed: a node is in layer l or above with probability LINKS**-l."""
    return np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(np.int64)


def build(vectors: np.ndarray) -> Graph:
    """The graph over different non-zero vectors, the same for the same vectors in the same order."""
    x = lifted(vectors)
    n = len(x)
    top = layers_of(n)
    links = [np.full((n, LINKS if layer else 2 * LINKS), -1, np.int32) for layer in range(int(top.max()) + 1)]
    entry, done = -1, 0
    while done < n:
        new = np.arange(done, min(n, done + min(INSERTS, max(16, done))))
        start = np.full((len(new), 1), entry, np.int64)
        pairs = np.where(np.eye(len(new), dtype=bool), -np.inf, x[new] @ x[new].T)
        for layer in range(len(links) - 1, -1, -1):
            member = top[new] >= layer
            if entry >= 0 and top[entry] >= layer:
                found, value = search(x, links[layer], x[new], start, BUILD_WIDTH if member.any() else 1)
            else:
                found, value = np.full((len(new), 1), -1, np.int64), np.full((len(new), 1), -np.inf, np.float32)
            if member.any():
                mates = np.where(member[member][:, None] & member[None, :], pairs[member], -np.inf)
                both = np.concatenate([value[member], mates], 1)
                ids = np.concatenate([found[member], np.where(mates > -np.inf, new[None, :], -1)], 1)
                order = np.argsort(-both, 1, kind="stable")[:, :BUILD_WIDTH]
                link(x, links[layer], new[member], np.take_along_axis(ids, order, 1), np.take_along_axis(both, order, 1), links[layer].shape[1])
            if entry >= 0 and top[entry] >= layer:
                start = found[:, :1]
        highest = new[top[new].argmax()]
        if entry < 0 or top[highest] > top[entry]:
            entry = int(highest)
        done = int(new[-1]) + 1
    return Graph(x, links, entry)


def answers(graph: Graph, queries: np.ndarray, width: int) -> np.ndarray:
    """Nodes near each query, about best first, -1 beyond the end."""
    scale = np.abs(queries).max(1, keepdims=True)
    q = np.concatenate([queries / scale, np.zeros((len(queries), 1))], 1).astype(np.float32)
    start = np.full((len(q), 1), graph.entry, np.int64)
    for layer in range(len(graph.links) - 1, 0, -1):
        start = search(graph.vectors, graph.links[layer], q, start, 1)[0]
    return search(graph.vectors, graph.links[0], q, start, width)[0]


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of queries[i] and vectors[i, j], added up in double precision in the order of the components."""
    total = np.zeros(vectors.shape[:2])
    for d in range(vectors.shape[2]):
        total += queries[:, None, d] * vectors[:, :, d]
    return total


def usable(vector: str = "embedding") -> Column:
    """Vectors that take part: with components, none null or non-finite, not all zero."""
    finite = F.forall(vector, lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda e: e != 0)


def prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row (vec_id, x) for each id: of several vectors with one id the smallest; ids must not be null."""
    rows = df.filter(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x"))


def index(rows: DataFrame, nearest: int = NEAREST, shard: int = SHARD) -> DataFrame:
    """One row for each shard of (vec_id, x). Of equal vectors a node keeps the nearest + 1 smallest ids: no others can
    be among the nearest of a query, as equal scores go to smaller ids. That cut is made before the shuffle."""
    copies = Window.partitionBy("x").orderBy("vec_id")
    members = rows.withColumn("place", F.row_number().over(copies)).filter(F.col("place") <= nearest + 1)
    nodes = written(members.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "vectors")
    sizes = nodes.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    dealt = (nodes.withColumn("dim", F.size("x")).join(sizes, "dim")
             .select("dim", F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / shard)).cast("int").alias("shard"), "x", "members"))

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])
        dim = table.column("dim")[0].as_py()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        built = build(x)
        held = table.column("members").combine_chunks()
        upper = [np.concatenate([np.full((len(at), 1), layer), at[:, None], links[at]], 1).astype(np.int32).reshape(-1)
                 for layer, links in enumerate(built.links) if layer for at in [np.flatnonzero((links >= 0).any(1))]]
        values = (table.column("shard")[0].as_py(), dim, held.flatten().to_numpy(), held.value_lengths().to_numpy().cumsum(), x.reshape(-1), built.links[0].reshape(-1),
                  np.concatenate(upper) if upper else np.zeros(0, np.int32), built.entry)
        return pa.table({name: pa.array([value], kind) for (name, kind), value in zip(SCHEMA.items(), values, strict=True)})

    return written(dealt.withColumn("first", F.col("members")[0]).groupBy("dim", "shard").applyInArrow(graph, INDEX), "graphs")


SCHEMA = {"shard": pa.int32(), "dim": pa.int32(), "members": pa.list_(pa.int64()), "ends": pa.list_(pa.int32()), "vectors": pa.list_(pa.float64()), "base": pa.list_(pa.int32()),
          "upper": pa.list_(pa.int32()), "entry": pa.int32()}


def loaded(row: dict[str, np.ndarray], dim: int, entry: int) -> tuple[np.ndarray, Graph]:
    x = row["vectors"].reshape(-1, dim)
    n = len(x)
    links = [row["base"].reshape(n, -1)]
    records = row["upper"].reshape(-1, LINKS + 2)
    for layer in range(1, int(records[:, 0].max(initial=0)) + 1):
        full = np.full((n, LINKS), -1, np.int32)
        part = records[records[:, 0] == layer]
        full[part[:, 1]] = part[:, 2:]
        links.append(full)
    return x, Graph(lifted(x), links, entry)


def nearest_of(queries: DataFrame, graphs: DataFrame, nearest: int = NEAREST, width: int = SEARCH_WIDTH, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` found of every query row (vec_id, x), merged over all shards.

    Queries go in blocks to every shard of their dimension: one row of a block meets one row of a graph."""
    spread = max(1, -(-queries.count() // block))
    blocks = (queries.withColumn("dim", F.size("x")).groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(spread)).alias("block"))
              .agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("x")).alias("q")))
    shards = graphs.groupBy("dim").agg(F.max("shard").alias("last"))
    sent = blocks.join(shards, "dim").select("dim", "ids", "q", F.explode(F.sequence(F.lit(0), "last")).alias("shard"))
    pairs = graphs.join(sent, ["dim", "shard"]).select("dim", "entry", "members", "ends", "vectors", "base", "upper", "ids", "q", "shard")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple[int, int], np.ndarray, Graph] | None = None
        for batch in source:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values.to_numpy() for name in ("members", "ends", "vectors", "base", "upper", "ids", "q")}
                dim, shard = batch.column("dim")[i].as_py(), batch.column("shard")[i].as_py()
                if held is None or held[0] != (dim, shard):
                    held = ((dim, shard), *loaded(row, dim, batch.column("entry")[i].as_py()))
                ids, q = row["ids"], row["q"].reshape(-1, dim)
                for low in range(0, len(ids), AT_ONCE):
                    yield merged(ids[low:low + AT_ONCE], q[low:low + AT_ONCE], held[1], held[2], row["members"], row["ends"], nearest, width)

    found = pairs.mapInArrow(batches, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def merged(ids: np.ndarray, q: np.ndarray, x: np.ndarray, graph: Graph, members: np.ndarray, ends: np.ndarray, nearest: int, width: int) -> pa.RecordBatch:
    """The best ``nearest`` ids of one shard for each query, without the query's own."""
    nodes = answers(graph, q, max(width, nearest + 1))
    score = np.where(nodes >= 0, products(q, x[nodes]), -np.inf)
    begin = np.concatenate([[0], ends])
    keep = np.argsort(-score, 1, kind="stable")[:, :width]
    nodes, score = np.take_along_axis(nodes, keep, 1), np.take_along_axis(score, keep, 1)
    at, place = np.nonzero(nodes >= 0)
    node = nodes[at, place]
    count = begin[node + 1] - begin[node]
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, points = np.repeat(at, count), np.repeat(score[at, place], count)
    found = members[np.repeat(begin[node], count) + offset]
    others = found != ids[at]
    at, points, found = at[others], points[others], found[others]
    order = np.lexsort((found, -points, at))
    at, points, found = at[order], points[order], found[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    top = rank < nearest
    return pa.RecordBatch.from_arrays([pa.array(ids[at[top]]), pa.array(found[top]), pa.array(points[top])], ["query_id", "vec_id", "score"])


def neighbours(df: DataFrame, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The nearest of every row whose id is divisible by ``every``, among all others.

    Rows without an id and vectors that are null, empty, zero or hold null or non-finite components take no part; a
    vector is compared with those of its own length; an id counts once, with the smallest of its vectors. Columns other
    than key and vector are ignored, an empty table gives an empty result."""
    rows = written(prepared(df, key, vector), "prepared")
    return nearest_of(rows.filter(F.col("vec_id") % every == 0), index(rows))
