"""Approximate nearest neighbours by learned partitions.

A bounded sample of the distinct vectors gives a neighbour graph. The graph is cut into
parts of equal size with few edges between them: bisected along the second eigenvector of
its normalised adjacency, again and again, and mended after each cut by swaps that save
edges. A small network learns to predict the parts of a vector's neighbours from the
vector alone. It then files every vector under its most probable part and routes each
query to its several most probable parts, where all vectors are compared exactly. The
number of routed parts is the smallest whose recall reaches ``SAMPLE_RECALL`` on sample
vectors that neither graph nor network have seen.

There are ``LEAST_PARTS`` parts or more, unless they would hold under ``LEAST_SIZE`` vectors.
Equal vectors form one class that is compared once; a class lists its smallest ids, as
many as a result can hold. Parts and their queries are compared in blocks of bounded size,
so neither a hot vector nor a hot part meets in one task.

Nearness is the inner product in double precision of the stored components. Vectors that
are null, zero, of another length than most, or hold null or non-finite components take no
part. Ties go to the smaller id. An id's repeated rows count once; an id with several
vectors counts with the least of them, compared by components; null ids take no part; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellar.llm.common import plain, settle, ship

#: The fit sample: vectors in all, and for each part; every HELD-th of them is kept out of graph and network.
SAMPLE, SAMPLE_OF_PART = 8192, 32
HELD = 8
#: Distinct vectors a part holds on average, up to MAX_PARTS parts; vectors and queries of a block.
PART = 5000
LEAST_PARTS, LEAST_SIZE, MAX_PARTS = 8, 16, 512
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 2048
GRAPH_K = 12
HIDDEN = 96
EPOCHS = 25
SAMPLE_RECALL = 0.95
SALTS = 64


@dataclass
class Router:
    """The trained network, and how many parts a query visits."""

    layers: list[np.ndarray]
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(_unit(x) @ w1 + b1, 0) @ w2 + b2


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each sample vector by inner product."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at : at + len(s)] = top
    return out


def _second_vector(rows: np.ndarray, cols: np.ndarray, n: int, rng: np.random.Generator, steps: int = 80) -> np.ndarray:
    """The second eigenvector of the graph's normalised adjacency, about, by power iteration."""
    root = np.sqrt(np.bincount(rows, minlength=n) + 1e-9)
    weight, first = 1.0 / (root[rows] * root[cols]), root / np.linalg.norm(root)
    v = rng.normal(size=n)
    for _ in range(steps):
        v = v - first * (first @ v)
        v = v + np.bincount(rows, weight * v[cols], n)  # plus itself, so that no eigenvalue is negative
        v /= np.linalg.norm(v) + 1e-30
    return v / root


def _bisect(rows: np.ndarray, cols: np.ndarray, n: int, left: int, rng: np.random.Generator) -> np.ndarray:
    """Which ``left`` of the n nodes go left: a cut along the eigenvector, then swaps that save edges."""
    side = np.ones(n, bool)
    side[np.argsort(_second_vector(rows, cols, n, rng), kind="stable")[:left]] = False
    for _ in range(12):
        across = np.bincount(rows, side[rows] != side[cols], n)
        gain = 2 * across - np.bincount(rows, minlength=n)
        a, b = np.nonzero(~side)[0], np.nonzero(side)[0]
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        better = int((gain[a[:m]] + gain[b[:m]] > 0).sum())
        if not better:
            break
        swap = max(1, better // 2)  # half of them, since neighbours may move, too
        tried = side.copy()
        tried[a[:swap]], tried[b[:swap]] = True, False
        if np.sum(tried[rows] != tried[cols]) >= np.sum(side[rows] != side[cols]):
            break
        side = tried
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """The part of each node: parts of equal size (but for one node), with few edges of the neighbour graph between them."""
    n, rng = len(graph), np.random.default_rng(seed)
    near = np.arange(n).repeat(graph.shape[1]), graph.ravel()
    rows, cols = np.concatenate(near), np.concatenate(near[::-1])
    label = np.zeros(n, int)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        nodes, first, count = todo.pop()
        if count < 2:
            label[nodes] = first
            continue
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        own = (place[rows] >= 0) & (place[cols] >= 0)
        half = count // 2
        right = _bisect(place[rows[own]], place[cols[own]], len(nodes), round(len(nodes) * half / count), rng)
        todo += [(nodes[~right], first, half), (nodes[right], first + half, count - half)]
    return label


def train(sample: np.ndarray, parts: int, k: int, seed: int = 11) -> Router:
    """Fit a router over ``parts`` parts to sample vectors; those held out choose how many parts to visit for ``k`` neighbours."""
    dim, rng = sample.shape[1], np.random.default_rng(seed)
    if parts < 2:
        return Router([np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    held = np.arange(len(sample)) % HELD == 0
    x, asked = sample[~held], sample[held]
    graph = _graph(x, min(GRAPH_K, len(x) - 1))
    label = balanced_parts(graph, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.arange(len(x))[:, None], label[graph]), 1.0)
    np.add.at(soft, (np.arange(len(x)), label), 2.0)
    soft /= soft.sum(1, keepdims=True)
    p = [rng.normal(0, 1.0, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, t, unit = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, _unit(x)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            b = order[at : at + 256]
            h = np.maximum(unit[b] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(1, keepdims=True))
            d = (e / e.sum(1, keepdims=True) - soft[b]) / len(b)
            dh = (d @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((unit[b].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * (g + 1e-4 * p[i])
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    router = Router(p, parts)
    # the part of each neighbour of the held-out vectors, by its place among the vector's parts
    ranked = np.argsort(-router.logits(asked), axis=1, kind="stable")
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(parts)[None, :].repeat(len(asked), 0), 1)
    at = np.take_along_axis(place, router.logits(x).argmax(1)[_nearest(asked, x, min(k, len(x)))], 1)
    reached = np.cumsum(np.bincount(at.ravel(), minlength=parts)) / at.size
    router.probes = min(parts, max(2, int(np.searchsorted(reached, SAMPLE_RECALL)) + 1))
    return router


def _nearest(asked: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of ``x`` by inner product."""
    if k >= len(x):
        return np.arange(len(x))[None, :].repeat(len(asked), 0)
    return np.argpartition(-(asked @ x.T), k - 1, axis=1)[:, :k]


def parts_for(total: int, part: int = PART) -> int:
    """How many parts ``total`` distinct vectors get."""
    return max(1, min(MAX_PARTS, max(LEAST_PARTS, math.ceil(total / part)), total // LEAST_SIZE))


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and embedding, one row an id, of the vectors that take part."""
    rows = plain(df, vec_id=vec_id, embedding=embedding).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = F.exists("embedding", lambda c: c != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & some)
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.filter(F.size("embedding") == (sizes[0]["n"] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def classes_of(vectors: DataFrame, most: int) -> DataFrame:
    """Distinct vectors: rep (smallest id), ids (the ``most`` smallest), embedding."""
    # a hot vector's ids are thinned in salted groups before they meet
    order = Window.partitionBy("embedding", "salt").orderBy("vec_id")
    rows = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, most)
    return rows.groupBy("embedding").agg(ids.alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "embedding")


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_list()).astype(np.float64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def search(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, every: int = 20, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest others of every row whose id is divisible by ``every``."""
    spark = df.sparkSession
    ship(spark)
    vectors = usable(df, vec_id, embedding)
    classes = settle(classes_of(vectors, k + 1))
    parts = parts_for(classes.count(), part)
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(max(SAMPLE, SAMPLE_OF_PART * parts)).select("embedding").toArrow()
    router = train(_matrix(sample.column("embedding").combine_chunks()), parts, k) if sample.num_rows else Router([], 1)
    shared = spark.sparkContext.broadcast(router)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home = shared.value.logits(_matrix(batch.column("embedding"))).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int64))], [*batch.schema.names, "part"])

    kind = classes.schema["embedding"].dataType.simpleString()
    filed = settle(classes.select("rep", "embedding").mapInArrow(file, f"rep long, embedding {kind}, part long"))
    asked = vectors.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("e"))
    asked = settle(asked.join(classes, F.col("e") == F.col("embedding")).select("query_id", "rep"))
    queries = filed.join(asked.select(F.col("rep").alias("r")).distinct(), F.col("rep") == F.col("r"), "left_semi").select("rep", "embedding")

    size = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect()}  # at most MAX_PARTS rows
    known = spark.sparkContext.broadcast(np.array([size.get(i, 0) for i in range(parts)]))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = shared.value.logits(_matrix(batch.column("embedding")))
            ranked = np.argsort(-z, axis=1, kind="stable")
            held = np.cumsum(known.value[ranked], axis=1)
            # the first probes, and further ones while too few vectors are in reach
            visit = (np.arange(z.shape[1])[None, :] < shared.value.probes) | (np.roll(held, 1, axis=1) < 4 * k) & (np.arange(z.shape[1]) > 0)[None, :]
            row, col = np.nonzero(visit & (known.value[ranked] > 0))
            picked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(ranked[row, col].astype(np.int64))], ["rep", "embedding", "part"])

    routed = settle(queries.mapInArrow(route, f"rep long, embedding {kind}, part long"))
    load = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    plan = [(p, math.ceil(n / BLOCK_VECTORS), math.ceil(load[p] / BLOCK_QUERIES)) for p, n in sorted(size.items()) if p in load]
    if not plan:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = F.broadcast(spark.createDataFrame(plan, "p long, v_blocks long, q_blocks long"))  # at most MAX_PARTS rows
    hashed = F.xxhash64("rep", F.lit("block"))
    left = (
        filed.join(blocks, F.col("part") == F.col("p"))
        .withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)))
        .select("rep", "embedding", "part", F.pmod(hashed, F.col("v_blocks")).alias("v"), "q")
    )
    right = (
        routed.join(blocks, F.col("part") == F.col("p"))
        .withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("v_blocks") - 1)))
        .select("rep", "embedding", "part", "v", F.pmod(hashed, F.col("q_blocks")).alias("q"))
    )

    def compare(vectors: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(ask):
            return pd.DataFrame({"query": pd.Series([], dtype="int64"), "minus": pd.Series([], dtype=object), "rep": pd.Series([], dtype=object)})
        vectors = vectors.sort_values("rep", ignore_index=True)
        x, rep = _matrix(vectors["embedding"]), vectors["rep"].to_numpy()
        y, query = _matrix(ask["embedding"]), ask["rep"].to_numpy()
        out = []
        for at in range(0, len(y), 256):
            s = y[at : at + 256] @ x.T
            n = min(len(x), k + 1 + 8)  # some more, since the exact sums below may reorder close ones
            top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(x) else np.tile(np.arange(len(x)), (len(s), 1))
            score = (x[top] * y[at : at + 256][:, None, :]).sum(2)
            keep = np.lexsort((rep[top], -score), axis=1)[:, : k + 1]
            top, score = np.take_along_axis(top, keep, 1), np.take_along_axis(score, keep, 1)
            out.append(pd.DataFrame({"query": query[at : at + 256], "minus": [*-score], "rep": [*rep[top]]}))
        return pd.concat(out, ignore_index=True)

    # one row a query and block, with its best classes; a query gathers at most (k + 1) of each
    near = left.groupBy("part", "v", "q").cogroup(right.groupBy("part", "v", "q")).applyInPandas(compare, "query long, minus array<double>, rep array<long>")
    hits = F.zip_with("minus", "rep", lambda m, r: F.struct(m.alias("minus"), r.alias("rep")))
    best = F.slice(F.array_sort(F.flatten(F.collect_list(hits))), 1, k + 1)
    near = near.groupBy("query").agg(best.alias("best")).select("query", F.explode("best").alias("hit")).select("query", "hit.minus", "hit.rep")
    # classes become ids: at most (k + 1) squared a query before they are cut to k + 1
    pairs = near.join(classes.select("rep", "ids"), "rep").select("query", "minus", F.explode("ids").alias("vec_id"))
    found = pairs.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("minus", "vec_id"))), 1, k + 1).alias("found"))
    others = F.slice(F.filter("found", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    hits = asked.join(found, F.col("rep") == F.col("query")).select("query_id", F.posexplode(others).alias("at", "hit"))
    return hits.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
