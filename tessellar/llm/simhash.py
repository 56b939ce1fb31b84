"""SimHash near-duplicates with vantage-point trees.

A document's fingerprint has a bit set if over half the 64-bit hashes of its word shingles
have it set. Equal fingerprints are grouped before anything else. A vantage-point tree
built from a bounded sample then cuts the fingerprints into shards: each node sends what
lies within its radius of the vantage point left and the rest right. Every fingerprint has
one home shard; by the triangle inequality only those within the link distance of a
boundary can have partners beyond it, so these alone also visit the other side as
guests. Inside a shard the same construction goes on down to small leaves, pruning by the
same bounds, where distances are counted outright. All links of at most ``distance`` bits
are found. A shard returns only a spanning forest of its links; components are then
contracted across shards.

The sample grows with the number of fingerprints, ``POINTS`` for each shard, up to ``MAX_SAMPLE``
of them (64 MB), so shards keep their size up to MAX_SAMPLE / POINTS of them (10 billion fingerprints).

Null and empty texts have fingerprint zero, which links like any other. Null ids take
part, but a component's id is its smallest non-null one (null if it has none). Repeated
rows are linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessellar.llm.common import plain, settle, settle_table, ship, slices, small_batches, spread, unused
from tessellar.llm.graph import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Fingerprints at home in a shard, about, but MIN_SHARDS shards where they would hold MIN_SHARD or more.
SHARD, MIN_SHARD, MIN_SHARDS = 40_000, 1000, 64
#: Fingerprints sampled for the tree above the shards: for each shard, at least and at most.
POINTS, MIN_SAMPLE, MAX_SAMPLE = 32, 16_384, 8_000_000
LEAF = 256
BLOCK = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text, as an unsigned number."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    if n <= shingle:
        return h(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    count = n - shingle + 1
    for at in range(0, count, BLOCK):
        hashes = [h(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=False)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = plain(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(rows).mapInArrow(run, "doc_id long, fp long")


def _split(home: np.ndarray, distance: int) -> tuple[np.uint64, int]:
    """Vantage point and radius: of a few tried, the cut that most balances and least overlaps."""
    tried = home[np.linspace(0, len(home) - 1, 5).astype(int)]
    some = home[:: max(1, len(home) // 4096)]
    best = (np.inf, tried[0], 32)
    for point in tried:
        below = np.cumsum(np.bincount(np.bitwise_count(some ^ point), minlength=65))[:64] / len(some)
        band = below.copy()
        band[distance:] -= below[:-distance]
        cost = np.where((below >= 0.25) & (below <= 0.75), band + np.abs(below - 0.5) * 0.2, np.inf)
        radius = int(cost.argmin())
        best = min(best, (float(cost[radius]), point, radius), key=lambda b: b[0])
    if best[0] == np.inf:  # no even cut: take the median of the first point
        d = np.sort(np.bitwise_count(some ^ tried[0]))
        best = (0.0, tried[0], int(min(d[len(d) // 2], d[-1] - 1)))
    return best[1], best[2]


def sample_size(total: int, shard: int = SHARD) -> int:
    """How many of ``total`` fingerprints the tree above the shards is grown from."""
    return min(MAX_SAMPLE, max(MIN_SAMPLE, POINTS * -(-total // shard)))


class ShardTree:
    """The vantage-point tree above the shards: home shard and visited shards of fingerprints.

    Nodes are kept as arrays (17 bytes each); a child below zero is shard -1 - child.
    """

    def __init__(self, sample: np.ndarray, total: int, shard: int = SHARD, distance: int = DISTANCE):
        self.distance, self.leaves = distance, 0
        points, radii, children = [], [], []
        most = max(shard * len(sample) / max(1, total), 16)  # sample points of a shard
        todo: list[tuple[np.ndarray, int, int]] = [(sample, -1, 0)]  # points, parent, which child
        self.root = 0
        while todo:
            own, parent, which = todo.pop()
            name = -1 - self.leaves
            if len(own) > most:
                point, radius = _split(own, distance)
                inside = np.bitwise_count(own ^ point) <= radius
                if inside.any() and not inside.all():
                    name = len(points)
                    points.append(point)
                    radii.append(radius)
                    children.append([0, 0])
                    todo += [(own[inside], name, 0), (own[~inside], name, 1)]
            if name < 0:
                self.leaves += 1
            if parent < 0:
                self.root = name
            else:
                children[parent][which] = name
        self.points, self.radii = np.array(points, np.uint64), np.array(radii, np.int8)
        self.children = np.array(children, np.int32).reshape(-1, 2)

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(shard, positions in ``fps``, whether at home there)."""
        stack = [(self.root, np.arange(len(fps)), True)]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at, home
                continue
            radius, (left, right) = int(self.radii[node]), self.children[node].tolist()
            d = np.bitwise_count(fps[at] ^ self.points[node]).astype(np.int64)
            inside = d <= radius
            if home:
                # one side visits the other: of a linked pair the inner one goes out
                stack += [(left, at[inside], True), (right, at[~inside], True), (right, at[inside & (d > radius - self.distance)], False)]
            else:
                stack += [(left, at[d <= radius + self.distance], False), (right, at[d > radius - self.distance], False)]


class _Forest:
    """Union of pairs of positions; labels are the least position of each component."""

    def __init__(self, n: int):
        self.label, self.held, self.size = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        differ = la != lb
        if differ.any():
            self.held.append((la[differ], lb[differ]))
            self.size += int(differ.sum())
            if self.size > 500_000:
                self.flush()

    def flush(self) -> np.ndarray:
        if self.held:
            a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.size, label = [], 0, self.label
            while True:
                la, lb = label[a], label[b]
                differ = la != lb
                if not differ.any():
                    break
                a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while True:
                    up = label[label]
                    if (up == label).all():
                        break
                    label[:] = up
        return self.label


def _count_out(fps: np.ndarray, query: np.ndarray, home: np.ndarray, distance: int, forest: _Forest) -> None:
    for at in range(0, len(query), step := max(1, 2_000_000 // max(1, len(home)))):
        q = query[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fps[q][:, None] ^ fps[home][None, :]) <= distance)
        forest.add(q[i], home[j])


def link(fps: np.ndarray, is_home: np.ndarray, distance: int = DISTANCE, leaf: int = LEAF) -> np.ndarray:
    """Component label of each fingerprint over all links with a home fingerprint in them."""
    forest = _Forest(len(fps))
    # (home, query, whether the queries are the homes themselves)
    stack = [(np.nonzero(is_home)[0], np.nonzero(is_home)[0], True), (np.nonzero(is_home)[0], np.nonzero(~is_home)[0], False)]
    while stack:
        home, query, same = stack.pop()
        if not len(home) or not len(query):
            continue
        if len(home) <= leaf or len(query) <= 8:
            _count_out(fps, query, home, distance, forest)
            continue
        point, radius = _split(fps[home], distance)
        d = np.bitwise_count(fps[home] ^ point).astype(np.int64)
        inside = d <= radius
        if inside.all() or not inside.any():
            _count_out(fps, query, home, distance, forest)
            continue
        left, right = home[inside], home[~inside]
        if same:
            stack += [(left, left, True), (right, right, True), (right, home[inside & (d > radius - distance)], False)]
            continue
        d = np.bitwise_count(fps[query] ^ point).astype(np.int64)
        q_left, q_right = query[d <= radius + distance], query[d > radius - distance]
        if len(home) <= 16 * leaf and len(q_left) + len(q_right) > 1.8 * len(query):
            _count_out(fps, query, home, distance, forest)  # the bounds prune nothing here
            continue
        stack += [(left, q_left, False), (right, q_right, False)]
    return forest.flush()


def links(fps: DataFrame, distance: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of all links."""
    ship(fps.sparkSession)
    total = fps.count()
    shard = min(shard, max(MIN_SHARD, total // MIN_SHARDS))
    share = min(1.0, sample_size(total, shard) / max(1, total))
    drawn = fps.filter(F.pmod(F.xxhash64("fp", F.lit("shards")), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toArrow()
    sample = np.sort(drawn.column("fp").to_numpy()).view(np.uint64)
    tree = fps.sparkSession.sparkContext.broadcast(ShardTree(sample, total, shard, distance))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            met = [*tree.value.route(fp.view(np.uint64))]
            if met:
                at, sizes = np.concatenate([at for _, at, _ in met]), [len(at) for _, at, _ in met]
                shards, homes = np.repeat([no for no, _, _ in met], sizes), np.repeat([home for _, _, home in met], sizes)
                yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(shards.astype(np.int64)), pa.array(homes)], ["fp", "shard", "home"])

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp", ignore_index=True)
        fp = pdf["fp"].to_numpy()
        label = link(fp.view(np.uint64), pdf["home"].to_numpy(), distance)
        at = np.nonzero(label != np.arange(len(fp)))[0]
        return pd.DataFrame({"u": fp[at], "v": fp[label[at]]})

    return fps.select("fp").mapInArrow(visits, "fp long, shard long, home boolean").groupBy("shard").applyInPandas(within, "u long, v long")


def components_of(fps: DataFrame, distance: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """``fps`` (distinct fp and more) with root, the component's least fingerprint."""
    stars = components(links(fps, distance, shard)).withColumnsRenamed({"node": "fp"})
    return fps.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row."""
    docs = settle(fingerprints(df, doc_id, text))
    fps = settle(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = components_of(fps, distance, shard)
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(roots, "root").select("fp", "component_id")
    return docs.join(by_fp, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """The rows of ``df`` with one row of each group left: that of the smallest id.

    Rows count one by one, so rows that share an id stay if their texts lie in different
    groups, and rows without id are kept if their group has none with. Of rows of one
    group and id, the one whose text's, then whose columns' hash is least stays.
    """
    columns, spark = df.columns, df.sparkSession
    ship(spark)
    small_batches(spark)
    rows, found = [unused(columns, n) for n in ("row", "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text)
        for batch in slices(batches):
            fp = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*batch.schema.names, found])

    marked = df.mapInArrow(run, StructType([*df.schema.fields, StructField(found, LongType())]))
    # written with its row numbers, which then stay the same for the choice and for the result
    table = settle_table(marked.withColumn(rows, F.monotonically_increasing_id()))
    named = F.col(f"`{doc_id}`").cast("long")
    others = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns if c != text] or [F.lit(0)])))
    place = F.struct(named.isNull().alias("nameless"), named.alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("t"), others.alias("o"), F.col(rows).alias("row"))
    fps = settle(table.groupBy(F.col(found).alias("fp")).agg(F.min(place).alias("first")))
    kept = components_of(fps, distance, shard).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("kept"))
    return table.join(settle(kept), F.col(rows) == F.col("kept"), "left_semi").select(*[F.col(f"`{c}`") for c in columns])
