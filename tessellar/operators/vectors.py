"""Vector operators: hashed embeddings, pooling, LSH search, clustering, topics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import IDF, BucketedRandomProjectionLSH, CountVectorizer, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.scalars import cosine
from tessellar.operators.relational import top_k
from tessellar.operators.settle import written
from tessellar.operators.text import chunks


def embed(docs: DataFrame, doc_id: str, text: str, dim: int = 64) -> DataFrame:
    """Deterministic stand-in for a sentence encoder: hashed words by chunk, mean-pooled, unit length.

    Chunks are pooled as vectors, so a document shuffles one row a task. A document without words has no row.
    """
    parts = docs.select(F.col(doc_id).alias("doc_id"), F.explode(chunks(F.col(text))).alias("chunk"))
    words = parts.select("doc_id", F.split(F.lower("chunk"), r"\s+").alias("words"))
    hashed = HashingTF(numFeatures=dim, inputCol="words", outputCol="tf").transform(words)
    level = Normalizer(inputCol="tf", outputCol="u").transform(hashed)
    pooled = level.groupBy("doc_id").agg(Summarizer.mean(F.col("u")).alias("v"))
    return Normalizer(inputCol="v", outputCol="e").transform(pooled).select("doc_id", vector_to_array("e").alias("embedding"))


def centroid(df: DataFrame, keys: list[str], embedding: str) -> DataFrame:
    """Mean vector of each key, pooled as vectors; null vectors take no part."""
    rows = df.filter(F.col(embedding).isNotNull()).select(*keys, array_to_vector(F.transform(embedding, lambda x: x.cast("double"))).alias("__v"))
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias("centroid"))


#: Buckets are joined if their pairs are at most so many a row, or so many times fewer than all pairs (about what a
#: joined pair needs in bytes against one of a block); else blocks of rows and queries are compared.
PAIRS_A_ROW, PAIRS_SAVED = 16, 400
#: Rows of a block, queries of a block, and queries compared at once.
BLOCK_ROWS, BLOCK_QUERIES, BATCH_QUERIES = 8192, 8192, 256


def lsh_neighbours(df: DataFrame, key: str, embedding: str, k: int = 10, every: int = 20, width: float = 1.0, tables: int = 8, seed: int = 42) -> DataFrame:
    """Approximate neighbours by random projections: query rows (key divisible by ``every``) against all rows.

    Candidates share a bucket in one of the tables and are ranked by cosine, ties by key.
    Fine buckets are joined on (table, bucket). Where most pairs share a bucket, joined pairs
    would fill the disks; blocks of queries then meet blocks of rows, a pair counts if its
    bucket lists agree somewhere, and a block leaves k rows a query. Both ways give the same
    rows. Null keys and null vectors take no part; of a key's several vectors the least counts.
    """
    rows = df.select(F.col(key).alias("key"), F.col(embedding).alias("e")).filter("key is not null and e is not null")
    vector = array_to_vector(F.col("e")).alias("v")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(rows.select(vector))
    rows = rows.groupBy("key").agg(F.min("e").alias("e")).select("key", "e", vector)
    hashed = written(model.transform(rows).select("key", "e", F.transform("h", lambda x: vector_to_array(x)[0]).alias("s")))
    is_query = F.col("key") % every == 0
    buckets = hashed.select("key", F.posexplode("s").alias("t", "b")).groupBy("t", "b").agg(F.count("*").cast("double").alias("n"), F.count_if(is_query).alias("asked"))
    pairs = buckets.agg(F.sum(F.col("n") * F.col("asked"))).first()[0] or 0.0
    n, n_asked = hashed.count(), hashed.filter(is_query).count()
    asked = hashed.filter(is_query).select(F.col("key").alias("query_id"), F.col("e").alias("q"), F.col("s").alias("sq"))
    if pairs <= max(PAIRS_A_ROW * n, n * n_asked / PAIRS_SAVED):
        near = _by_bucket(hashed, asked)
    else:
        near = _by_block(hashed, asked, k, max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_asked // BLOCK_QUERIES)))
    return top_k(near, ["query_id"], k, F.desc("score"), F.col("neighbour_id"))


def _by_bucket(hashed: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, neighbour_id and score of all pairs that share a bucket, each made in the first table where they do."""
    left, right = asked.select("*", F.posexplode("sq").alias("t", "b")), hashed.select("*", F.posexplode("s").alias("t", "b"))
    first = F.array_position(F.zip_with("sq", "s", lambda x, y: x == y), True) == F.col("t") + 1
    pairs = left.join(right, ["t", "b"]).filter("key <> query_id").filter(first)
    return pairs.select("query_id", F.col("key").alias("neighbour_id"), cosine(F.col("q"), F.col("e")).alias("score"))


def _by_block(hashed: DataFrame, asked: DataFrame, k: int, row_blocks: int, query_blocks: int) -> DataFrame:
    """As :func:`_by_bucket`, but of each block of rows only a query's first k.

    A matrix product bounds the scores; what may be among the first k is scored again, summed
    component by component as :func:`cosine` does, so that equal vectors tie.
    """
    batch = BATCH_QUERIES

    def matrix(column: pd.Series) -> np.ndarray:
        return np.stack(column.to_list()).astype(np.float64)

    def marks(column: pd.Series) -> np.ndarray:
        s = matrix(column) + 0.0  # one zero and one NaN, as in a join
        s[np.isnan(s)] = np.nan
        return s.view(np.int64)

    def dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        for c in range(a.shape[1]):
            out += a[i, c] * b[j, c]
        return out

    def compare(rows: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": ask["query_id"][:0], "neighbour_id": rows["key"][:0], "o": np.zeros(0)})]
        if not len(rows) or not len(ask):
            return out[0]
        rows = rows.sort_values("key", ignore_index=True)
        ids, x, sx = rows["key"].to_numpy(), matrix(rows["e"]), marks(rows["s"])
        with np.errstate(all="ignore"):
            xx = dots(x, x, np.arange(len(x)), np.arange(len(x)))
        for at in range(0, len(ask), batch):
            part = ask[at : at + batch]
            query, y, sy = part["query_id"].to_numpy(), matrix(part["q"]), marks(part["sq"])
            with np.errstate(all="ignore"):
                yy = dots(y, y, np.arange(len(y)), np.arange(len(y)))
                size = np.sqrt(yy)[:, None] * np.sqrt(xx)[None, :]
                shares = np.zeros(size.shape, bool)
                for t in range(sx.shape[1]):
                    shares |= sy[:, t][:, None] == sx[:, t][None, :]
                shares &= query[:, None] != ids[None, :]
                # products of very large or small vectors are not trusted
                sure = [(v == 0) | (v > 1e-200) & (v < 1e200) for v in (yy, xx)]
                sure = sure[0][:, None] & sure[1][None, :]
                about = np.where(shares & sure & (size != 0), (y @ x.T) / size, -np.inf)
                least = np.partition(about, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(y), -np.inf)
                i, j = np.nonzero(shares & ((about >= least[:, None] - 1e-9) | ~sure))
                o = dots(y, x, i, j) / size[i, j]
            # as Spark orders: not a number first, null (of a zero vector) last
            o = np.where(size[i, j] == 0, -np.inf, np.where(np.isnan(o), np.inf, o))
            order = np.lexsort((j, -o, i))
            i, j, o = i[order], j[order], o[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pd.DataFrame({"query_id": query[i[kept]], "neighbour_id": ids[j[kept]], "o": o[kept]}))
        return pd.concat(out, ignore_index=True)

    def numbers(blocks: int) -> Column:  # long, as the hashes are: both sides must deal alike
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    left = hashed.select("*", F.pmod(F.xxhash64("key"), F.lit(row_blocks)).alias("r"), numbers(query_blocks).alias("c"))
    right = asked.select("*", numbers(row_blocks).alias("r"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("c"))
    kind = hashed.schema["key"].dataType.simpleString()
    near = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(compare, f"query_id {kind}, neighbour_id {kind}, o double")
    score = F.when(F.col("o") == float("inf"), float("nan")).when(F.col("o") > float("-inf"), F.col("o"))
    return near.select("query_id", "neighbour_id", score.alias("score"))


#: Query vectors that an exact search takes at once.
MAX_QUERIES = 1000


def exact_topk(df: DataFrame, key: str, embedding: str, queries: DataFrame, k: int = 20, least: float | None = None) -> DataFrame:
    """query, key, score and rank of the k most similar rows by cosine, for a stated set of queries (query, vector).

    The queries meet the rows in blocks of about MAX_QUERIES, each block is broadcast and
    takes one scan; a task keeps k rows a query before the shuffle. Scores are compared to
    nine digits, ties by key. Rows of one query id belong to one query.
    """
    queries = queries.select("query", "vector")
    blocks = max(1, -(-queries.count() // MAX_QUERIES))
    if blocks > 1:
        queries = written(queries)
    rows = df.select(F.col(key).alias("key"), F.col(embedding).alias("e"))
    out = None
    for i in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) if blocks > 1 else queries
        met = rows.crossJoin(F.broadcast(part)).withColumn("score", cosine(F.col("vector"), F.col("e"))).filter("score is not null")
        if least is not None:
            met = met.filter(F.col("score") >= least)
        best = top_k(met.select("query", "key", "score", F.floor(F.col("score") * 1e9).alias("o")), ["query"], k, F.desc("o"), F.col("key")).drop("o")
        out = best if out is None else out.unionByName(best)
    return out


def kmeans(df: DataFrame, key: str, embedding: str, k: int, seed: int = 42) -> DataFrame:
    """Cluster of each row."""
    rows = df.select(F.col(key).alias("key"), array_to_vector(F.col(embedding)).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(rows).transform(rows).select("key", F.col("prediction").alias("cluster"))


def topics(docs: DataFrame, doc_id: str, text: str, k: int, words: int = 4000, seed: int = 42) -> DataFrame:
    """Main topic and its probability of each document; an approximation of embedding-based topic models."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), lambda w: F.length(w) >= 4).alias("words"))
    counts = CountVectorizer(inputCol="words", outputCol="tf", vocabSize=words, minDF=5.0).fit(rows).transform(rows)
    weighted = IDF(inputCol="tf", outputCol="features").fit(counts).transform(counts)
    model = LDA(k=k, seed=seed, maxIter=5, optimizer="online").fit(weighted)
    shares = model.transform(weighted).select("doc_id", vector_to_array("topicDistribution").alias("p"))
    return shares.select("doc_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("topic"), F.array_max("p").alias("probability"))
