"""Toxicity with a linear-chain conditional random field.

Tokens are runs of letters. Training starts from documents marked toxic or not: word and
word-beginning features surely more frequent in toxic documents (a bound on chance over all
features tested) label the tokens of toxic documents that carry them; all other tokens are labelled clean. A two-state chain is
fitted to these labelled tokens by its conditional likelihood. Forward and backward
passes, run as ratios of the two states over many documents at once, give each token's
marginal; a document's score is a logistic function, fitted on the training documents,
of its expected number of toxic tokens, its highest marginal and its length. Tokens with a
marginal of at least 0.5 are the offending spans.

The fit sample is bounded: ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents of at most
``MAX_CHARS`` characters, weighted back to the classes' true shares. All their tokens train
the chain, in stretches of ``STRETCH`` tokens. Scoring reads whole texts.

Null and empty texts have no tokens and still get a score. Without labels of both classes
all scores are 0. Repeated rows give repeated results; an empty table an empty result;
ids with labels of both kinds count for both; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import crc_bucket, plain, ship, slices, small_batches, spread

MAX_TOXIC, MAX_CLEAN = 800, 1600
MAX_CHARS = 12_000
STRETCH = 400
#: Expected number of features that are marked by chance alone.
CHANCE = 0.05
PREFIXES = (3, 4, 5, 6, 7)
MAX_FEATURES = 40_000
STEPS = 25
MEMO_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word in lower case, and its beginnings."""
    w = word.lower()
    return [w, *("^" + w[:k] for k in PREFIXES if len(w) > k)]


class _Emissions(dict):
    """Log odds of the toxic state by word, bounded in size."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def __missing__(self, word: str) -> float:
        e = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        e = min(15.0, max(-15.0, e))
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = e
        return e


@dataclass
class Chain:
    """Weights of the two-state chain and of the document score."""

    weights: dict[str, float]
    bias: float
    moves: np.ndarray  # log potentials, from state (clean, toxic) to state
    score: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def emissions(self) -> _Emissions:
        return _Emissions(self.weights, self.bias)


def _passes(e: np.ndarray, active: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic to clean) of padded columns, longest first, and exp(e).

    ``active[t]`` columns are longer than t.
    """
    a = np.exp(moves)
    x = np.exp(e)
    fwd, bwd = np.zeros_like(x), np.ones_like(x)
    fwd[0] = x[0]
    for t in range(1, len(x)):
        n = active[t]
        r = fwd[t - 1, :n]
        fwd[t, :n] = x[t, :n] * (r * a[1, 1] + a[0, 1]) / (r * a[1, 0] + a[0, 0])
    for t in range(len(x) - 2, -1, -1):
        n = active[t + 1]
        s = x[t + 1, :n] * bwd[t + 1, :n]
        bwd[t, :n] = (a[1, 0] + a[1, 1] * s) / (a[0, 0] + a[0, 1] * s)
    return fwd, bwd, x


def _padded(rows: list[np.ndarray], fill: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows, longest first, as columns, and the number of columns longer than each t."""
    sizes = np.array([len(r) for r in rows])
    m = np.full((sizes[0], len(rows)), fill)
    for i, r in enumerate(rows):
        m[: len(r), i] = r
    return m, np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")


def marginals(rows: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Marginal of the toxic state of every token, for rows of emissions."""
    out: list[np.ndarray] = [np.zeros(0)] * len(rows)
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: -len(rows[i]))
    at = 0
    while at < len(order):  # rows of like length together, so padding at most doubles them
        most, end = len(rows[order[at]]), at
        while end < len(order) and len(rows[order[end]]) * 2 >= most and (end - at) * most <= 2_000_000:
            end += 1
        group = [rows[i] for i in order[at:end]]
        e, active = _padded(group, 0.0)
        fwd, bwd, _ = _passes(e, active, moves)
        odds = fwd * bwd
        m = odds / (1.0 + odds)
        for k, i in enumerate(order[at:end]):
            out[i] = m[: len(rows[i]), k]
        at = end
    return out


def _evidence(c1: int, c0: int, n1: int, n0: int) -> float:
    """How surely a feature met in ``c1`` toxic and ``c0`` clean documents is no chance (Chernoff: the chance is at most exp of minus this)."""
    n, q = c1 + c0, n1 / (n1 + n0)
    return c1 * math.log(c1 / (n * q)) + (c0 * math.log(c0 / (n * (1 - q))) if c0 else 0.0)


def _mark(ids: list[np.ndarray], of_word: list[list[str]], toxic: list[bool]) -> set[str]:
    """Features far more frequent in toxic documents than in clean ones, and not by chance.

    Of many thousand rare words some stand in toxic documents only, by chance; CHANCE is the
    number of such features let in, over all tested. Where a small sample makes no feature
    that sure, the surest are taken.
    """
    seen = (Counter(), Counter())
    for row, y in zip(ids, toxic, strict=True):
        seen[y].update({f for w in np.unique(row).tolist() for f in of_word[w]})
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    sure = {f: _evidence(c, seen[0][f], n1, n0) for f, c in seen[1].items() if c >= 2 and (c + 0.5) / (n1 + 1) > 4.0 * (seen[0][f] + 0.5) / (n0 + 1)}
    least = min(math.log(len(seen[0] | seen[1]) / CHANCE), max(sure.values(), default=0.0)) if sure else 0.0
    return {f for f, e in sure.items() if e >= least}


def train(texts: list[str], toxic: list[bool], share: float, steps: int = STEPS) -> Chain | None:
    """Fit chain and score; ``share`` is the toxic share among all labelled training documents."""
    if not any(toxic) or all(toxic):
        return None
    vocabulary: dict[str, int] = {}
    whole = [np.array([vocabulary.setdefault(w.lower(), len(vocabulary)) for w in _WORD.findall(t)], np.int32) for t in texts]
    of_word = [features(w) for w in vocabulary]
    marked = _mark(whole, of_word, toxic)
    # stretches of all documents, the longest first: (document, tokens)
    cuts = [(i, row[at : at + STRETCH]) for i, row in enumerate(whole) for at in range(0, len(row), STRETCH)]
    cuts.sort(key=lambda c: -len(c[1]))
    if not cuts:
        return None
    order, ids = [i for i, _ in cuts], [row for _, row in cuts]
    count = Counter(f for fs in of_word for f in fs)
    kept = {f: k for k, (f, _) in enumerate(sorted(((f, c) for f, c in count.items() if c > 1 or f in marked), key=lambda x: (x[0] not in marked, -x[1], x[0]))[:MAX_FEATURES])}
    pairs = np.array([(w, kept[f]) for w, fs in enumerate(of_word) for f in fs if f in kept], np.int32).reshape(-1, 2)
    hit = np.array([any(f in marked for f in fs) for fs in of_word])
    sizes = np.array([len(r) for r in ids])
    grid = np.zeros((sizes[0], len(ids)), np.int32)
    gold = np.zeros(grid.shape)
    for k, (r, i) in enumerate(zip(ids, order, strict=True)):
        grid[: len(r), k] = r
        gold[: len(r), k] = hit[r] * toxic[i]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    inside = np.arange(sizes[0])[:, None] < sizes[None, :]
    weight = np.array([share / np.mean(toxic) if toxic[i] else (1 - share) / (1 - np.mean(toxic)) for i in order])
    n = inside.sum()
    w, bias, moves = np.zeros(len(kept)), -4.0, np.zeros((2, 2))
    for f, k in kept.items():
        w[k] = 2.0 if f in marked else 0.0
    state = [np.zeros(len(kept) + 5), np.zeros(len(kept) + 5)]
    for step in range(1, steps + 1):
        e_word = np.clip(bias + np.bincount(pairs[:, 0], w[pairs[:, 1]], len(of_word)), -15, 15)
        fwd, bwd, x = _passes(np.where(inside, e_word[grid], 0.0), active, moves)
        odds = fwd * bwd
        miss = np.where(inside, odds / (1 + odds) - gold, 0.0) * weight
        by_word = np.bincount(grid.ravel(), miss.ravel(), len(of_word))
        g_w = np.bincount(pairs[:, 1], by_word[pairs[:, 0]], len(kept))
        a = np.exp(moves)
        later = inside[1:]
        f0, s1 = fwd[:-1], (x * bwd)[1:]
        joint = (np.full(f0.shape, a[0, 0]), a[0, 1] * s1, f0 * a[1, 0], f0 * a[1, 1] * s1)
        whole_mass, y0, y1 = sum(joint), gold[:-1], gold[1:]
        seen = ((1 - y0) * (1 - y1), (1 - y0) * y1, y0 * (1 - y1), y0 * y1)
        g_m = np.array([((j / whole_mass - s) * later).sum(0) @ weight for j, s in zip(joint, seen, strict=True)])
        g = np.concatenate([g_w, [by_word.sum()], g_m]) / n * 100
        g[: len(kept)] += 1e-4 * w
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = 0.2 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, bias, moves = w - move[: len(kept)], bias - move[len(kept)], moves - move[len(kept) + 1 :].reshape(2, 2)
    chain = Chain({f: float(w[k]) for f, k in kept.items() if w[k]}, float(bias), moves)
    emit = chain.emissions()
    e_word = np.array([emit[w] for w in vocabulary])
    marks = marginals([e_word[row] for row in whole], moves)
    chain.score = _logistic(np.stack([_summary(m) for m in marks]), np.array(toxic, float), share)
    return chain


def _summary(m: np.ndarray) -> np.ndarray:
    """What the score looks at: 1, expected toxic tokens (log), highest marginal, length (log), share."""
    total = float(m.sum())
    return np.array([1.0, math.log1p(total), float(m.max(initial=0.0)), math.log1p(len(m)) / 5, math.log1p(100 * total / (len(m) + 20))])


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Weighted logistic regression by Newton steps, slightly shrunk."""
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + 0.1 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b))
        b = b - np.linalg.solve(h, g)
    return b


def fit_sample(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int]) -> tuple[list[str], list[bool], float]:
    """A bounded sample of labelled training documents, and the toxic share of all of them."""
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(crc_bucket(F.col("doc_id"), held_out[0]) != held_out[1])
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", F.lit("toxicity")).alias("draw"))
    )
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = []
    for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        drawn += [(r["doc_id"], y) for r in known.filter(F.col("toxic") == y).orderBy("draw", "doc_id").limit(most).collect()]
    if not drawn:
        return [], [], 0.0
    # at most MAX_TOXIC + MAX_CLEAN ids
    picked = F.broadcast(docs.sparkSession.createDataFrame(drawn, "picked long, toxic int"))
    rows = (
        docs.filter(F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS))
        .join(picked, F.col("doc_id").cast("long") == F.col("picked"))
        .select("picked", "toxic", "text")
        .orderBy(F.xxhash64("picked"), "toxic", "text")
        .limit(MAX_TOXIC + MAX_CLEAN)
        .collect()
    )
    return [r["text"] for r in rows], [bool(r["toxic"]) for r in rows], n.get(1, 0) / max(1, sum(n.values()))


SCORES = "doc_id long, score double, predicted int, spans string"


def score(df: DataFrame, chain: Chain | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted, and offending spans (start-end, comma-joined, code points) of every row."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        emit = model.emissions() if model else None
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            scores, spans = np.zeros(len(texts)), [""] * len(texts)
            if model:
                rows = [np.array([emit[w] for w in _WORD.findall(t)]) if t else np.zeros(0) for t in texts]
                marks = marginals(rows, model.moves)
                z = np.stack([_summary(m) for m in marks]) @ model.score
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                for i, m in enumerate(marks):
                    if len(m) and m.max() >= 0.5:
                        at = [(w.start(), w.end()) for w in _WORD.finditer(texts[i])]
                        spans[i] = ",".join(f"{at[k][0]}-{at[k][1]}" for k in np.nonzero(m >= 0.5)[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, pa.string())],
                ["doc_id", "score", "predicted", "spans"],
            )

    rows = plain(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(rows).mapInArrow(run, SCORES)


def tag(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """Train outside the held-out fold, score all: doc_id, held_out, score, predicted, spans."""
    docs = plain(docs, doc_id="doc_id", text="text")
    chain = train(*fit_sample(docs, plain(labels, doc_id="doc_id", toxic="toxic"), held_out))
    out = crc_bucket(F.col("doc_id"), held_out[0]) == held_out[1]
    return score(docs, chain).select("doc_id", out.alias("held_out"), "score", "predicted", "spans")
