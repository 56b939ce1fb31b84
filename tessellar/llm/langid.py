"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter's largest
response in a fixed-length window goes through a rectifier into a softmax over the
languages. The network is trained in numpy on a bounded sample of labelled rows (the
driver holds at most ``MAX_ROWS`` times ``WINDOWS`` windows of ``LENGTH`` characters); the
softmax is over the ``MAX_LANGUAGES`` most frequent labels, which bounds the network.
Prediction cuts the whole text into windows, all of them, and averages their
probabilities by the letters they hold. For speed the embedding and the filters are
folded into tables over byte pairs, which changes no response.

Null texts and texts without letters are ``und`` with score 0; so is everything if no
labelled row exists. Ties go to the language that sorts first. Repeated rows give
repeated results; an empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import crc_bucket, plain, ship, slices, small_batches, spread

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: The fit sample: rows a language, windows a row, rows in all, and languages.
ROWS_PER_LANGUAGE = 800
WINDOWS = 3
MAX_ROWS = 4000
MAX_LANGUAGES = 500
EPOCHS = 8
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that belong to letters: ASCII letters and all of multi-byte characters.
_IS_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass
class Network:
    """Weights of a trained network: embedding, filters by width, their bias, output layer."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, tables over byte pairs (and a last byte) that add up to its responses."""
        made = []
        for w in self.filters:
            single = [(self.embed @ w[j]).astype(np.float32) for j in range(len(w))]
            pairs = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(w) - 1, 2)]
            made.append(pairs + ([single[-1]] if len(w) % 2 else []))
        return made


def windows_of(text: str) -> np.ndarray:
    """The whole text as rows of LENGTH bytes, lower case, the last filled with blanks."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    return np.frombuffer(raw + b" " * (-len(raw) % LENGTH), np.uint8).reshape(-1, LENGTH)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network | None:
    """Fit on short labelled texts; each is cut to its first window. None without labels."""
    keep = [i for i, t in enumerate(texts) if _LETTER.search(t)]
    if not keep:
        return None
    languages = sorted({labels[i] for i in keep})
    x = np.stack([windows_of(texts[i])[0] for i in keep])
    y = np.array([languages.index(labels[i]) for i in keep])
    rng = np.random.default_rng(seed)
    n_out = FILTERS * len(WIDTHS)
    p = [rng.normal(0, 0.5, (256, EMBED)), *[rng.normal(0, 0.5 / np.sqrt(w), (w, EMBED, FILTERS)) for w in WIDTHS]]
    p += [np.zeros(n_out), rng.normal(0, 0.2, (n_out, len(languages))), np.zeros(len(languages))]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    weight = (len(y) / len(languages)) / np.bincount(y, minlength=len(languages))[y]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            pick = order[at : at + 64]
            xb, yb, n = x[pick], y[pick], len(pick)
            emb, best, pooled = p[0][xb], [], []
            for k, w in enumerate(WIDTHS):
                r = sum(emb[:, j : LENGTH - w + 1 + j] @ p[1 + k][j] for j in range(w))
                best.append(r.argmax(1))
                pooled.append(np.take_along_axis(r, best[-1][:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + p[-3]
            act = np.maximum(raw, 0)
            d = _softmax(act @ p[-2] + p[-1])
            d[np.arange(n), yb] -= 1
            d *= weight[pick][:, None] / n
            grad = [np.zeros_like(a) for a in p]
            grad[-1], grad[-2] = d.sum(0), act.T @ d + 1e-4 * p[-2]
            da = (d @ p[-2].T) * (raw > 0)
            grad[-3] = da.sum(0)
            rows = np.arange(n)[:, None]
            for k, w in enumerate(WIDTHS):
                g = da[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    seen = xb[rows, best[k] + j]
                    grad[1 + k][j] = np.einsum("nfd,nf->df", p[0][seen], g)
                    np.add.at(grad[0], seen, g[:, :, None] * p[1 + k][j].T[None])
            t += 1
            for i, g in enumerate(grad):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(languages, p[0], p[1 : 1 + len(WIDTHS)], p[-3], p[-2], p[-1])


def respond(tables: list[list[np.ndarray]], net: Network, x: np.ndarray) -> np.ndarray:
    """Language probabilities of windows (rows of bytes)."""
    pooled = []
    pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
    for w, parts in zip(WIDTHS, tables, strict=True):
        n = LENGTH - w + 1
        r = parts[0][pair[:, :n]]
        for k, more in enumerate(parts[1:], 1):
            r += more[pair[:, 2 * k : 2 * k + n]] if len(more) > 256 else more[x[:, 2 * k : 2 * k + n]]
        pooled.append(r.max(1))
    act = np.maximum(np.concatenate(pooled, 1) + net.bias, 0)
    return _softmax(act @ net.out + net.out_bias)


def fit_sample(docs: DataFrame, trains: Column) -> tuple[list[str], list[str]]:
    """Windows and labels of a bounded sample of the rows (doc_id, text, lang) that ``trains`` admits."""
    known = docs.filter(trains & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return [], []
    each = min(ROWS_PER_LANGUAGE, max(1, MAX_ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2.0 * each / r["n"]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) / 1e6
    size = F.length("text")
    cuts = [F.substring("text", 1 + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(size - LENGTH, F.lit(1))).cast("int"), LENGTH) for k in range(WINDOWS)]
    rows = (
        known.withColumn("draw", draw)
        .filter(F.col("draw") < F.coalesce(share[F.col("lang")], F.lit(0.0)))
        .select("lang", "draw", "doc_id", F.array(*cuts).alias("cuts"))
        .orderBy("draw", "doc_id", "cuts")
        .limit(2 * each * len(counts) + 1000)
        .collect()
    )
    texts, labels, taken = [], [], dict.fromkeys([r["lang"] for r in counts], 0)
    for r in rows:
        if taken[r["lang"]] < each:
            taken[r["lang"]] += 1
            for cut in dict.fromkeys(r["cuts"]):
                texts.append(cut)
                labels.append(r["lang"])
    return texts, labels


def predict(df: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row's whole text."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables() if model else None
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for i, p in _probabilities(model, tables, texts):
                names[i], scores[i] = model.languages[int(p.argmax())], float(p.max())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    rows = plain(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(rows).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def _probabilities(model: Network | None, tables, texts: list[str | None], windows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(position, language probabilities) of the texts with letters, in blocks of windows."""
    if model is None:
        return
    total = {i: np.zeros(len(model.languages)) for i, t in enumerate(texts) if t and _LETTER.search(t)}
    held, owner, n = [], [], 0

    def block() -> None:
        x, at = np.concatenate(held), np.concatenate(owner)
        for s in range(0, len(x), windows):
            part = x[s : s + windows]
            p = respond(tables, model, part) * _IS_LETTER[part].sum(1)[:, None]
            for i, row in zip(at[s : s + windows].tolist(), p, strict=True):
                total[i] += row

    for i in total:
        x = windows_of(texts[i])
        held.append(x)
        owner.append(np.full(len(x), i))
        n += len(x)
        if n >= windows:
            block()
            held, owner, n = [], [], 0
    if n:
        block()
    for i, p in total.items():
        yield i, p / max(p.sum(), 1e-12)


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """Train on the rows outside the held-out fold, predict all: doc_id, held_out, lang_pred, score."""
    docs = plain(df, doc_id=doc_id, text=text, lang=lang)
    out = crc_bucket(F.col("doc_id"), held_out[0]) == held_out[1]
    net = train(*fit_sample(docs, ~out))
    return predict(docs, net).select("doc_id", out.alias("held_out"), "lang_pred", "score")


#: The pipeline rejects documents without letters, and those whose language stays a guess.
LEAST_SCORE = 0.4


def keep_identified(df: DataFrame, least: float = LEAST_SCORE, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` whose language is found with a score of at least ``least``.

    Rows stay as they are, repeated ones too; training leaves out the same fold as :func:`identify`.
    """
    net = train(*fit_sample(plain(df, doc_id=doc_id, text=text, lang=lang), crc_bucket(F.col("doc_id"), 4) != 2))
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables() if model else None
        at = None
        for batch in slices(batches):
            at = batch.schema.get_field_index(text) if at is None else at
            keep = np.zeros(batch.num_rows, bool)
            for i, p in _probabilities(model, tables, batch.column(at).to_pylist()):
                keep[i] = p.max() >= least
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
