"""Mixing sources to target weights with the cube method.

Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3 ... and share all words.
A target stops at ``MAX_EPOCHS`` times its source's size; the excess is shared again by
weight. A source then takes every document floor(target / size) times, and once more with
the fractional rest as inclusion probability. The cube method settles those fractions:
its flight moves the probabilities of three documents at a time along the null space of
the two balancing constraints (words and documents of the source), so both totals stay as
they are until a document reaches 0 or 1. Flights run in blocks of bounded size, whose
few open documents meet again in the next round, until one block a source is left; its
last ``LANDING`` open documents are the landing problem, solved by trying all choices.
What whole documents cannot meet is taken as a part of one document of the source, if it
is over ``TOLERANCE`` of the target.

Rows that agree in id, source, size and text are one class with a count. Moving chances
between equal documents changes neither total, so the flight among them is known without
flying: of n with chance c, floor(nc) are taken, and one stays open. So a hot group of
equal rows is one row of one block.

Everything is ordered by (size descending, hash of id and text), so reruns agree.

Null texts have size 0; documents of size 0 take 0; a null source is a source of its own;
repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import plain, settle, settle_table, ship, unused

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Documents a flight block holds on average, and open documents left to the landing.
BLOCK = 8192
LANDING = 12
TOLERANCE = 0.002
#: Up to so many sources the driver plans the targets; beyond, a table of sources is ranked and shared out in Spark.
DRIVER_SOURCES = 100_000
#: Rows of one class that one task writes.
EXPAND = 100_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text (null: 0), without building the words."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("bigint")


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, epochs: float = MAX_EPOCHS) -> list[float]:
    """Target of each (source, size), the sources in the order given."""
    share = [weights[i % len(weights)] for i in range(len(sizes))]
    total, capped = sum(n for _, n in sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        if not free:
            return [float(epochs * n) for _, n in sizes]
        rate = (total - sum(epochs * sizes[i][1] for i in capped)) / sum(share[i] for i in free)
        over = [i for i in free if rate * share[i] > epochs * sizes[i][1]]
        if not over:
            return [float(epochs * n) if i in capped else rate * share[i] for i, (_, n) in enumerate(sizes)]
        capped.update(over)


def flight(size: list[float], chance: list[float], least: int) -> list[float]:
    """Settle chances to 0 or 1 with their sum and sum(chance * size) kept, until ``least`` are open.

    Takes the documents in the order given, so those given last stay open.
    """
    chance = list(chance)
    todo = [i for i in range(len(chance)) if 0.0 < chance[i] < 1.0]
    left, pos, held = len(todo), 0, []
    while left > max(least, 2):
        while len(held) < 3:
            held.append(todo[pos])
            pos += 1
        a, b, c = held
        # null space of the rows (1, 1, 1) and (size a, size b, size c)
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        step = math.inf
        for i, d in zip(held, u, strict=True):
            if d > 0:
                step = min(step, (1.0 - chance[i]) / d)
            elif d < 0:
                step = min(step, chance[i] / -d)
        still = []
        for i, d in zip(held, u, strict=True):
            x = chance[i] + step * d
            if x < 1e-9 or x > 1.0 - 1e-9:
                chance[i] = 0.0 if x < 0.5 else 1.0
                left -= 1
            else:
                chance[i] = x
                still.append(i)
        held = still
    return chance


def land(size: list[float], chance: list[float], drift: float) -> list[float]:
    """Round the few open chances: all choices are tried, the words first, then the documents.

    ``drift`` is what settled documents are over their expected words.
    """
    todo = [i for i in range(len(chance)) if 0.0 < chance[i] < 1.0]
    out = [round(x) if 0.0 < x < 1.0 else x for x in chance]
    if not todo:
        return out
    s, p = np.array([size[i] for i in todo]), np.array([chance[i] for i in todo])
    picks = (np.arange(1 << len(todo))[:, None] >> np.arange(len(todo))) & 1
    words = np.abs(picks @ s - (p @ s - drift))
    docs = np.abs(picks.sum(1) - p.sum())
    best = picks[np.lexsort((np.arange(len(picks)), docs, np.round(words, 6)))[0]]
    for i, x in zip(todo, best, strict=True):
        out[i] = float(x)
    return out


def even_out(size: list[float], chance: list[float], over: float, allowed: float) -> list[float]:
    """Where whole documents leave more than ``allowed`` words too many or too few, take a part of one."""
    out = list(chance)
    if abs(over) <= allowed:
        return out
    fit = [i for i in range(len(out)) if size[i] >= abs(over) and out[i] == (1.0 if over > 0 else 0.0)]
    if fit:
        i = min(fit, key=lambda j: size[j])
        out[i] -= over / size[i]
    return out


OPEN = "doc_key string, source string, size long, source_size long, target double, serial long, n long, taken_whole long, chance double, block long, blocks long"


def _fly(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "serial"], ascending=[False, True], kind="stable", ignore_index=True)
        size, chance = pdf["size"].astype(float).tolist(), pdf["chance"].tolist()
        done = flight(size, chance, LANDING if last else 2)
        if last:
            done = land(size, done, 0.0)
            over = math.fsum(s * (d - c) for s, d, c in zip(size, done, chance, strict=True))
            done = even_out(size, done, over, TOLERANCE * float(pdf["target"].iloc[0]))
        pdf["chance"] = done
        return pdf

    return run


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    named = plain(df, doc_id=doc_id, text=text, source=source).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    return mix_sizes(named.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("serial")))


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its word number ``words``."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def deliver(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``df`` as often as the mix takes it, and the part that it takes of a document as its first words.

    Each row counts for itself, with or without id; rows taken 0 times go.
    """
    columns = df.columns
    row, out, copy = [unused(columns, n) for n in ("row", "out", "copy")]
    # written with its row numbers, which then stay the same on both sides of the join
    rows = settle_table(df.withColumn(row, F.monotonically_increasing_id()))
    sizes = plain(rows, row=row, doc_id=doc_id, text=text, source=source).select(
        F.col("row").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("serial")
    )
    taken = mix_sizes(sizes).filter("taken > 0").select(
        F.col("doc_id").alias("row"), F.floor(F.col("taken") / F.col("size")).alias("whole"), (F.col("taken") % F.col("size")).alias("part")
    )
    joined = rows.join(taken.select(F.struct("row", "whole", "part").alias(out)), F.col(row) == F.col(f"{out}.row"))
    times = F.col(f"{out}.whole") + F.when(F.col(f"{out}.part") > 0, 1).otherwise(0)
    each = joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    cut = F.when(F.col(copy) > F.col(f"{out}.whole"), first_words(F.col(f"`{text}`"), F.col(f"{out}.part"))).otherwise(F.col(f"`{text}`"))
    return each.withColumn(text, cut).select(*[F.col(f"`{c}`") for c in columns])


def plan_sources(totals: DataFrame, driver_sources: int = DRIVER_SOURCES) -> tuple[DataFrame, int]:
    """name, source_size, target and blocks of every source (source, n, classes), and the most blocks of one."""
    spark = totals.sparkSession
    totals = settle(totals)
    names = "name string, source_size long, target double, blocks long"
    if totals.limit(driver_sources + 1).count() <= driver_sources:
        rows = sorted(totals.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        targets = source_targets([(r["source"], r["n"]) for r in rows])
        plan = [(r["source"], r["n"], t, math.ceil(r["classes"] / BLOCK)) for r, t in zip(rows, targets, strict=True)]
        return F.broadcast(spark.createDataFrame(plan, names)), max([p[3] for p in plan], default=1)  # at most DRIVER_SOURCES rows
    # ranks: sorted ranges of sources, and what the ranges before hold
    by = [F.col("source").isNull(), F.col("source")]
    ranked = settle(totals.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")))
    before, held = [], 0
    for r in ranked.groupBy("range").count().orderBy("range").collect():  # as many rows as shuffle partitions
        before.append((r["range"], held))
        held += r["count"]
    rank = F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    offsets = F.broadcast(spark.createDataFrame(before, "range int, before long"))
    shared = ranked.join(offsets, "range").select("source", "n", "classes", weight.alias("weight"), (F.lit(MAX_EPOCHS) * F.col("n")).alias("most"))
    total = shared.agg(F.sum("n")).first()[0]
    rate, capped = None, None
    while True:  # the excess of capped sources raises the rate, which may cap others
        over = F.lit(False) if rate is None else F.lit(rate) * F.col("weight") > F.col("most")
        held, free, n = shared.agg(F.sum(F.when(over, F.col("most")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if n == capped or not free:
            break
        rate, capped = (total - held) / free, n
    over = F.lit(rate) * F.col("weight") > F.col("most")
    target = F.when(over, F.col("most").cast("double")).otherwise(F.lit(rate) * F.col("weight"))
    plan = settle(shared.select(F.col("source").alias("name"), F.col("n").alias("source_size"), target.alias("target"), F.ceil(F.col("classes") / F.lit(BLOCK)).alias("blocks")))
    return plan, plan.agg(F.max("blocks")).first()[0]


def mix_sizes(sizes: DataFrame) -> DataFrame:
    """As :func:`mix`, for a table of doc_id, source, size, and serial, a hash that orders the documents."""
    ship(sizes.sparkSession)
    classes = settle(sizes.groupBy("doc_id", "source", "size", "serial").agg(F.count("*").alias("n")))
    totals = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("n"), F.count("*").alias("classes"))
    known, most = plan_sources(totals)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)
    chance = F.greatest(ratio - whole, F.lit(0.0))
    chance = F.when((chance < 1e-9) | (F.col("size") == 0), 0.0).otherwise(chance)
    ones = F.least(F.floor(chance * F.col("n") + 1e-9), F.col("n") - 1)
    rest = F.least(F.greatest(chance * F.col("n") - F.col("taken_whole"), F.lit(0.0)), F.lit(1.0))
    state = (
        classes.join(known, classes["source"].eqNullSafe(known["name"]))
        .withColumn("taken_whole", ones)
        .select(
            F.col("doc_id").cast("string").alias("doc_key"), "source", "size", "source_size", "target", "serial", "n", "taken_whole",
            F.when(rest < 1e-9, 0.0).otherwise(rest).alias("chance"), F.pmod("serial", "blocks").alias("block"), "blocks",
        )
    )
    settled = []
    while True:
        last = most <= 1
        flown = state.groupBy("source", "block").applyInPandas(_fly(last), OPEN)
        if last:
            settled.append(flown)
            break
        flown = settle(flown)
        is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(flown.filter(~is_open))
        # open documents, at most two a block, meet in blocks of the next round
        fewer = F.ceil(F.col("blocks") * 2 / F.lit(BLOCK)).cast("long")
        state = flown.filter(is_open).withColumn("blocks", fewer).withColumn("block", F.pmod("serial", "blocks"))
        most = math.ceil(most * 2 / BLOCK)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    largest = classes.agg(F.max("n")).first()[0] or 1
    out = out.withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(EXPAND).cast("long"))))
    if largest > EXPAND:  # a hot class is written by several tasks
        out = out.repartition(F.col("serial"), F.col("no"))
    out = out.withColumn("no", F.explode(F.sequence(F.col("no"), F.least(F.col("n"), F.col("no") + (EXPAND - 1)))))
    part = F.when(F.col("no") <= F.col("taken_whole"), 1.0).when(F.col("no") == F.col("taken_whole") + 1, F.col("chance")).otherwise(0.0)
    return out.select(
        F.col("doc_key").cast("long").alias("doc_id"), "size", "source_size", "target", F.round(F.col("size") * (whole + part)).cast("long").alias("taken")
    )
