"""Joins and filters that Spark has no single operator for."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast in a containment join.
BROADCAST_ROWS = 100_000
#: Characters of a word that find its candidate texts.
GRAM = 3


def optional(df: DataFrame, *predicates: Column | None, **equals: object) -> DataFrame:
    """Filter by the predicates that are given and by equality with the values that are not None.

    Absent predicates never reach the plan, so pushdown sees only real ones.
    """
    found = [p for p in predicates if p is not None] + [F.col(k) == v for k, v in equals.items() if v is not None]
    return df.filter(reduce(operator.and_, found)) if found else df


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the given order, which should be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", rank).filter("__r = 1").drop("__r")


def as_of(df: DataFrame, keys: list[str], day: str, ceiling: Column, *ties: Column, floor: Column | None = None) -> DataFrame:
    """Latest row a key that is not after ``ceiling`` (nor before ``floor``)."""
    return latest(optional(df, F.col(day) <= ceiling, None if floor is None else F.col(day) >= floor), keys, F.desc(day), *ties)


def as_of_vintage(df: DataFrame, keys: list[str], day: str, vintage: str) -> DataFrame:
    """One row a key and day: the latest vintage, an unknown vintage first."""
    return latest(df, [*keys, day], F.desc_nulls_first(vintage))


def forward_as_of(left: DataFrame, right: DataFrame, key: str, day: str, right_day: str, value: str, shift: int, tolerance: int = 4) -> DataFrame:
    """Earliest ``value`` of ``right`` in [day + shift, day + shift + tolerance].

    The few offsets become an equi-join on (key, day): no range join, so it shuffles once
    and stays linear.
    """
    wanted = left.withColumn("__off", F.explode(F.sequence(F.lit(shift), F.lit(shift + tolerance)))).withColumn("__d", F.expr(f"date_add({day}, __off)"))
    prices = right.select(F.col(key).alias("__k"), F.col(right_day).alias("__rd"), F.col(value).alias("__v"))
    hits = wanted.join(prices, (F.col(key) == F.col("__k")) & (F.col("__d") == F.col("__rd")))
    first = hits.groupBy(key, day).agg(F.min_by("__v", "__off").alias(value))
    return left.join(first.withColumnsRenamed({key: "__k", day: "__day"}), (F.col(key) == F.col("__k")) & (F.col(day) == F.col("__day")), "left").drop("__k", "__day")


def overlapping(df: DataFrame, first: str, last: str, low: Column, high: Column) -> DataFrame:
    """Rows whose interval meets [low, high]."""
    return df.filter((F.col(first) <= high) & (F.col(last) >= low))


def contains_join(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """Pairs whose text holds the word anywhere, any case; empty words meet nothing.

    A keyword list is a dimension and is broadcast up to BROADCAST_ROWS. Beyond, the first
    GRAM characters of a word (all of a shorter one) are joined to the texts' distinct
    runs of that length, and the containment of the whole word is checked afterwards on
    the text, which is fetched by a hash of its row. Both ways give the same pairs.
    """
    words = words.filter(F.length(F.col(word)) > 0)
    holds = F.contains(F.lower(F.col(text)), F.lower(F.col(word)))
    if words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return texts.join(F.broadcast(words), holds)
    key = F.xxhash64(F.lower(F.col(text)))
    bodies = texts.select(key.alias("__key"), F.lower(F.col(text)).alias("__body")).filter("__body is not null").dropDuplicates(["__key"])
    low = F.lower(F.col(word))
    out = None
    for n in range(1, GRAM + 1):
        heads = words.filter(F.length(low) == n if n < GRAM else F.length(low) >= n).withColumn("__gram", F.substring(low, 1, n))
        grams = F.array_distinct(F.regexp_extract_all("__body", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
        met = bodies.select("__key", F.explode(grams).alias("__gram")).join(heads, "__gram").drop("__gram")
        out = met if out is None else out.unionByName(met)
    return texts.withColumn("__key", key).join(out, "__key").filter(holds).drop("__key")


def in_at_least(df: DataFrame, keys: list[str], distinct: str, least: int) -> DataFrame:
    """Rows of keys that have at least ``least`` distinct values (a semi-join)."""
    kept = df.groupBy(*keys).agg(F.countDistinct(distinct).alias("__n")).filter(F.col("__n") >= least).select(*keys)
    return df.join(kept, keys, "left_semi")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank.

    The filter stands on the bare row number, so each task thins its rows before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


def pairs_within(df: DataFrame, group: str, item: str) -> DataFrame:
    """Pairs (a < b) of a group's items with the number of groups they share.

    Groups are filings with a bounded number of entities; the pairs are pre-aggregated
    before the shuffle.
    """
    a, b = df.select(group, F.col(item).alias("a")), df.select(group, F.col(item).alias("b"))
    return a.join(b, group).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def count_distinct_if(condition: Column, value: str) -> Column:
    return F.countDistinct(F.when(condition, F.col(value)))


def map_counts(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Map from kind to its count, and the total, a key; two levels, so the first is partial."""
    counts = df.groupBy(*keys, kind).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "__n")))).alias("counts"), F.sum("__n").alias("total"))
