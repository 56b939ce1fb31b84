"""Temporal operators over ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str], *order: Column | str) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def lag_change(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Previous value and change in percent of its size (null without one, or at zero)."""
    last = F.lag(value).over(_by(keys, order))
    return df.withColumn("previous", last).withColumn("pct_change", F.try_divide((F.col(value) - F.col("previous")) * 100.0, F.abs("previous")))


def first_last(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """First, last, lowest and highest value of each key, their trend and the number of rows."""
    return df.groupBy(*keys).agg(
        F.min_by(value, order).alias("first"),
        F.max_by(value, order).alias("last"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.count("*").alias("n"),
    ).withColumn("trend", F.col("last") - F.col("first"))


def velocity(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Fractional first difference (0 at the start, previous 0 counts as 1), and its difference."""
    w = _by(keys, order)
    last = F.lag(value).over(w)
    move = F.when(last.isNull(), 0.0).otherwise((F.col(value) - last) / F.when(last == 0, 1).otherwise(last))
    out = df.withColumn("velocity", move)
    return out.withColumn("acceleration", F.coalesce(F.col("velocity") - F.lag("velocity").over(w), F.lit(0.0)))


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, width: int = 2) -> DataFrame:
    """Mean over a zero-padded window of ``width`` rows, centred as in a same-size convolution."""
    before = width // 2
    frame = _by(keys, order).rowsBetween(-before, width - 1 - before)
    return df.withColumn("moving_average", F.sum(value).over(frame) / float(width))


def half_window_slope(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Mean of the later half less the mean of the earlier half (the middle row counts as later)."""
    w = Window.partitionBy(*keys)
    marked = df.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(_by(keys, order)))
    early = F.col("__r") <= F.floor(F.col("__n") / 2)
    out = marked.groupBy(*keys).agg(
        F.max("__n").alias("n"), F.avg(F.when(early, F.col(value))).alias("early"), F.avg(F.when(~early, F.col(value))).alias("late")
    )
    return out.withColumn("slope", F.when(F.col("n") >= 2, F.col("late") - F.col("early")))


def streaks(df: DataFrame, keys: list[str], index: str, most: int = 12) -> DataFrame:
    """Length of the run of consecutive ``index`` values that ends at each row, at most ``most``."""
    island = F.col(index) - F.row_number().over(_by(keys, index))
    marked = df.withColumn("__island", island)
    run = F.row_number().over(Window.partitionBy(*keys, "__island").orderBy(index))
    return marked.withColumn("streak", F.least(run, F.lit(most)).cast("bigint")).drop("__island")


def previous_period(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Value of the calendar period before, null where that period has no row."""
    w = _by(keys, index)
    near = F.lag(index).over(w) == F.col(index) - 1
    return df.withColumn("previous", F.when(near, F.lag(value).over(w)))


def rank_change(now: DataFrame, before: DataFrame, key: str, score: str) -> DataFrame:
    """Rank by falling score, the rank of the run before, and the move as NEW, →, ↑n or ↓n."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, score, F.row_number().over(Window.orderBy(F.desc(score), key)).cast("bigint").alias(name))

    last = ranked(before, "previous_rank").select(key, "previous_rank")
    out = ranked(now, "rank").join(last, key, "left")
    move = F.col("previous_rank") - F.col("rank")
    label = (
        F.when(move.isNull(), "NEW")
        .when(move > 0, F.concat(F.lit("↑"), move.cast("string")))
        .when(move < 0, F.concat(F.lit("↓"), (-move).cast("string")))
        .otherwise("→")
    )
    return out.withColumn("move", label)


def momentum(df: DataFrame, keys: list[str], day: str, as_of: Column, recent: int = 30, prior: int = 90) -> DataFrame:
    """Counts in [as_of - recent, as_of] and the days before, the momentum score and its direction.

    Rows after ``as_of`` never count.
    """
    age = F.datediff(as_of, F.col(day))
    counts = df.groupBy(*keys).agg(
        F.count(F.when(age.between(0, recent), 1)).alias("recent"), F.count(F.when((age > recent) & (age <= prior), 1)).alias("prior")
    )
    r, p = F.col("recent").cast("double"), F.col("prior").cast("double")
    score = F.when(p == 0, F.least(r * 10.0, F.lit(100.0))).otherwise(F.greatest(F.lit(0.0), F.least((r / F.greatest(p, F.lit(1.0)) - 1.0) * 50.0 + 50.0, F.lit(100.0))))
    label = F.when(F.col("momentum") >= 65, "accelerating").when(F.col("momentum") >= 45, "stable").when(F.col("momentum") >= 20, "decelerating").otherwise("declining")
    return counts.withColumn("momentum", score).withColumn("direction", label)


def suppress_near(items: Column, distance: int = 500) -> Column:
    """Of hits (struct with type, confidence, start), by falling confidence, those at least
    ``distance`` from the last kept one of their type. A fold, since it depends on what was kept."""
    order = F.array_sort(items, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(a["seq"] - b["seq"]))
    kind = order  # the result has the items' type

    def step(kept: Column, hit: Column) -> Column:
        same = F.filter(kept, lambda k: k["type"] == hit["type"])
        far = (F.size(same) == 0) | (F.abs(F.element_at(same, -1)["start"] - hit["start"]) >= distance)
        return F.when(far, F.concat(kept, F.array(hit))).otherwise(kept)

    return F.aggregate(order, F.slice(kind, 1, 0), step)


def last_items(history: Column, new: Column, most: int = 8) -> Column:
    """The last ``most`` entries of two arrays in a row."""
    both = F.concat(history, new)
    return F.slice(both, F.greatest(F.size(both) - most + 1, F.lit(1)), most)
