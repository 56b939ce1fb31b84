"""Key-based upserts with a merge rule for each column.

Spark's Parquet tables have no MERGE, so an upsert is a function of the old table and the
updates: both are unioned, marked by origin, and aggregated by key, one shuffle for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Merge rules. ``keep_old`` also keeps an old null; ``never`` is an alias of it.
#: ``filled_new`` takes a new value unless it is null or the empty string.
RULES = ("replace", "keep_old", "coalesce_new", "coalesce_old", "filled_new", "sum", "greatest", "least", "never")


def _merged(rule: str, old: Column, new: Column, has_old: Column, has_new: Column) -> Column:
    if rule == "replace":
        return F.when(has_new, new).otherwise(old)
    if rule in ("keep_old", "never"):
        return F.when(has_old, old).otherwise(new)
    if rule == "coalesce_new":
        return F.coalesce(new, old)
    if rule == "coalesce_old":
        return F.coalesce(old, new)
    if rule == "filled_new":
        return F.coalesce(F.nullif(new, F.lit("")), old)
    if rule == "sum":
        return F.when(old.isNull() & new.isNull(), None).otherwise(F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)))
    if rule == "greatest":
        return F.greatest(old, new)
    if rule == "least":
        return F.least(old, new)
    raise ValueError(f"no such rule: {rule}")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, str], pick: Column | None = None, other: str = "replace") -> DataFrame:
    """Target after the updates. Null keys equal each other; columns without a rule follow ``other``.

    ``updates`` may hold a key more than once: ``sum`` adds all, otherwise the row with the
    greatest ``pick`` counts (all columns decide ties, so reruns agree).
    """
    values = [c for c in target.columns if c not in keys]
    side = F.struct(*([pick.alias("__pick")] if pick is not None else []), *[F.col(c) for c in values])
    marked = target.select(*keys, F.lit(0).alias("__new"), F.struct(*[F.col(c) for c in values]).alias("__v"), F.lit(None).cast(updates.select(side.alias("s")).schema["s"].dataType).alias("__u"))
    fresh = updates.select(*keys, F.lit(1).alias("__new"), F.lit(None).cast(marked.schema["__v"].dataType).alias("__v"), side.alias("__u"))
    sums = [c for c in values if rules.get(c) == "sum"]
    both = marked.unionByName(fresh)
    old_row, new_row = F.max(F.when(F.col("__new") == 0, F.col("__v"))), F.max(F.when(F.col("__new") == 1, F.col("__u")))
    out = both.groupBy(*keys).agg(
        old_row.alias("__o"), new_row.alias("__n"), *[F.sum(F.when(F.col("__new") == 1, F.col(f"__u.{c}"))).alias(f"__s_{c}") for c in sums]
    )
    has_old, has_new = F.col("__o").isNotNull(), F.col("__n").isNotNull()
    columns = []
    for c in values:
        new = F.col(f"__s_{c}") if c in sums else F.col(f"__n.{c}")
        columns.append(_merged(rules.get(c, other), F.col(f"__o.{c}"), new, has_old, has_new).cast(target.schema[c].dataType).alias(c))
    return out.select(*keys, *columns)


# Keys and merge rules of the engine's tables.
TABLE_RULES: dict[str, tuple[list[str], dict[str, str]]] = {
    "documents": (["url"], {"title": "filled_new", "word_count": "greatest"}),
    "entities": (["canonical_name", "entity_type"], {"mention_count": "sum", "last_seen": "greatest", "confidence": "greatest", "ticker": "coalesce_old"}),
    "document_entities": (["document_id", "entity_id"], {"mention_count": "sum"}),
    "signals": (
        ["document_id", "entity_id", "signal_type", "direction"],
        {"confidence": "greatest", "value": "coalesce_new", "context": "coalesce_new", "country": "coalesce_new"},
    ),
    "themes": (["slug", "country"], {"first_detected": "coalesce_old", "hypothesis": "coalesce_new", "canonical_name": "coalesce_new", "is_active": "keep_old"}),
    "theme_snapshots": (["theme_id", "snapshot_date"], {"doc_count": "keep_old", "company_count": "keep_old"}),
    "beneficiaries": (["theme_id", "entity_id"], {"role": "filled_new", "reasoning": "coalesce_new", "first_seen": "keep_old"}),
    "events": (["document_id", "event_type", "subject"], {"confidence": "greatest", "magnitude": "coalesce_new", "description": "coalesce_new", "filed_at": "keep_old"}),
    "causal_chains": (["chain_id"], {"last_scored": "coalesce_new", "first_detected": "least"}),
    "theme_performance": (["slug", "ticker", "detection_date"], {"forward_return": "coalesce_new", "alpha": "coalesce_new"}),
    "entity_timeseries": (["entity_id", "period_date", "period_type"], {}),
    "contradictions": (["company", "theme", "from_quarter", "to_quarter"], {}),
    "theme_propagation": (["narrative_slug", "snapshot_date"], {}),
    "canonical_reviews": (["cluster_id"], {}),
    "macro_series": (["series_id", "observation_date", "vintage_date"], {}),
    "commodity_series": (["commodity_id", "observation_date"], {}),
    "policy_events": (["policy_id"], {}),
    "macro_events": (["event_type", "series_id", "event_date"], {"severity": "greatest"}),
    "macro_theme_links": (["theme_slug", "link_type", "macro_event_id", "policy_event_id", "as_of_date"], {"strength": "greatest"}),
    "company_mentions": (["company", "theme", "quarter"], {}),
}


# Tables whose other columns stay as first written.
KEEP_REST = ("signals",)


def upsert_table(name: str, target: DataFrame, updates: DataFrame) -> DataFrame:
    """:func:`upsert` by the rules of a named table; signals keep the most confident of a batch."""
    keys, rules = TABLE_RULES[name]
    if name == "signals":
        # an absent direction is one key, however it is written
        one = F.coalesce("direction", F.lit(""))
        target, updates = target.withColumn("direction", one), updates.filter("document_id is not null").withColumn("direction", one)
    pick = F.col("confidence") if "confidence" in updates.columns else None
    return upsert(target, updates, keys, rules, pick, "keep_old" if name in KEEP_REST else "replace")


def sync_counts(themes: DataFrame, members: DataFrame, theme: str, member: str, count: str) -> DataFrame:
    """Set ``count`` to the distinct members of each theme; themes without any get 0."""
    found = members.groupBy(theme).agg(F.countDistinct(member).alias("__n"))
    return themes.drop(count).join(found, theme, "left").withColumn(count, F.coalesce("__n", F.lit(0))).drop("__n")


def write_partition(df: DataFrame, path: str, *columns: str) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
