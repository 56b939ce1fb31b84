"""Whole runs as lazy plans: documents to signals, signals to ranked themes, replay over dates."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.config import Config
from tessellar.operators import text as T
from tessellar.operators import themes as TH
from tessellar.operators import windows as W
from tessellar.operators.graph import company_edges, merge_edges, technology_pairs
from tessellar.operators.intelligence import combine_beneficiaries, entity_match


@dataclass(frozen=True)
class Tables:
    """The relations a run reads."""

    filings: DataFrame  # doc_id, company, ticker, filed_at, country
    signals: DataFrame  # doc_id, signal_type (and tight)
    mentions: DataFrame  # doc_id, entity_id
    entities: DataFrame  # entity_id, canonical_name, entity_type


def run_nlp(docs: DataFrame, lexicon: DataFrame, patterns=T.SIGNAL_PATTERNS, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Entities (doc_id, keyword, entity_type) and signals of normalised documents; no shuffle before the entity join."""
    clean = docs.withColumn("text", T.normalize(F.col("text"), cfg.min_text_length)).filter("text is not null")
    return T.keyword_entities(clean, lexicon), T.extract_signals(clean, patterns)


def run_themes(tables: Tables, as_of: date, cfg: Config = Config(), country: str | None = None, snapshots: DataFrame | None = None, universe: int = 100) -> DataFrame:
    """Clusters, detection, momentum from snapshots and ranking at a date; rows after it never count."""
    filings = tables.filings if country is None else tables.filings.filter(F.col("country") == country)
    day = F.lit(as_of.isoformat()).cast("date")
    rows = TH.clusters(tables.signals, filings, tables.mentions, tables.entities, F.date_sub(day, cfg.signal_window_days), day, cfg)
    found = TH.detect(rows, cfg, country)
    if snapshots is not None:
        seen = snapshots.filter((F.col("snapshot_date") <= day) & (F.col("snapshot_date") > F.add_months(day, -9)))
        slope = W.half_window_slope(seen, ["theme_slug"], "snapshot_date", "strength").select("theme_slug", "slope")
        found = found.join(slope, "theme_slug", "left").withColumn("momentum", F.greatest(F.lit(0.0), F.least(50.0 + F.coalesce("slope", F.lit(0.0)) * 3.0, F.lit(100.0)))).drop("slope")
    else:
        found = found.withColumn("momentum", F.lit(50.0))
    return TH.rank(found.withColumn("confidence", F.lit(50.0)), universe, cfg)


def snapshot(themes: DataFrame, as_of: date) -> DataFrame:
    """The rows a run adds to the snapshot table."""
    return themes.select("theme_slug", F.lit(as_of.isoformat()).cast("date").alias("snapshot_date"), "strength", "momentum", F.col("n_docs").alias("doc_count"), F.col("n_companies").alias("company_count"))


def run_beneficiaries(themes: DataFrame, tables: Tables, cfg: Config = Config()) -> DataFrame:
    """Companies of each theme by entity matches in their filings."""
    names = themes.select("theme_slug", "canonical_name")
    e = tables.entities.join(F.broadcast(names), "canonical_name").select("entity_id", "theme_slug")  # at most theme_limit themes
    f = tables.filings.select("doc_id", "company", "ticker")
    per_doc = tables.signals.groupBy("doc_id").agg(F.count("*").alias("signals"))
    m = tables.mentions.join(e, "entity_id").join(f, "doc_id").withColumn("company", F.concat_ws("\x1f", "theme_slug", "company", "ticker"))
    found = entity_match(m, per_doc)
    parts = F.split("company", "\x1f")
    rows = found.select(parts[0].alias("theme"), parts[1].alias("company"), parts[2].alias("ticker"), "relevance", "signal_count")
    return combine_beneficiaries(rows, rows.limit(0), cfg.beneficiary_cap, least=cfg.beneficiary_min_relevance)


def run_graph(mentions: DataFrame) -> DataFrame:
    """Edges of companies, concepts and technologies from (doc_id, company, entity, entity_type, context)."""
    return merge_edges(company_edges(mentions), technology_pairs(mentions))


def month_ends(first: date, last: date) -> list[date]:
    """Last days of the calendar months that end in [first, last]."""
    out, day = [], date(first.year, first.month, 1)
    while day <= last:
        day = date(day.year + day.month // 12, day.month % 12 + 1, 1)
        if first <= (end := day - timedelta(days=1)) <= last:
            out.append(end)
    return out


def replay(tables: Tables, first: date, last: date, cfg: Config = Config(), country: str | None = None) -> DataFrame:
    """Ranked themes of every month end in a range: one plan a date, all in one job.

    The dates of a run are few; each plan prunes filings by its own window.
    """
    out = None
    for day in month_ends(first, last):
        rows = run_themes(tables, day, cfg, country).withColumn("as_of", F.lit(day.isoformat()).cast("date"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no month ends in the range")
    return out


def replay_years(tables: Tables, years: list[int], today: date, cfg: Config = Config()) -> DataFrame:
    """Themes of calendar years: window from January 1 to December 31 (or today)."""
    out = None
    for year in years:
        end = min(date(year, 12, 31), today)
        own = replace(cfg, signal_window_days=(end - date(year, 1, 1)).days)
        rows = run_themes(tables, end, own).withColumn("year", F.lit(year))
        out = rows if out is None else out.unionByName(rows)
    return out


def forward_performance(detections: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (30, 90, 180, 365), benchmark: str = "BENCH") -> DataFrame:
    """Returns and alpha of (ticker, day) at each horizon; prices are the first within four days."""
    from tessellar.operators.relational import forward_as_of

    base = detections.select("ticker", "day").distinct()
    both = base.unionByName(base.select(F.lit(benchmark).alias("ticker"), "day").distinct())
    start = forward_as_of(both, prices, "ticker", "day", "date", "close", 0).withColumnRenamed("close", "p0")
    out = start
    for h in horizons:
        later = forward_as_of(both, prices, "ticker", "day", "date", "close", h).withColumnRenamed("close", "p1")
        out = out.join(later, ["ticker", "day"]).withColumn(f"return_{h}d", F.try_divide(F.col("p1"), F.nullif(F.col("p0"), F.lit(0.0))) - 1.0).drop("p1")
    bench = out.filter(F.col("ticker") == benchmark).select("day", *[F.col(f"return_{h}d").alias(f"__b{h}") for h in horizons])
    rows = out.filter(F.col("ticker") != benchmark).join(bench, "day", "left")
    return rows.select("ticker", "day", *[f"return_{h}d" for h in horizons], *[(F.col(f"return_{h}d") - F.col(f"__b{h}")).alias(f"alpha_{h}d") for h in horizons])


def session(name: str = "tessellar") -> SparkSession:
    """A session with the defaults the plans expect."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
