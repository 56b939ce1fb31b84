"""Company rankings from themes, beneficiaries and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.scalars import clamp, first_tier
from tessellar.operators.relational import count_if

# Scores of conviction, decay by hops, weights of roles, tiers of bottleneck wording, macro clusters.
CONVICTION_SCORE = {"confirmed": 1.0, "developing": 0.60, "emerging": 0.25}
ROLE_WEIGHT = {"supply": 1.5, "beneficiary": 1.2, "direct": 0.8}
ROLE_NAMES = {"supplier": "supply", "bottleneck_player": "supply", "infrastructure_provider": "supply", "beneficiary": "beneficiary", "direct": "direct"}
BOTTLENECK_TIERS = (
    (("severe constraint", "critical shortage", "ai chips", "hbm", "advanced packaging", "gpu shortage", "chip shortage"), 0.90),
    (("semiconductor", "data center", "networking", "power grid", "liquid cooling", "inference cluster", "training cluster", "artificial intelligence critical", "gpu", "high-bandwidth", "wafer", "fab capacity"), 0.78),
    (("shortage", "constraint", "infrastructure", "capacity limit", "supply gap", "bottleneck", "interconnect", "optical", "power"), 0.55),
    (("demand-supply tension", "supply tension", "chip demand", "equipment demand"), 0.40),
    (("constraint from", "materials:", "cloud:", "energy:", "demand from"), 0.35),
)
MACRO_CLUSTERS = (
    ("ai_bottleneck", ("artificial intelligence critical", "ai chips", "gpu shortage", "generative ai", "llm", "machine learning")),
    ("semiconductor", ("semiconductor", "chip", "wafer", "fab", "hbm", "advanced packaging", "chiplet")),
    ("cloud_infra", ("data center", "hyperscaler")),
    ("cloud_sw", ("cloud", "saas", "software", "ai demand", "artificial intelligence")),
    ("power", ("power grid", "power", "energy", "electricity", "grid", "cooling", "thermal", "liquid cool")),
    ("networking", ("networking", "network", "switch", "router", "interconnect", "optical")),
    ("defense", ("defense", "military", "aerospace")),
    ("cyber", ("cybersecurity", "security", "cyber")),
    ("logistics", ("supply chain", "logistics", "shipping", "freight")),
    ("geopolitical", ("china", "geopolitical", "tariff", "trade war")),
    ("biotech", ("biotech", "pharma", "drug", "therapeutic")),
    ("consumer", ("consumer", "retail", "shopping", "auto parts", "home improvement", "cruise", "travel", "restaurant", "food")),
)
SUPPLY_KINDS = ("supply_bottleneck", "capex_increase", "inventory_drawdown", "hiring_surge", "supply_constraint", "capacity_expansion", "infrastructure_spend", "inventory_buildup")
BENEFIT_KINDS = ("demand_surge", "technology_adoption", "regulatory_tailwind", "market_entry", "revenue_growth", "market_share_gain", "end_market_growth", "technology_disruption")
DIRECT_KINDS = ("strategic_pivot", "acquisition_intent", "partnership_formed", "product_launch", "r_and_d_increase", "guidance_raise")
NEGATIVE_KINDS = ("competition_threat", "regulatory_headwind", "demand_slowdown", "supply_easing", "hiring_freeze", "margin_compression", "inventory_buildup")
BOTTLENECK_KINDS = ("supply_bottleneck", "capex_increase", "inventory_drawdown", "supply_constraint", "capacity_expansion", "infrastructure_spend")
THEME_WEIGHTS = {"theme_cq": 0.40, "momentum": 0.20, "persistence": 0.10, "novelty": 0.12, "acceleration": 0.10, "signal_intensity": 0.05, "bottleneck": 0.03}


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def hop(rank: Column) -> Column:
    """Distance in the supply chain by the rank in a theme."""
    return F.when(rank <= 10, 0).when(rank <= 25, 1).when(rank <= 50, 2).when(rank <= 100, 3).otherwise(4)


def hop_decay(h: Column) -> Column:
    return F.when(h == 0, 1.0).when(h == 1, 0.80).when(h == 2, 0.60).when(h == 3, 0.30).otherwise(0.10)


def macro_cluster(name: Column) -> Column:
    """First macro cluster one of whose words the name holds."""
    low, out = F.lower(name), F.lit("other")
    for label, words in reversed(MACRO_CLUSTERS):
        out = F.when(low.rlike("|".join(words)), label).otherwise(out)
    return out


def theme_scores(themes: DataFrame, snapshots: DataFrame, signal_counts: DataFrame | None = None, chain_words: tuple[str, ...] = ()) -> DataFrame:
    """Six factors and the constraint quality of each theme over a window of snapshots.

    ``themes``: theme, name, conviction, company_count; ``snapshots``: theme, snapshot_date,
    momentum (0 to 100); ``signal_counts``: theme, window, all_time.
    """
    last = Window.partitionBy("theme").orderBy(F.desc("snapshot_date"))
    snap = snapshots.withColumn("__r", F.row_number().over(last)).withColumn("__p", F.lead("momentum").over(last)).withColumn("__n", F.count("*").over(Window.partitionBy("theme")))
    snap = snap.filter("__r = 1").select(F.col("theme").alias("__t"), F.col("momentum").alias("__m"), "__p", "__n", F.col("snapshot_date").alias("__d"))
    edge = snap.agg(F.max("__n").alias("__most"), F.max("__d").alias("__latest"))
    out = themes.join(snap, F.col("theme") == F.col("__t"), "left").crossJoin(F.broadcast(edge))  # one row
    if signal_counts is not None:
        most = signal_counts.agg(F.max("window").alias("__max"))
        out = out.join(signal_counts.withColumnsRenamed({"theme": "__s"}), F.col("theme") == F.col("__s"), "left").crossJoin(F.broadcast(most))
        w, a = F.coalesce("window", F.lit(0)), F.coalesce("all_time", F.lit(0))
        share = F.least(w / F.greatest(F.coalesce("__max", F.lit(1)), F.lit(1)), F.lit(1.0))
        intensity = F.when(a > 0, 0.5 * F.least(w / a, F.lit(1.0)) + 0.5 * share).when(w > 0, share).otherwise(0.0)
    else:
        intensity = F.lit(0.0)
    seen, n = F.col("__t").isNotNull(), F.col("company_count")
    m = clamp(F.coalesce("__m", F.lit(0)) / 100.0, 0.0, 1.0)
    conv = lookup(F.col("conviction"), CONVICTION_SCORE, 0.25)
    novelty = F.greatest(F.lit(0.0), 1.0 - F.greatest(F.datediff("__latest", "__d"), F.lit(0)) / 365.0)
    if chain_words:
        novelty = F.when(F.lower("name").rlike("|".join(chain_words)), F.least(novelty + 0.2, F.lit(1.0))).otherwise(novelty)
    quality = 0.40 * first_tier(F.col("name"), BOTTLENECK_TIERS, 0.25) + 0.30 * F.greatest(F.lit(0.05), 1.0 - n / 60.0)
    quality = quality + 0.20 * F.least(m * conv, F.lit(1.0)) + 0.10 * intensity
    breadth = clamp(F.pow(30.0 / F.greatest(n, F.lit(1)), F.lit(1.5)), 0.10, 1.0)
    out = out.select(
        *themes.columns,
        F.when(seen, m).otherwise(0.0).alias("momentum"),
        F.when(seen, F.least(F.col("__n") / F.greatest("__most", F.lit(1)), F.lit(1.0))).otherwise(0.0).alias("persistence"),
        F.when(seen, novelty).otherwise(0.0).alias("novelty"),
        F.when(~seen, 0.0).when(F.col("__n") >= 2, clamp((F.col("__m") - F.col("__p") + 30) / 60.0, 0.0, 1.0)).otherwise(0.5).alias("acceleration"),
        F.when(seen, intensity).otherwise(0.0).alias("signal_intensity"),
        conv.alias("bottleneck"),
        F.when(seen, clamp(quality * breadth, 0.02, 1.0)).otherwise(0.05).alias("theme_cq"),
    )
    return out.withColumn("rank_score", sum((F.col(k) * w for k, w in THEME_WEIGHTS.items()), F.lit(0.0)))


def theme_pool(scores: DataFrame, top: int = 15, floor: float = 0.45) -> DataFrame:
    """The best by rank score (to six digits, so sums in another order rank alike), and all of high constraint quality."""
    place = F.row_number().over(Window.orderBy(F.desc(F.floor(F.col("rank_score") * 1e6)), "theme"))
    return scores.withColumn("__r", place).filter((F.col("__r") <= top) | (F.col("theme_cq") >= floor)).drop("__r")


def company_signals(signals: DataFrame) -> DataFrame:
    """Counts a company needs for roles and edges: total, bottleneck, supply, benefit, direct, negative.

    ``signals``: ticker, signal_type, direction. Adverse directions are no evidence.
    """
    good, kind = ~F.coalesce(F.col("direction"), F.lit("")).isin("negative", "decreasing"), F.col("signal_type")
    return signals.groupBy("ticker").agg(
        F.count("*").alias("total"),
        count_if(kind.isin(*BOTTLENECK_KINDS) & good).alias("bottleneck"),
        count_if(kind.isin(*SUPPLY_KINDS) & good).alias("supply_n"),
        count_if(kind.isin(*BENEFIT_KINDS) & good).alias("benefit_n"),
        count_if(kind.isin(*DIRECT_KINDS) & good).alias("direct_n"),
        count_if(kind.isin(*NEGATIVE_KINDS)).alias("negative_n"),
    )


def edges(pool: DataFrame, beneficiaries: DataFrame, counts: DataFrame, edge_least: float = 0.03, cq_least: float = 0.02) -> DataFrame:
    """Company-theme edges with role, relevance edge and constraint-quality edge, gated.

    ``beneficiaries``: theme, ticker, company, role, relevance (0 to 100), signal_count,
    total_signals (all of the company's, if other than its counted ones), rank_in_theme,
    mention_count, confidence.
    """
    b = beneficiaries.join(pool.select("theme", "name", "conviction", "theme_cq", "rank_score"), "theme").join(counts, "ticker", "left").fillna(0, [c for c in counts.columns if c != "ticker"])
    if "total_signals" not in beneficiaries.columns:
        b = b.withColumn("total_signals", F.col("total"))
    most = b.agg(F.greatest(F.max("signal_count"), F.lit(1)).alias("__ms"), F.greatest(F.max("mention_count"), F.lit(2)).alias("__mm"))
    b = b.crossJoin(F.broadcast(most)).withColumn("hop", hop(F.col("rank_in_theme")))
    stored = F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv]), F.lower("role"))
    s, f, d = F.col("supply_n"), F.col("benefit_n"), F.col("direct_n")
    by_signal = F.when(s + f + d == 0, None).when((s >= f) & (s >= d), "supply").when(f >= d, "beneficiary").otherwise("direct")
    agrees = F.when(stored.isNotNull() & by_signal.isNotNull(), F.when(stored == by_signal, 1.0).otherwise(0.5)).when(stored.isNotNull(), 0.80).otherwise(0.45)
    n = F.col("signal_count")
    trust = (
        0.30 * F.least(n / F.greatest(F.col("__ms") * 0.6, F.lit(1.0)), F.lit(1.0))
        + 0.30 * F.ln(F.greatest("mention_count", F.lit(1)) + 1.0) / F.ln(F.col("__mm") + 1.0)
        + 0.20 * F.least(F.col("relevance") / 100.0, F.lit(1.0)) * agrees
        + 0.20 * clamp((F.col("confidence") - 0.75) / 0.25, 0.0, 1.0)
        + F.when(stored.isNotNull(), 0.15).otherwise(0.0)
        - F.least(F.col("negative_n") * 0.03, F.lit(0.15))
    )
    b = b.withColumn("company_role", F.coalesce(stored, by_signal, F.lit("beneficiary"))).withColumn("role_confidence", clamp(trust, 0.12, 1.0))
    near = 0.6 * F.least(F.col("relevance") / 100.0, F.lit(1.0)) + 0.4 * F.least(n / F.greatest(F.col("__ms") * 0.4, F.lit(1.0)), F.lit(1.0))
    b = b.withColumn("edge", F.least(near * F.col("role_confidence") * F.pow(F.lit(0.7), F.col("hop")) * (0.4 + 0.6 * F.col("rank_score")), F.lit(1.0)))
    ratio = F.when(F.col("total") > 0, F.least(F.col("bottleneck") / F.col("total"), F.lit(1.0))).otherwise(0.0)
    own = F.when((F.col("total_signals") > 0) & (n > 0), 0.70 + 0.60 * F.least(n / F.col("total_signals"), F.lit(1.0))).otherwise(1.0)
    b = b.withColumn("edge_cq", F.col("theme_cq") * hop_decay(F.col("hop")) * (0.40 + 0.60 * ratio) * own)
    return b.filter((F.col("edge") >= edge_least) & (F.col("edge_cq") >= cq_least))


def rank_companies(rows: DataFrame, top_themes: int) -> DataFrame:
    """Final score of each company from its edges: best edge, mean of the best three, supplier quality, independent clusters."""
    place = Window.partitionBy("ticker").orderBy(F.desc("edge_cq"), "theme")
    rows = rows.withColumn("__r", F.row_number().over(place)).withColumn("__best", F.max("edge_cq").over(Window.partitionBy("ticker"))).withColumn("cluster", macro_cluster(F.col("name")))
    priority = F.when(F.col("company_role") == "supply", 3).when(F.col("company_role") == "direct", 2).otherwise(1) * 0.40 + F.col("role_confidence") * 0.60
    out = rows.groupBy("ticker").agg(
        F.max("__best").alias("best"),
        F.avg(F.when(F.col("__r") <= 3, F.col("edge_cq"))).alias("top3"),
        F.max(F.struct(priority.alias("p"), F.col("company_role").alias("role"), F.col("role_confidence").alias("trust"))).alias("__role"),
        F.countDistinct(F.when(F.col("edge_cq") > 0.25 * F.col("__best"), F.col("cluster"))).alias("independent"),
        F.countDistinct("theme").alias("n_themes"),
        F.count("*").alias("n_edges"),
        F.avg(lookup(F.col("conviction"), CONVICTION_SCORE, 0.25)).alias("conv"),
        F.max("signal_count").alias("n_signals"),
        F.max("__ms").alias("__ms"),
        F.min("rank_in_theme").alias("best_rank"),
    )
    role, trust = F.col("__role.role"), F.col("__role.trust")
    quality = (
        0.25 * trust * F.when(role == "supply", 1.0).when(role == "direct", 0.65).otherwise(0.35)
        + 0.20 * F.least(F.col("conv") + F.least((F.col("n_edges") - 1) * 0.08, F.lit(0.25)), F.lit(1.0))
        + 0.20 * F.least(F.col("n_signals") / F.greatest(F.col("__ms") * 0.5, F.lit(1.0)), F.lit(1.0))
        + 0.20 / (1.0 + F.col("best_rank") * 0.10)
        + 0.15 * F.least(F.col("n_themes") / float(max(1, top_themes)) * 2.0, F.lit(1.0))
    )
    bonus = F.least(F.lit(0.25), F.ln(1.0 + F.col("independent")) / F.ln(F.lit(5.0)))
    base = 0.65 * F.col("best") + 0.20 * F.col("top3") + 0.15 * F.least(clamp(quality, 0.05, 1.0), F.col("best") * 10.0)
    weight = F.when(role == "supply", 1.5).when(role == "beneficiary", 1.2).otherwise(0.8)
    out = out.select("ticker", role.alias("company_role"), "best", "top3", "independent", "n_themes", clamp(quality, 0.05, 1.0).alias("supplier_quality"), (base * (1.0 + bonus) * weight).alias("final_score"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "ticker")).cast("bigint"))


def india_ranking(beneficiaries: DataFrame, themes: DataFrame, stats: DataFrame, limit: int = 50) -> DataFrame:
    """Product-constraint ranking: one row a company, its best theme.

    ``beneficiaries``: company, theme, role, conviction; ``themes``: theme, strength (0 to
    100), conviction_label, company_count; ``stats``: company, total, capex, constraints, orders.
    """
    cq = F.col("strength") / 100.0 * 0.50 + F.when(F.col("label") == "confirmed", 0.9).when(F.col("label") == "developing", 0.6).otherwise(0.3) * 0.30
    cq = cq + clamp(60.0 / F.greatest("company_count", F.lit(1)), 0.25, 1.0) * 0.20
    t = themes.select("theme", F.col("strength"), F.col("conviction_label").alias("label"), "company_count").withColumn("theme_cq", cq).select("theme", "theme_cq")
    b = beneficiaries.join(t, "theme", "left").join(stats, "company", "left").fillna(0, ["total", "capex", "constraints", "orders"]).fillna(0.30, ["theme_cq"])
    n_all = beneficiaries.agg(F.count("*").alias("__all"))
    b = b.crossJoin(F.broadcast(n_all))

    def log_share(x: Column, full: Column) -> Column:
        return F.least(F.ln(1.0 + x) / F.ln(1.0 + full), F.lit(1.0))

    relevance = F.when((F.col("conviction") == 0) & (F.col("total") == 0), 0.0).otherwise(F.col("conviction") * 0.60 + log_share(F.col("total"), F.lit(50.0)) * 0.40)
    capacity = log_share(F.col("capex"), F.lit(10.0))
    market = F.when(F.col("total") > 0, log_share(F.col("total"), F.greatest("__all", F.lit(1)) * 3.0)).otherwise(0.0)
    quality = relevance * 0.35 + capacity * 0.25 + market * 0.20 + log_share(F.col("orders"), F.lit(8.0)) * 0.10 + log_share(F.col("constraints"), F.lit(5.0)) * 0.10
    far = F.when(F.col("role") == "direct", 1.0).when(F.col("role") == "supplier", 0.8).when(F.col("role") == "enabler", 0.6).otherwise(0.3)
    score = F.col("theme_cq") * 0.30 + relevance * 0.25 + quality * 0.20 + far * 0.15 + capacity * 0.10
    scored = b.withColumn("final_score", score * F.when(relevance == 0, 0.10).otherwise(1.0)).withColumn("supplier_q", quality)
    best = Window.partitionBy(F.lower("company")).orderBy(F.desc("final_score"), "theme")
    one = scored.withColumn("__r", F.row_number().over(best)).filter("__r = 1")
    top = one.select("company", "theme", "role", "supplier_q", "final_score").orderBy(F.desc("final_score"), "company").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "company")).cast("bigint"))
