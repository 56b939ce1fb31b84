"""Themes: entity-signal clusters, noise, detection, stages and ranking, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.config import CONSTRAINT_TIERS, DEMAND, SUPPLY, Config
from tessellar.functions.scalars import clamp, first_tier, slug
from tessellar.operators.relational import count_if
from tessellar.operators.settle import written

# Spellings and the name they stand for.
ALIASES = {
    "chip": "semiconductor", "chips": "semiconductor", "microchip": "semiconductor", "integrated circuit": "semiconductor",
    "ml": "artificial intelligence", "machine learning": "artificial intelligence", "deep learning": "artificial intelligence",
    "llm": "artificial intelligence", "generative ai": "artificial intelligence", "gpu": "ai accelerator", "gpus": "ai accelerator",
    "npu": "ai accelerator", "tpu": "ai accelerator", "high bandwidth memory": "hbm", "hbm3": "hbm", "dram": "memory", "nand": "nand flash",
    "datacenter": "data center", "data centre": "data center", "hyperscaler": "data center", "electrical grid": "power grid",
    "electricity grid": "power grid", "ev": "electric vehicle", "bev": "electric vehicle", "cowos": "advanced packaging",
    "chiplet": "advanced packaging", "cloud computing": "cloud", "public cloud": "cloud", "liquid cooling": "cooling", "immersion cooling": "cooling",
}
# Stems that speak for a technical theme.
THEME_STEMS = (
    "chip", "semi", "solar", "grid", "power", "data", "cloud", "fiber", "nuclear", "battery", "lithium", "hydrogen", "drone", "satellite", "quantum",
    "biotech", "genomic", "wafer", "foundry", "transformer", "turbine", "laser", "radar", "sensor", "roboti", "autonomous", "neural",
)
STOPWORDS = ("a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with", "by", "from", "at")


def canonical_name(name: Column) -> Column:
    """Lower case, trimmed, aliases resolved."""
    low = F.lower(F.trim(name))
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, low), low)


def is_noise_name(name: Column, generic: tuple[str, ...] = ()) -> Column:
    """Whether a name's form rules it out: too short, not a word, many words, only stopwords, camel case of tags."""
    words = F.split(F.lower(F.trim(name)), r"\s+")
    short_tech = name.rlike(r"^(?:\d[A-Z]|[A-Z]\d|[A-Z]{2})$")
    small = (F.length(name) < 3) | ((F.length(name) < 4) & (name != F.upper(name)))
    form = ~name.rlike(r"^\p{L}") | name.rlike(r"^[A-Z][a-z]+(?:[A-Z][a-z]+){2,}$")
    stop = F.forall(words, lambda w: w.isin(*STOPWORDS))
    listed = F.lower(F.trim(name)).isin(*generic) if generic else F.lit(False)
    return F.when(name.isNull() | (name == ""), True).when(short_tech, False).otherwise(small | form | (F.size(words) > 5) | stop | listed)


def word_shape_noise(name: Column) -> Column:
    """0 (surely a theme) to 1 (surely noise) from the form of a name; the first rule that fits."""
    low, words = F.lower(name), F.split(F.trim(name), r"\s+")
    n = F.size(words)
    capital = F.forall(words, lambda w: w.rlike(r"^\p{Lu}") | w.isin(*STOPWORDS))
    return (
        F.when(name.rlike(r"^[A-Z]{2,6}$"), 0.05)
        .when((F.length(name) <= 6) & name.rlike("[A-Z]") & name.rlike("[0-9]"), 0.1)
        .when((n >= 2) & capital, 0.15)
        .when(F.contains(name, F.lit("-")) & (n <= 3), 0.2)
        .when(low.rlike("|".join(THEME_STEMS)), 0.1)
        .when((n == 1) & (F.length(low) <= 4), 0.75)
        .when((n == 1) & (F.length(low) <= 10) & low.rlike("(?:tion|ment|ness|ity|ance|ence)$"), 0.6)
        .when((n == 1) & (F.length(low) <= 9) & low.rlike("ing$"), 0.55)
        .when(n == 1, 0.45)
        .when(name == low, 0.4)
        .otherwise(0.35)
    )


def coherence_noise(total: Column, kinds: Column, top: Column, demand: Column, supply: Column) -> Column:
    """How little an entity's signal types agree: 0 coherent, 1 random."""
    lead = top / F.nullif(total, F.lit(0))
    return (
        F.when(total == 0, 0.8)
        .when(total <= 1, 0.7)
        .when((demand > 0) & (supply > 0), 0.05)
        .when((lead > 0.6) & (total >= 3), 0.2)
        .when((kinds >= 4) & (lead < 0.3), 0.6)
        .otherwise(0.4)
    )


def adaptive_companies(total: Column, cap: int) -> Column:
    """Fewest companies a theme needs, from the number of companies in the data."""
    return F.least(F.greatest(F.lit(2), F.floor(F.sqrt(total.cast("double")) * 0.5).cast("int")), F.lit(max(2, cap)))


def noise_score(companies: Column, total: Column, signals: Column, shape: Column, coherence: Column, sectors: Column | None = None, total_sectors: Column | None = None) -> Column:
    """Weighted noise of an entity from ubiquity, sector spread, concentration, form and coherence."""
    ratio, cap = companies / total, F.least(F.lit(0.7), 0.4 + 3.0 / total)
    ubiquity = 1.0 / (1.0 + F.exp(-8.0 * (ratio - cap)))
    spread = F.lit(0.0)
    if sectors is not None and total_sectors is not None:
        spread = F.when((total_sectors > 1) & (sectors > 1), F.pow(F.log2(sectors.cast("double")) / F.log2(total_sectors.cast("double")), 0.8)).otherwise(0.0)
    gini = F.when((companies > 0) & (signals > 0), (1.0 - F.least(signals / companies / 5.0, F.lit(1.0))) * 0.5).otherwise(0.3)
    return 0.30 * ubiquity + 0.15 * spread + 0.15 * gini + 0.25 * shape + 0.15 * coherence


def noise_limit(total: Column, base: float = 0.55) -> Column:
    """Score above which an entity is noise; small data are read leniently, large strictly."""
    return F.when(total < 10, base + 0.05).when(total > 50, base - 0.05).otherwise(base)


def clusters(signals: DataFrame, filings: DataFrame, mentions: DataFrame, entities: DataFrame, since: Column, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """One row an entity over the signals of all filings that mention it, in [since, as_of].

    ``signals``: doc_id, signal_type (and tight, 1 where the context speaks of tight supply);
    ``filings``: doc_id, company, filed_at; ``mentions``: doc_id, entity_id; ``entities``:
    entity_id, canonical_name, entity_type. Signals are counted by filing before the m:n join,
    so the fan-out carries one row a filing and entity instead of one a signal and entity.
    """
    tight = F.sum("tight") if "tight" in signals.columns else F.lit(0)
    kinds = sorted({*DEMAND, *SUPPLY, "regulatory_tailwind"})
    per_doc = signals.groupBy("doc_id").agg(
        F.count("*").alias("n"), tight.cast("bigint").alias("tight"), *[count_if(F.col("signal_type") == k).alias(f"n_{k}") for k in kinds]
    )
    docs = filings.filter((F.col("filed_at") >= since) & (F.col("filed_at") <= as_of)).select("doc_id", "company", "filed_at")
    rows = docs.join(per_doc, "doc_id").join(mentions, "doc_id").join(entities.select("entity_id", "canonical_name", "entity_type"), "entity_id")
    # Several distinct counts at once would multiply the rows before the shuffle. Three steps do
    # not: by filing, by company, by entity, each with partial aggregation.
    name, counts = ["canonical_name", "entity_type"], [f"n_{k}" for k in kinds]
    recent = (F.col("filed_at") >= F.date_sub(as_of, cfg.recent_days)).cast("int")
    by_doc = rows.groupBy(*name, "company", "doc_id").agg(
        F.max("filed_at").alias("filed_at"), F.sum("n").alias("n"), F.sum("tight").alias("tight"), *[F.sum(c).alias(c) for c in counts]
    )
    by_company = by_doc.groupBy(*name, "company").agg(
        F.count("*").alias("docs"), F.sum(recent).alias("recent"), F.collect_set(F.year("filed_at") * 4 + F.quarter("filed_at")).alias("quarters"),
        F.min("filed_at").alias("first"), F.max("filed_at").alias("last"), F.sum("n").alias("n"), F.sum("tight").alias("tight"), *[F.sum(c).alias(c) for c in counts],
    )
    by_company = written(by_company)  # the fan-out runs once, for the entities and for the total
    out = by_company.groupBy(*name).agg(
        F.count("company").alias("n_companies"),
        F.sum("docs").alias("n_docs"),
        F.size(F.array_distinct(F.flatten(F.collect_set("quarters")))).cast("bigint").alias("quarter_count"),
        F.sum("recent").alias("recent_docs"),
        F.sum("n").alias("total_signals"),
        F.sum("tight").alias("tight_count"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        *[F.sum(c).alias(c) for c in counts],
    )
    total = by_company.agg(F.countDistinct("company").alias("total_companies"))
    out = out.crossJoin(F.broadcast(total))  # one row
    ratio = F.col("n_companies") / F.nullif(F.col("total_companies"), F.lit(0))
    capex = F.col("n_capex_increase")
    demand = sum((F.col(f"n_{k}") for k in DEMAND), F.lit(0))
    supply = sum((F.col(f"n_{k}") for k in SUPPLY), F.lit(0))
    return (
        out.filter((capex + F.col("total_signals") >= cfg.min_signals) & (ratio < cfg.max_ubiquity))
        .withColumn("capex_count", capex)
        .withColumn("demand_count", demand)
        .withColumn("supply_count", supply)
        .withColumn("regulatory_count", F.col("n_regulatory_tailwind"))
    )


def detect(rows: DataFrame, cfg: Config = Config(), country: str | None = None, active_names: list[str] | None = None) -> DataFrame:
    """Themes from clusters: gates, strength, conviction, slug; one theme an entity slug, the best 25.

    Gates: demand meets supply tension; committed capital; early demand; regulated build-out.
    """
    d, s, c, r = (F.col(f"{k}_count").cast("double") for k in ("demand", "supply", "capex", "regulatory"))
    n, docs, q = F.col("n_companies"), F.col("n_docs"), F.col("quarter_count")
    name = canonical_name(F.col("canonical_name"))
    least = adaptive_companies(F.col("total_companies"), cfg.max_adaptive_companies)
    counted = rows.withColumn("name", name).withColumn("least", least)
    kinds = [f"n_{k}" for k in sorted({*DEMAND, *SUPPLY, "regulatory_tailwind"})]
    top = F.greatest(*[F.col(k) for k in kinds])
    present = sum((F.when(F.col(k) > 0, 1).otherwise(0) for k in kinds), F.lit(0))
    noise = noise_score(n, F.col("total_companies"), F.col("total_signals"), word_shape_noise(F.col("name")), coherence_noise(F.col("total_signals"), present, top, d, s))
    tension_gate = (d >= cfg.min_tension_demand) & (s >= cfg.min_tension_supply)
    most_cos = F.greatest(F.lit(cfg.min_companies), F.col("least"))
    early_cos = F.greatest(F.lit(cfg.min_early_companies), F.col("least"))
    capex_gate = (c >= most_cos) & (n >= most_cos)
    early_gate = (d >= cfg.min_early_demand) & (s < cfg.min_tension_supply) & (n >= early_cos) & (c >= 2)
    regulated_gate = (r >= cfg.min_tension_supply) & (c >= 2) & (n >= early_cos)
    ceiling = 60.0 if country == "IN" else 40.0
    tension = (
        F.when(tension_gate, F.least(2.0 * d * s / (d + s) * 12.0, F.lit(60.0)))
        .when(early_gate, F.least(d * 4.0, F.lit(30.0)))
        .when(regulated_gate, F.least(r * 4.0 + c * 3.0, F.lit(ceiling)))
        .otherwise(0.0)
    )
    bonus = F.when(q >= 4, 20.0).when(q >= 3, 14.0).when(q >= 2, 8.0).otherwise(0.0)
    chain = F.lit(0.0)
    if active_names:
        names = F.array(*[F.lit(a.lower()) for a in active_names])
        chain = F.when(F.exists(names, lambda a: F.contains(F.col("name"), a) | F.contains(a, F.col("name"))), 15.0).otherwise(0.0)
    recency = 0.10 + 0.90 * F.col("recent_docs") / F.greatest(docs, F.lit(1))
    raw = F.col("tension") + F.least(c * 8.0, F.lit(30.0)) + F.least(n * 2.0, F.lit(20.0)) + bonus + chain
    raw = raw + F.least(F.col("tight_count") * 6.0, F.lit(25.0)) + clamp((d - c) * 3.0, 0.0, 15.0)
    order = ("regulatory_tailwind", "supply_bottleneck", "demand_surge", "capex_increase") if country == "IN" else ("supply_bottleneck", "demand_surge", "capex_increase")
    dominant = F.lit("demand_surge")
    for k in reversed(order):
        dominant = F.when(F.col(f"n_{k}") > 0, k).otherwise(dominant)
    strong = F.when((F.col("tension") >= 40) & (n >= 4), "confirmed").when((F.col("tension") >= 20) | capex_gate, "developing").otherwise("emerging")
    conviction = F.when(q < 2, "emerging").when((q < 3) & (strong == "confirmed"), "developing").otherwise(strong)
    out = (
        counted.filter(~is_noise_name(F.col("canonical_name")) & ~is_noise_name(F.col("name")))
        .withColumn("noise", noise)
        .filter(F.col("noise") <= noise_limit(F.col("total_companies")))
        .filter(tension_gate | capex_gate | early_gate | regulated_gate)
        .filter((n >= F.col("least")) & (docs >= F.greatest(F.lit(2), F.floor(F.col("least") * 1.2))))
        .withColumn("tension", tension)
        .withColumn("strength", F.least(raw * recency, F.lit(100.0)))
        .withColumn("conviction", conviction)
        .withColumn("dominant_signal", dominant)
        .withColumn("entity_slug", slug(F.col("name")))
        .withColumn("theme_slug", F.concat(F.lit("auto-"), F.col("entity_slug"), F.lit("-"), F.substring(F.replace(F.col("dominant_signal"), F.lit("_"), F.lit("-")), 1, 15)))
        .withColumn("first_detected", F.when(q >= 2, F.col("first_date")))
    )
    best = Window.partitionBy("entity_slug").orderBy(F.desc("n_companies"), F.desc("total_signals"), "canonical_name", "entity_type")
    out = out.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")
    return out.orderBy(F.desc(F.col("tension") + F.col("strength")), "theme_slug").limit(cfg.theme_limit)


def detect_raw(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Themes straight from signal rows, where no clusters were counted: as :func:`detect` without recency, chains and wording.

    ``rows``: signal_id, canonical_name, entity_type, company, sector, signal_type, doc_id. A
    signal counts once an entity however often it comes. The bonus follows the filings, and
    conviction does not look at quarters.
    """
    named = rows.withColumn("name", F.trim("canonical_name")).filter(F.col("name").isNotNull() & ~is_noise_name(F.col("name")))
    some = named.select("name", "signal_id", "signal_type", F.nullif("company", F.lit("")).alias("company"), "doc_id",
                        F.nullif(F.when(F.col("entity_type") == "SECTOR", F.col("name")).otherwise(F.col("sector")), F.lit("")).alias("sector"))
    some = written(some)  # read by the three counts below
    kind = F.col("signal_type")
    by_kind = some.filter(kind.isNotNull() & (kind != "")).groupBy("name", "signal_type").agg(F.countDistinct("signal_id").alias("n"))
    counts = by_kind.groupBy("name").agg(
        F.sum("n").alias("total_signals"), F.count("*").alias("kinds"), F.max("n").alias("top"), F.max_by("signal_type", F.struct("n", "signal_type")).alias("common"),
        F.sum(F.when(kind.isin(*DEMAND), F.col("n")).otherwise(0)).alias("demand_count"), F.sum(F.when(kind.isin(*SUPPLY), F.col("n")).otherwise(0)).alias("supply_count"),
        F.sum(F.when(F.contains(kind, F.lit("capex")), F.col("n")).otherwise(0)).alias("capex_count"),
        *[F.sum(F.when(kind == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in ("supply_bottleneck", "demand_surge", "capex_increase")],
    )
    breadth = some.groupBy("name").agg(F.countDistinct("company").alias("n_companies"), F.countDistinct("sector").alias("n_sectors"), F.countDistinct("doc_id").alias("n_docs"))
    whole = some.agg(F.greatest(F.countDistinct("company"), F.lit(1)).alias("total_companies"), F.greatest(F.countDistinct("sector"), F.lit(1)).alias("total_sectors"))
    out = counts.join(breadth, "name").crossJoin(F.broadcast(whole))  # one row
    d, s, c, n, docs = (F.col(k).cast("double") for k in ("demand_count", "supply_count", "capex_count", "n_companies", "n_docs"))
    least = adaptive_companies(F.col("total_companies"), cfg.max_adaptive_companies)
    coherence = coherence_noise(F.col("total_signals"), F.col("kinds"), F.col("top"), d, s)
    noise = noise_score(n, F.col("total_companies"), F.col("total_signals"), word_shape_noise(F.col("name")), coherence, F.col("n_sectors"), F.col("total_sectors"))
    tension_gate = (d >= cfg.min_tension_demand) & (s >= cfg.min_tension_supply)
    most_cos, early_cos = F.greatest(F.lit(cfg.min_companies), least), F.greatest(F.lit(cfg.min_early_companies), least)
    capex_gate = (c >= most_cos) & (n >= most_cos)
    early_gate = (d >= cfg.min_early_demand) & (s < cfg.min_tension_supply) & (n >= early_cos) & (c >= 2)
    tension = F.when(tension_gate, F.least(2.0 * d * s / (d + s) * 12.0, F.lit(60.0))).when(early_gate, F.least(d * 4.0, F.lit(30.0))).otherwise(0.0)
    bonus = F.when(docs >= 6, 10.0).when(docs >= 3, 5.0).otherwise(0.0)
    dominant = F.col("common")
    for k in ("capex_increase", "demand_surge", "supply_bottleneck"):
        dominant = F.when(F.col(f"n_{k}") > 0, k).otherwise(dominant)
    return (
        out.withColumn("noise", noise)
        .filter(F.col("noise") <= noise_limit(F.col("total_companies")))
        .filter(tension_gate | capex_gate | early_gate)
        .filter((n >= least) & (docs >= F.greatest(F.lit(2), F.floor(least * 1.2))))
        .withColumn("tension", tension)
        .withColumn("strength", F.least(F.col("tension") + F.least(c * 8.0, F.lit(30.0)) + F.least(n * 2.0, F.lit(20.0)) + bonus, F.lit(100.0)))
        .withColumn("dominant_signal", dominant)
        .withColumn("conviction", F.when((F.col("tension") >= 40) & (n >= 4), "confirmed").when((F.col("tension") >= 20) | capex_gate, "developing").otherwise("emerging"))
        .withColumn("entity_slug", slug(F.col("name")))
        .withColumn("theme_slug", F.concat(F.lit("auto-"), F.col("entity_slug"), F.lit("-"), F.substring(F.replace(F.col("dominant_signal"), F.lit("_"), F.lit("-")), 1, 15)))
        .orderBy(F.desc("strength"), "theme_slug")
    )


def bottlenecks(contexts: DataFrame, least_companies: int = 3, least_signals: int = 3, limit: int = 20, tiers=CONSTRAINT_TIERS) -> DataFrame:
    """Entities by the wording of supply constraints.

    ``contexts``: canonical_name, entity_type, company, doc_id, context, filed_at. Each
    context weighs by the first tier of phrases it holds.
    """
    held = contexts.filter(F.length("context") > 20).withColumn("w", first_tier(F.col("context"), tiers)).filter("w > 0")
    rows = held.groupBy("canonical_name", "entity_type").agg(
        F.countDistinct("company").alias("n_companies"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.sum((F.col("w") * 100).cast("bigint")).alias("weight_c"),
        F.count("*").alias("n_signals"),
        F.min("filed_at").alias("first_date"),
        F.countDistinct(F.year("filed_at") * 4 + F.quarter("filed_at")).alias("quarter_count"),
    )
    rows = rows.filter((F.col("n_companies") >= least_companies) & (F.col("n_signals") >= least_signals))
    rows = rows.orderBy(F.desc("weight_c"), F.desc("n_companies"), "canonical_name").limit(limit)
    return bottleneck_scores(rows.withColumn("weight", F.col("weight_c") / 100.0))


def bottleneck_scores(rows: DataFrame) -> DataFrame:
    """Severity, strength and conviction from weight, n_docs, n_companies and quarter_count."""
    q, n = F.col("quarter_count"), F.col("n_companies")
    index = F.col("weight") / F.greatest(F.col("n_docs"), F.lit(1)) * F.least(n / 3.0, F.lit(2.0)) * F.least(q / 2.0, F.lit(1.5))
    return (
        rows.withColumn("severity_index", index)
        .withColumn("severity", F.when((index >= 1.2) & (q >= 2), "Critical Shortage").when(index >= 0.7, "Severe Constraint").otherwise("Supply Bottleneck"))
        .withColumn("strength", F.least(F.col("weight") * 5.0 + n * 3.0 + (q - 1) * 8.0, F.lit(100.0)))
        .withColumn("conviction", F.when((q >= 3) & (n >= 5), "confirmed").when((q >= 2) | (n >= 4), "developing").otherwise("emerging"))
    )


# Weights of the kinds of an edge between a driver and what it needs.
EDGE_WEIGHTS = {"input_dependency": 1.0, "supply_constraint": 1.0, "capex": 0.8, "semantic": 0.3, "co_mentioned": 0.2}


def downstream(primaries: DataFrame, mentions: DataFrame, supply: DataFrame, share: float = 0.3, most: int = 8) -> DataFrame:
    """For each primary entity its most constrained companions, in one set-based pass.

    ``primaries``: entity_id, n_docs; ``mentions``: doc_id, entity_id, company; ``supply``:
    entity_id, supply_signals, demand_signals, capex_signals. Companions appear in at least
    ``share`` of the primary's filings (and in two).
    """
    p = primaries.select(F.col("entity_id").alias("primary_id"), F.col("n_docs").alias("primary_docs"))
    docs = mentions.join(p.select("primary_id"), F.col("entity_id") == F.col("primary_id")).select("primary_id", "doc_id").distinct()
    pairs = docs.join(mentions, "doc_id").filter("entity_id <> primary_id")
    met = pairs.groupBy("primary_id", "entity_id").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("company").alias("companies"))
    met = met.join(p, "primary_id").filter(F.col("docs") >= F.greatest(F.lit(2.0), F.col("primary_docs") * share))
    out = met.join(supply.filter("supply_signals >= 2"), "entity_id").withColumn("cooccur_pct", F.col("docs") / F.col("primary_docs") * 100.0)
    order = Window.partitionBy("primary_id").orderBy(F.desc("supply_signals"), F.desc("docs"), "entity_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("bigint"))


def edge_kind(supply: Column, capex: Column, pct: Column, known_input: Column | None = None) -> Column:
    """Kind of a driver-companion edge, the strongest that fits."""
    known = F.lit(False) if known_input is None else known_input
    return F.when(known, "input_dependency").when(supply >= 3, "supply_constraint").when(capex >= 3, "capex").when(pct >= 50, "semantic").otherwise("co_mentioned")


def downstream_strength(rows: DataFrame, adjacency: Column, hops: int = 1) -> DataFrame:
    """Path and economic scores, gates at 0.70, and strength of driver-companion rows."""
    kind = edge_kind(F.col("supply_signals"), F.col("capex_signals"), F.col("cooccur_pct"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv]), kind)
    d, s = F.col("demand_signals").cast("double"), F.col("supply_signals").cast("double")
    out = rows.withColumn("edge_kind", kind).withColumn("edge_weight", weight).withColumn("path_score", weight / float(hops * hops))
    out = out.withColumn("economic_score", adjacency * 0.5 + F.col("path_score") * 0.5)
    strength = (
        F.least(s / F.greatest(F.col("companies"), F.lit(1)), F.lit(5.0)) * 8.0
        + F.least(F.col("cooccur_pct") * 0.4 * F.col("edge_weight"), F.lit(25.0))
        + F.least(2.0 * d * s / F.greatest(d + s, F.lit(1.0)) * 5.0, F.lit(25.0))
        + F.least(F.col("capex_signals") * 4.0, F.lit(15.0))
        + F.col("economic_score") * 15.0
        + 10.0
    )
    gates = (F.col("path_score") >= 0.7) & (F.col("companies") >= 3) & (F.col("economic_score") >= 0.7)
    return out.filter(gates).withColumn("strength", F.least(strength, F.lit(100.0)))


def merge(*themes: DataFrame) -> DataFrame:
    """One row a slug over several detectors: the greatest of each score."""
    out = themes[0]
    for t in themes[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    rest = [c for c in out.columns if c != "theme_slug"]
    return out.groupBy("theme_slug").agg(*[F.max(c).alias(c) for c in rest])


def stage(companies: Column, strength: Column, momentum: Column, conviction: Column, kinds: Column, tension: Column) -> Column:
    """Lifecycle stage 0 to 5 by an ordered list of rules; ``kinds`` is the array of signal types."""

    def has(*names: str) -> Column:
        return F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))

    tight, surge, capex = has("supply_bottleneck", "inventory_drawdown"), has("demand_surge", "capex_increase"), has("capex_increase")
    ease = has("supply_easing")
    slowing = F.when(strength > 0, momentum / strength).otherwise(1.0) < 0.75
    return (
        F.when(has("demand_slowdown") & ease & (companies >= 8) & (tension < 30), 5)
        .when(ease & ~tight & (companies >= 12) & (tension < 25), 4)
        .when((companies >= 25) & (conviction == "confirmed") & slowing, 3)
        .when((companies >= 40) & ~tight, 3)
        .when((companies >= 10) & capex & surge & (conviction == "confirmed"), 2)
        .when((companies >= 10) & (tension >= 40), 2)
        .when((companies >= 4) & tight & surge, 1)
        .when((companies >= 4) & (tension >= 20), 1)
        .when((companies >= 6) & capex & conviction.isin("developing", "confirmed"), 1)
        .otherwise(0)
    )


def progression(now: Column, before: Column, kinds: Column, kinds_before: Column) -> Column:
    """Struct of trend, score, growth in percent and new signal types against the last snapshot."""
    growth = F.when(before > 0, (now - before) / before * 100.0).when(now > 0, 100.0).otherwise(0.0)
    fresh = F.array_except(kinds, kinds_before)

    def came(*names: str) -> Column:
        return F.arrays_overlap(fresh, F.array(*[F.lit(n) for n in names]))

    tight = came("supply_bottleneck", "inventory_drawdown")
    score = 50.0 + F.when(growth >= 30, F.least(growth * 0.5, F.lit(30.0))).when(growth >= 15, 10.0).when(growth <= -20, -20.0).otherwise(0.0)
    score = clamp(score + F.when(tight, 20.0).otherwise(0.0) + F.when(came("capex_increase"), 15.0).otherwise(0.0) + F.when(came("demand_surge"), 10.0).otherwise(0.0), 0.0, 100.0)
    trend = F.when((score >= 70) | (growth >= 30) | tight, "advancing").when((score <= 30) | (growth <= -20), "weakening").otherwise("stable")
    new = before.isNull()
    return F.struct(
        F.when(new, "new").otherwise(trend).alias("trend"),
        F.when(new, 50.0).otherwise(score).alias("score"),
        F.when(new, 0.0).otherwise(growth).alias("growth_pct"),
        F.when(new, kinds).otherwise(fresh).alias("new_kinds"),
    )


def explosive(downstream_theme: Column, companies: Column, supply: Column, tension: Column, trend: Column, stage_no: Column) -> Column:
    """Additive points for asymmetric potential, at most 100."""
    points = F.when(downstream_theme, 30.0).otherwise(0.0)
    points = points + F.when((supply >= 3) & (companies > 0) & (companies <= 8), 20.0).when((supply >= 2) & (companies <= 12), 10.0).otherwise(0.0)
    points = points + F.when(tension >= 40, 20.0).when(tension >= 20, 10.0).otherwise(0.0) + F.when(trend == "advancing", 10.0).otherwise(0.0)
    return F.least(points + F.when(stage_no.isin(0, 1), 20.0).when(stage_no == 2, 10.0).otherwise(0.0), F.lit(100.0))


# Weights of the composite, multipliers by conviction, weights of eligibility.
WEIGHTS = {"tension": 0.40, "capex": 0.25, "momentum": 0.20, "breadth": 0.10, "confidence": 0.05}
CONVICTION = {"confirmed": 1.25, "developing": 1.00, "emerging": 0.75, "declining": 0.35}


def eligibility(universe: int, demand: Column, supply: Column, capex: Column, companies: Column, tight: Column, weight: Column, quarters: Column, bottleneck: Column) -> Column:
    """Six-factor eligibility; the bars grow with the number of companies followed."""
    u = max(universe, 5)
    held = F.when(quarters >= 3, 1.0).when(quarters == 2, 0.7).otherwise(0.3)
    return (
        0.20 * F.least(demand / min(u * 2.5, 50.0), F.lit(1.0))
        + 0.25 * F.least((supply + tight * 1.5 + weight * 0.5) / min(u * 2.0, 40.0), F.lit(1.0))
        + 0.20 * F.least(capex / min(u * 0.75, 15.0), F.lit(1.0))
        + 0.15 * F.least(companies / min(u * 0.75, 10.0), F.lit(1.0))
        + 0.10 * held
        + 0.10 * F.when(bottleneck | (tight >= 3), 1.0).otherwise(0.0)
    )


def composite(tension: Column, capex: Column, momentum: Column, breadth: Column, confidence: Column, conviction: Column, quarters: Column) -> Column:
    """Weighted composite times the multipliers of conviction and persistence."""
    parts = {"tension": tension, "capex": capex, "momentum": momentum, "breadth": breadth, "confidence": confidence}
    base = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    by = F.lit(1.0)
    for k, v in CONVICTION.items():
        by = F.when(conviction == k, v).otherwise(by)
    return base * by * F.when(quarters >= 4, 1.40).when(quarters == 3, 1.25).when(quarters == 2, 1.12).otherwise(1.0)


def rank(themes: DataFrame, universe: int, cfg: Config = Config()) -> DataFrame:
    """Eligible themes by composite score. Expects the columns of :func:`detect` plus momentum and confidence."""
    n = F.col("n_companies")
    lift = F.least(F.col("tension") + F.least(F.col("capex_count") * 5.0, F.lit(20.0)), F.lit(100.0))
    score = composite(lift, F.least(F.col("capex_count") * 10.0, F.lit(100.0)), F.col("momentum"), F.least(n * 2.0, F.lit(40.0)), F.col("confidence"), F.col("conviction"), F.col("quarter_count"))
    fit = eligibility(universe, F.col("demand_count"), F.col("supply_count"), F.col("capex_count"), n, F.col("tight_count"), F.lit(0.0), F.col("quarter_count"), F.lit(False))
    out = themes.withColumn("eligibility", fit).withColumn("composite", score)
    out = out.filter((F.col("eligibility") >= cfg.min_eligibility) & (F.col("composite") >= cfg.min_composite))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "theme_slug")).cast("bigint"))
