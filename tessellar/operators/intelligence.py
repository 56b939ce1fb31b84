"""Composite analyses: beneficiaries, causal chains, contradictions, topics, canonical themes, macro overlays, India layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.scalars import clamp, jaccard, slug
from tessellar.operators.graph import components
from tessellar.operators.pattern_tables import CAUSE_ALIASES, SLUG_STOPS, SUPPLY_TERMS, THEME_STOPS
from tessellar.operators.relational import contains_join, count_if
from tessellar.operators.settle import written
from tessellar.operators.text import WORD_CUT, phrase_hits, sentiment

# --- beneficiaries -----------------------------------------------------------------------


def economic_context(context: Column, keywords: tuple[str, ...], indicators: tuple[str, ...]) -> Column:
    """How economic the best sentence with a keyword is: 0, 0.40, 0.65, then more by hit."""
    words = "|".join(rf"\b\Q{k}\E\b" for k in keywords)
    sentences = F.filter(F.split(F.lower(context), r"[.!?;\n]"), lambda s: s.rlike(words))
    hits = F.transform(sentences, lambda s: phrase_hits(s, indicators))
    scores = F.transform(hits, lambda h: F.when(h == 0, 0.0).when(h == 1, 0.40).when(h == 2, 0.65).otherwise(F.least(0.40 + h * 0.15, F.lit(1.0))))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def signal_relevance(signals: Column, role: Column, capex: Column) -> Column:
    """Relevance of a company by its matching signals: logarithmic, plus role and capital."""
    boost = F.when(role.isin("bottleneck_player", "infrastructure_provider"), 20.0).when(role == "supplier", 10.0).otherwise(0.0)
    return F.least(F.ln(1.0 + signals) * 22.0 + boost + F.least(capex * 5.0, F.lit(20.0)), F.lit(100.0))


def entity_match(mentions: DataFrame, signal_docs: DataFrame, least_mentions: int = 2) -> DataFrame:
    """Companies whose filings name a theme's entities and carry signals.

    ``mentions``: doc_id, entity_id, company; ``signal_docs``: doc_id, signals. Both sides
    are one row a filing (and entity), so nothing fans out.
    """
    rows = mentions.join(signal_docs, "doc_id").groupBy("company", "doc_id").agg(F.count("*").alias("m"), F.max("signals").alias("s"))
    out = rows.groupBy("company").agg(F.sum("m").alias("entity_mentions"), F.sum("s").alias("signal_count")).filter(F.col("entity_mentions") >= least_mentions)
    m, s = F.col("entity_mentions"), F.col("signal_count")
    return out.withColumn("relevance", F.least(F.ln(1.0 + m) * 18.0 + F.ln(1.0 + s) * 8.0, F.lit(100.0)))


def combine_beneficiaries(direct: DataFrame, indirect: DataFrame, cap: int = 60, cap_indirect: int = 10, least: float = 8.0) -> DataFrame:
    """Best row a theme and company; direct ones first, indirect ones that are not direct after them."""
    key = F.upper(F.coalesce("ticker", "company"))
    d = direct.filter(F.col("relevance") >= least).withColumn("__k", key).withColumn("kind", F.lit("direct"))
    i = indirect.withColumn("__k", key).withColumn("kind", F.lit("indirect")).join(d.select("theme", "__k"), ["theme", "__k"], "left_anti")
    one = Window.partitionBy("theme", "__k", "kind").orderBy(F.desc("relevance"), "company")
    rows = d.unionByName(i).withColumn("__r", F.row_number().over(one)).filter("__r = 1")
    place = Window.partitionBy("theme", "kind").orderBy(F.desc("relevance"), "company")
    rows = rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= max(cap, cap_indirect)).withColumn("rank", F.col("rank").cast("bigint"))
    return rows.filter(F.col("rank") <= F.when(F.col("kind") == "direct", cap).otherwise(cap_indirect)).drop("__k", "__r")


# --- causal chains -----------------------------------------------------------------------


def tension_chains(facts: DataFrame, first: str, second: str, least_first: int, least_second: int) -> DataFrame:
    """Entities with both signal types over enough companies: counts, lag in days, probability, activation.

    ``facts``: entity, signal_type, company, day. One conditional aggregation, no self-join.
    """
    a, b = F.col("signal_type") == first, F.col("signal_type") == second
    rows = facts.filter(a | b).groupBy("entity").agg(
        F.countDistinct(F.when(a, F.col("company"))).alias("first_companies"),
        F.countDistinct(F.when(b, F.col("company"))).alias("second_companies"),
        count_if(a).alias("first_signals"),
        count_if(b).alias("second_signals"),
        F.min(F.when(a, F.col("day"))).alias("first_day"),
        F.min(F.when(b, F.col("day"))).alias("second_day"),
    )
    rows = rows.filter((F.col("first_companies") >= least_first) & (F.col("second_companies") >= least_second))
    p1 = F.least(F.lit(0.95), 0.6 + 0.05 * F.col("first_companies"))
    p2 = F.least(F.lit(0.95), 0.6 + 0.05 * F.col("second_companies"))
    lag = F.least(F.greatest(F.abs(F.datediff("second_day", "first_day")), F.lit(30)), F.lit(365))
    return rows.withColumn("lag_days", lag).withColumn("p1", p1).withColumn("p2", p2).withColumn("activation", F.col("p1") * F.col("p2") * 100.0).withColumn(
        "chain_id", F.concat(F.lit("data-tension-"), slug(F.col("entity")))
    )


def policy_tension(facts: DataFrame, least_demand: int = 2, least_supply: int = 1, most: int = 40) -> DataFrame:
    """Entities that policy documents name with both demand and bottlenecks; counted by document, since such documents have no company.

    ``facts``: entity, signal_type, doc_id, day of the policy documents. One conditional aggregation.
    """
    a, b = F.col("signal_type") == "demand_surge", F.col("signal_type") == "supply_bottleneck"
    rows = facts.filter((a | b) & (F.length("entity") >= 3)).groupBy("entity").agg(
        F.countDistinct(F.when(a, F.col("doc_id"))).alias("demand_docs"),
        F.countDistinct(F.when(b, F.col("doc_id"))).alias("supply_docs"),
        F.count("*").alias("signals"),
        F.min(F.when(a, F.col("day"))).alias("demand_first"),
        F.min(F.when(b, F.col("day"))).alias("supply_first"),
    )
    rows = rows.filter((F.col("demand_docs") >= least_demand) & (F.col("supply_docs") >= least_supply)).orderBy(F.desc("signals"), "entity").limit(most)
    p1, p2 = F.least(F.lit(0.92), 0.65 + 0.06 * F.col("demand_docs")), F.least(F.lit(0.90), 0.60 + 0.08 * F.col("supply_docs"))
    lag = F.coalesce(F.least(F.greatest(F.abs(F.datediff("supply_first", "demand_first")), F.lit(30)), F.lit(365)), F.lit(90))
    return rows.withColumn("lag_days", lag).withColumn("p1", p1).withColumn("p2", p2).withColumn("activation", F.least(F.col("p1") * F.col("p2") * 100.0, F.lit(100.0))).withColumn(
        "chain_id", F.concat(F.lit("policy-tension-"), F.substring(F.regexp_replace(F.lower("entity"), "[^a-z0-9]+", "-"), 1, 30))
    )


def policy_confirmed(policy: DataFrame, filings: DataFrame, least_docs: int = 2, least_companies: int = 2, most: int = 30) -> DataFrame:
    """Entities with tailwind or demand in policy documents whose demand companies confirm in their filings.

    ``policy``: entity, signal_type, doc_id, day; ``filings``: entity, signal_type, company.
    Both sides are aggregated before they meet, by name in any case.
    """
    said = policy.filter(F.col("signal_type").isin("regulatory_tailwind", "demand_surge") & (F.length("entity") >= 3)).groupBy("entity").agg(
        F.countDistinct("doc_id").alias("policy_docs"), F.min("day").alias("policy_first")
    )
    seen = filings.filter((F.col("signal_type") == "demand_surge") & F.col("company").isNotNull() & (F.col("company") != "") & (F.length("entity") >= 3))
    seen = seen.groupBy(F.col("entity").alias("__e")).agg(F.countDistinct("company").alias("companies"), F.count("*").alias("signals"))
    met = said.filter(F.col("policy_docs") >= least_docs).join(seen.filter(F.col("companies") >= least_companies), F.lower("entity") == F.lower("__e")).drop("__e")
    met = met.orderBy(F.desc("policy_docs"), F.desc("companies"), "entity").limit(most)
    p1, p2 = F.least(F.lit(0.95), 0.70 + 0.05 * F.col("policy_docs")), F.least(F.lit(0.92), 0.65 + 0.04 * F.col("companies"))
    return met.withColumn("p1", p1).withColumn("p2", p2).withColumn("activation", F.least(F.col("p1") * F.col("p2") * 100.0, F.lit(100.0))).withColumn(
        "chain_id", F.concat(F.lit("policy-co-"), F.substring(F.regexp_replace(F.lower("entity"), "[^a-z0-9]+", "-"), 1, 30))
    )


def adoption_pairs(facts: DataFrame, tops: int = 25, pairs: int = 60, least_first: int = 4, least_second: int = 3) -> DataFrame:
    """Adopted technologies times demanded entities, but themselves; both sides are cut before they meet."""
    tech = facts.filter("signal_type = 'technology_adoption'").groupBy(F.col("entity").alias("tech")).agg(F.countDistinct("company").alias("tech_companies"), F.count("*").alias("adoptions"))
    tech = tech.filter(F.col("tech_companies") >= least_first).orderBy(F.desc("adoptions"), "tech").limit(tops)
    down = facts.filter(F.col("signal_type").isin("demand_surge", "capex_increase")).groupBy(F.col("entity").alias("downstream")).agg(
        F.countDistinct("company").alias("down_companies"), F.count("*").alias("demands")
    )
    # of the demanded side no more than pairs + 1 rows can show up
    down = down.filter(F.col("down_companies") >= least_second).orderBy(F.desc("demands"), "downstream").limit(pairs + 1)
    met = tech.join(F.broadcast(down), F.lower("tech") != F.lower("downstream"))
    return met.orderBy(F.desc("adoptions"), F.desc("demands"), "tech", "downstream").limit(pairs)


def score_chains(links: DataFrame, active: DataFrame, aliases=CAUSE_ALIASES) -> DataFrame:
    """Share of link probability whose cause is active, in percent; under two links 0.

    ``links``: chain_id, pos, cause, effect, probability and, if at hand, score;
    ``active``: name. A cause is active if it or an alias is named exactly, if a name
    holds the phrase or an alias that is a phrase, or if a cause that is a phrase holds a
    name. Phrases have two words and eight characters or more, the names they meet four.
    Chains whose id starts with ``data-`` keep their score. Null causes are never active.
    Causes and names are made distinct first and meet by equality or ``contains_join``.
    """
    names = active.select(F.lower("name").alias("__n")).filter("__n is not null").distinct()
    cause = F.lower(F.trim("cause"))
    causes = links.select(cause.alias("__c")).filter("__c is not null").distinct()
    table = links.sparkSession.createDataFrame([(c, a) for c, many in aliases for a in many], "__c string, __f string")  # a fixed table
    own = causes.withColumn("__f", F.col("__c"))
    forms = own.unionByName(causes.join(F.broadcast(table), "__c"))
    phrase = (F.size(F.split("__f", r"\s+")) >= 2) & (F.length("__f") >= 8)
    long_names = names.filter(F.length("__n") >= 4)
    exact = forms.join(names, F.col("__f") == F.col("__n")).select("__c")
    inside = contains_join(long_names, "__n", forms.filter(phrase), "__f").select("__c")
    around = contains_join(own.filter(phrase), "__f", long_names, "__n").select("__c")
    on = exact.unionByName(inside).unionByName(around).distinct().withColumn("__a", F.lit(1))
    kept = F.max("score") if "score" in links.columns else F.lit(None).cast("double")
    out = links.withColumn("__c", cause).join(on, "__c", "left").groupBy("chain_id").agg(
        F.count("*").alias("depth"), F.sum("probability").alias("__all"), F.sum(F.when(F.col("__a") == 1, F.col("probability")).otherwise(0.0)).alias("__on"), kept.alias("__kept")
    )
    mined = F.col("chain_id").cast("string").startswith("data-") & F.col("__kept").isNotNull()
    share = F.when(F.coalesce("__all", F.lit(0.0)) <= 0, 0.0).otherwise(F.col("__on") / F.col("__all") * 100.0)
    return out.select("chain_id", "depth", F.when(F.col("depth") < 2, 0.0).when(mined, F.col("__kept")).otherwise(share).alias("score"))


def second_order(links: DataFrame) -> DataFrame:
    """Links past the first of each chain."""
    return links.filter("pos >= 1")


def window_activation(companies: Column, signals: Column) -> Column:
    """Score of a chain by the companies and signals of a window, 20 to 100."""
    by = 0.5 * F.least(F.ln(1.0 + companies) / F.ln(F.lit(601.0)), F.lit(1.0)) + 0.5 * F.least(F.ln(1.0 + signals) / F.ln(F.lit(5001.0)), F.lit(1.0))
    return F.greatest(F.lit(20.0), 20.0 + 80.0 * by)


# --- contradictions ----------------------------------------------------------------------

# Phrases of either mood, and reversed pairs.
POSITIVE = ("strong demand", "accelerating", "record", "robust", "exceeded expectations", "ramping", "expanding", "growth", "confident", "increasing capacity")
NEGATIVE = ("weak demand", "slowing", "declining", "headwind", "below expectations", "delayed", "cutting", "inventory correction", "cautious", "oversupply")
REVERSALS = (("expanding", "cutting"), ("accelerating", "slowing"), ("strong demand", "weak demand"), ("increasing capacity", "oversupply"))


def contradictions(texts: DataFrame, threshold: float = 0.35, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE, reversals=REVERSALS) -> DataFrame:
    """Swings of mood between consecutive rows of a company and entity.

    ``texts``: company, entity, period (sortable), text. Consecutive means the row before,
    by period; sentiment is computed once a row.
    """
    w = Window.partitionBy("company", "entity").orderBy("period")
    rows = texts.withColumn("mood", sentiment(F.col("text"), positive, negative))
    rows = rows.withColumn("from_period", F.lag("period").over(w)).withColumn("from_mood", F.lag("mood").over(w)).withColumn("__before", F.lag("text").over(w))
    rows = rows.filter("from_period is not null").withColumn("delta", F.col("mood") - F.col("from_mood")).filter(F.abs("delta") >= threshold)
    low, before = F.lower("text"), F.lower("__before")
    pairs = sum((F.when((F.contains(before, F.lit(a)) & F.contains(low, F.lit(b))) | (F.contains(before, F.lit(b)) & F.contains(low, F.lit(a))), 1).otherwise(0) for a, b in reversals), F.lit(0))
    kind = F.when(F.col("delta") < 0, "positive_to_negative").otherwise("negative_to_positive")
    return rows.withColumn("pairs", pairs).withColumn("change", kind).withColumn("confidence", F.least(F.lit(1.0), F.abs("delta") * 0.8 + F.col("pairs") * 0.25)).drop("__before", "text")


# --- topics ------------------------------------------------------------------------------


def trend_class(velocity: Column, acceleration: Column, v: float = 0.15, a: float = 0.10) -> Column:
    """Phase of a topic by its last velocity and acceleration."""
    return (
        F.when((velocity >= v) & (acceleration >= a), "EMERGING")
        .when((velocity >= v) & (acceleration >= 0), "SURGING")
        .when((velocity >= 0) & (acceleration < 0), "PEAKING")
        .when((velocity < 0) & (acceleration < 0), "DECLINING")
        .when(velocity < -v, "DORMANT")
        .otherwise("STABLE")
    )


def trend_score(count: Column, velocity: Column, acceleration: Column, kind: Column) -> Column:
    """Composite 0 to 100 of the last count, velocity, acceleration and phase."""
    bonus = F.when(kind == "EMERGING", 10.0).when(kind == "SURGING", 8.0).when(kind == "STABLE", 4.0).when(kind == "PEAKING", 2.0).otherwise(0.0)
    by = F.least(count * 5.0, F.lit(40.0)) + clamp(velocity * 100.0, 0.0, 30.0) + clamp(acceleration * 100.0, 0.0, 20.0) + bonus
    return F.least(by, F.lit(100.0))


def emerging(now: Column, before: Column, least: int = 3, growth: float = 0.5) -> Column:
    """Whether a topic is new with enough documents, or grew by half."""
    before = F.coalesce(before, F.lit(0))
    return F.when(before == 0, now >= least).otherwise((now - before) / before >= growth)


def quarterly_composite(mentions: Column, growth: Column, companies: Column, confidence: Column, capex: Column, streak: Column) -> Column:
    """Quarterly strength of a theme, decayed where mentions fall by more than 30 percent."""

    def part(x: Column, full: float) -> Column:
        return F.least(F.ln(1.0 + x) / F.ln(F.lit(1.0 + full)), F.lit(1.0))

    score = (
        0.25 * part(mentions, 100.0)
        + 0.20 * (0.5 + 0.5 * F.tanh(1.5 * growth))
        + 0.15 * part(companies, 20.0)
        + 0.20 * confidence
        + 0.10 * part(capex, 10.0)
        + 0.10 * F.least(F.sqrt(streak.cast("double")) / 4.0, F.lit(1.0))
    )
    return score * F.when(growth < -0.30, F.greatest(F.lit(0.60), 1.0 + growth * 0.5)).otherwise(1.0)


def tracker_confidence(strong: Column, boosts: Column, weak: Column) -> Column:
    """Confidence of a theme's mentions in a document by pattern hits."""
    return clamp((strong + 1.5 * boosts - 0.5 * weak) / 8.0, 0.0, 1.0)


# --- canonical themes --------------------------------------------------------------------


def theme_tokens(themes: DataFrame) -> DataFrame:
    """What two themes are compared by: slug, words, parts of the slug, companies, supply terms and first day."""
    text = F.concat_ws(" ", "name", F.substring("description", 1, 100))

    def kept(column: Column, cut: str, stops: tuple[str, ...]) -> Column:
        return F.filter(F.array_distinct(F.split(F.lower(column), cut)), lambda w: (F.length(w) >= 3) & ~w.isin(*stops))

    whole = F.lower(F.concat_ws(" ", "name", "description"))
    supply = F.filter(F.array(*[F.lit(t) for t in SUPPLY_TERMS]), lambda t: F.contains(whole, t))
    companies = F.array_distinct(F.array_compact(F.coalesce("companies", F.array().cast("array<string>"))))
    return themes.select("slug", kept(text, WORD_CUT, THEME_STOPS).alias("w"), kept(F.col("slug"), r"[-_\s]+", SLUG_STOPS).alias("s"), companies.alias("c"), supply.alias("p"), F.col("first_day").alias("d"))


def theme_pairs(tokens: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a < b) that can reach the threshold, by rare tokens; none that does is missed.

    Time and supply give 0.20 at most, so the three sets must give the rest of the
    threshold, and one of them has a Jaccard index of at least rest / 0.80. Two sets that
    alike share one of their rarest tokens, the prefix of prefix filtering: tokens are
    ordered by rarity, and a common word meets only themes that have nothing rarer.
    """
    least = (threshold - 0.20) / 0.80 - 1e-9
    if least <= 0:
        raise ValueError("a threshold of 0.20 or less links themes that share nothing")
    rows = None
    for part in ("w", "s", "c"):
        one = tokens.select("slug", F.lit(part).alias("part"), F.size(part).alias("n"), F.explode(part).alias("token"))
        rows = one if rows is None else rows.unionByName(one)
    uses = rows.groupBy("part", "token").agg(F.count("*").alias("uses"))
    place = F.row_number().over(Window.partitionBy("slug", "part").orderBy("uses", "token"))
    keys = rows.join(uses, ["part", "token"]).withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    keys = keys.select("part", "token", "slug")
    a, b = keys.withColumnRenamed("slug", "a"), keys.withColumnRenamed("slug", "b")
    return a.join(b, ["part", "token"]).filter("a < b").select("a", "b").distinct()


def canonical_themes(themes: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Single-linkage groups of like themes; the strongest of a group names it.

    ``themes``: slug (unique), name, description, strength, first_day, companies (array).
    The score is 0.35 of the words', 0.25 of the companies' and 0.20 of the slug parts'
    Jaccard index, 0.10 for first days within 90 days (falling to none at 365; 0.5 of it
    if one is null) and 0.10 of the supply terms' index (0.5 of it if neither has any).
    Null texts count as empty; empty sets are alike to none.
    """
    t = written(theme_tokens(themes))
    cols = [c for c in t.columns if c != "slug"]
    pairs = theme_pairs(t, threshold)
    pairs = pairs.join(t.select(F.col("slug").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols]), "a")
    pairs = pairs.join(t.select(F.col("slug").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols]), "b")

    def alike(part: str) -> Column:
        return jaccard(F.col(f"a_{part}"), F.col(f"b_{part}"))

    gap = F.abs(F.datediff("a_d", "b_d"))
    near = F.when(gap.isNull(), 0.5).when(gap <= 90, 1.0).when(gap >= 365, 0.0).otherwise(1.0 - (gap - 90) / 275.0)
    supply = F.when((F.size("a_p") == 0) & (F.size("b_p") == 0), 0.5).otherwise(alike("p"))
    score = 0.35 * alike("w") + 0.25 * alike("c") + 0.20 * alike("s") + 0.10 * near + 0.10 * supply
    linked = pairs.withColumn("score", score).filter(F.col("score") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = components(linked).withColumnsRenamed({"node": "slug"})
    named = themes.join(groups, "slug", "left").withColumn("component", F.coalesce("component", "slug"))
    parts = named.groupBy("component").agg(
        F.max_by("slug", F.struct(F.col("strength"), F.col("slug"))).alias("canonical_slug"),
        F.substring(F.sha1(F.array_join(F.array_sort(F.collect_set("slug")), "|").cast("binary")), 1, 16).alias("cluster_id"),
        F.count("*").alias("members"),
    )
    return named.join(parts, "component").select("slug", "canonical_slug", "cluster_id", "members", (F.col("slug") == F.col("canonical_slug")).alias("is_canonical"))


# --- macro -------------------------------------------------------------------------------


def threshold_events(latest: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose threshold the latest value of their series crosses, strictly.

    ``latest``: series_id, obs_date, value; ``rules``: series_id, direction (above or
    below), threshold, event_type, severity. Rules are a small table.
    """
    hit = ((F.col("direction") == "above") & (F.col("value") > F.col("threshold"))) | ((F.col("direction") == "below") & (F.col("value") < F.col("threshold")))
    return latest.join(F.broadcast(rules), "series_id").filter(hit)


def macro_scores(themes: DataFrame, events: DataFrame, links: DataFrame) -> DataFrame:
    """Net macro score of themes: links of an event type whose keyword the theme names.

    ``links``: event_type, keyword, link_type, strength; constraints count against.
    """
    met = events.select("event_type").distinct().join(F.broadcast(links), "event_type")
    named = F.contains(F.lower("theme"), F.lower("keyword"))
    rows = themes.select("theme").join(F.broadcast(met), named).dropDuplicates(["theme", "event_type", "link_type", "strength"])
    sign = F.when(F.col("link_type") == "constrains", -F.col("strength")).otherwise(F.col("strength"))
    return themes.select("theme").join(rows.groupBy("theme").agg(F.sum(sign).alias("macro_score"), F.count("*").alias("links")), "theme", "left").fillna(0)


def magnitude_weight(magnitude: Column) -> Column:
    return F.when(magnitude == "low", 0.25).when(magnitude == "high", 0.75).when(magnitude == "game_changer", 1.0).otherwise(0.5)


def macro_pressure(events: DataFrame, keys: list[str]) -> DataFrame:
    """Net pressure (p - n) / (p + n) of events with direction and magnitude."""
    w = magnitude_weight(F.col("magnitude"))
    out = events.groupBy(*keys).agg(
        F.sum(F.when(F.col("direction") == "positive", w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("direction") == "negative", w).otherwise(0.0)).alias("n"), F.count("*").alias("events")
    )
    return out.withColumn("net", F.when(F.col("p") + F.col("n") > 0, (F.col("p") - F.col("n")) / (F.col("p") + F.col("n"))).otherwise(0.0))


# --- India layers ------------------------------------------------------------------------


def capacity_gaps(targets: DataFrame, ratios: DataFrame, domestic: DataFrame) -> DataFrame:
    """Required against domestic capacity of components; rows with a gap, with its severity."""
    rows = targets.join(F.broadcast(ratios), "sector").join(F.broadcast(domestic), "component")
    rows = rows.withColumn("required", F.col("value") * F.col("ratio")).withColumn("gap", F.col("required") - F.col("capacity")).filter("gap > 0")
    pct = F.col("gap") / F.col("required") * 100.0
    level = F.when(pct >= 80, "critical").when(pct >= 60, "high").when(pct >= 35, "moderate").otherwise("low")
    return rows.withColumn("gap_pct", pct).withColumn("severity", level)


def import_risk(share: Column) -> Column:
    return F.when(share >= 0.85, "critical").when(share >= 0.65, "high").otherwise("moderate")


def localization(dependencies: DataFrame, schemes: DataFrame, least_share: float = 0.60) -> DataFrame:
    """Opportunity score of replaceable imports in sectors with incentives."""
    n = schemes.groupBy("sector").agg(F.count("*").alias("schemes"))
    rows = dependencies.filter((F.col("share") >= least_share) & F.col("substitutable")).join(n, "sector")
    score = (
        0.35 * F.col("share")
        + 0.25 * F.least(F.col("schemes") / 4.0, F.lit(1.0))
        + 0.20 * F.greatest(F.lit(0.0), 1.0 - F.col("horizon_years") / 10.0)
        + 0.20 * F.least(F.col("value_bn") / 5.0, F.lit(1.0))
    )
    return rows.withColumn("score", score)


# Sector rules of tenders in order, and sector weights.
TENDER_RULES = (
    ("solar", r"solar|photovoltaic"), ("wind", r"wind (?:power|turbine|farm)"), ("power_transmission", r"transmission|substation|transformer"),
    ("railway_infrastructure", r"rail|metro|locomotive"), ("battery_storage", r"battery|energy storage"), ("5g_telecom", r"5g|telecom|optical fib"),
    ("defense_electronics", r"defen[cs]e|radar|missile"), ("electronics_manufacturing", r"semiconductor|electronics|pcb"), ("water_infrastructure", r"water|sewage|irrigation"),
)
TENDER_WEIGHTS = {
    "solar": 0.75, "power_transmission": 0.85, "railway_infrastructure": 0.80, "electronics_manufacturing": 0.70, "battery_storage": 0.75,
    "5g_telecom": 0.65, "defense_electronics": 0.70, "water_infrastructure": 0.55, "wind": 0.65, "infrastructure": 0.40,
}


def tender_sector(title: Column) -> Column:
    out = F.lit("infrastructure")
    for name, pattern in reversed(TENDER_RULES):
        out = F.when(title.rlike(f"(?iu){pattern}"), name).otherwise(out)
    return out


def tender_strength(sector: Column, crore: Column) -> Column:
    """Weight of the sector plus up to 0.20 by size."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TENDER_WEIGHTS.items() for x in kv]), sector), F.lit(0.40))
    return F.least(F.lit(1.0), base + F.coalesce(F.least(crore / 5000.0, F.lit(0.20)), F.lit(0.0)))


def policy_targets(docs: DataFrame, keyword: str, window: int = 120, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, value, unit, year): quantities near a keyword and the next year named after them."""
    pattern = rf"(?iu)\Q{keyword}\E.{{0,{window}}}?([0-9][0-9,]*(?:\.[0-9]+)?)\s?(GW|MW|km|million|billion|crore|units|%).{{0,{window}}}?(?:by|until|in)\s(20[0-9]{{2}})"
    hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(hits).alias("hit"))
    return rows.select(
        "doc_id",
        F.regexp_replace(F.regexp_extract("hit", pattern, 1), ",", "").cast("double").alias("value"),
        F.regexp_extract("hit", pattern, 2).alias("unit"),
        F.regexp_extract("hit", pattern, 3).cast("int").alias("year"),
    )


def order_pressure(docs: DataFrame, rules: tuple[tuple[str, str, float], ...], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """First match of each rule (kind, pattern, strength) in a document, with its wording."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("strength"), F.regexp_extract(F.col(text), f"(?iu){p}", 0).alias("hit")) for k, p, s in rules])
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.filter(found, lambda r: r["hit"] != "")).alias("r")).select("doc_id", "r.kind", "r.strength", "r.hit")


def discovery_conviction(signals: Column, capex: Column, supply: Column, orders: Column) -> Column:
    """Conviction of a discovered beneficiary: volume, capital, orders and supply evidence."""
    return (
        0.4 * F.least(signals / 20.0, F.lit(1.0)) + 0.4 * F.least(capex / 5.0, F.lit(1.0)) + 0.1 * F.when(orders, 1.0).otherwise(0.0) + 0.1 * F.least(supply / 5.0, F.lit(1.0))
    )


# Phrases by the role they speak for.
ROLE_PATTERNS = {
    "supplier": (r"we supply", r"supplier of", r"our customers include", r"deliver(?:ed|ing)? components"),
    "bottleneck_player": (r"sole source", r"sold out", r"capacity constrained", r"limited supply"),
    "infrastructure_provider": (r"infrastructure", r"data center", r"power grid", r"network operator"),
    "beneficiary": (r"benefit(?:ing|s)? from", r"tailwind", r"growing demand"),
}


def roles(text: Column, patterns: dict[str, tuple[str, ...]] = ROLE_PATTERNS) -> Column:
    """Array of (role, hits, confidence) with at least one hit; beneficiary if none."""
    made = F.array(*[F.struct(F.lit(k).alias("role"), F.regexp_count(text, F.lit("(?iu)" + "|".join(ps))).alias("hits")) for k, ps in patterns.items()])
    hit = F.transform(F.filter(made, lambda r: r["hits"] > 0), lambda r: F.struct(r["role"].alias("role"), r["hits"].alias("hits"), F.least(r["hits"] / 10.0, F.lit(1.0)).alias("confidence")))
    default = F.array(F.struct(F.lit("beneficiary").alias("role"), F.lit(0).alias("hits"), F.lit(0.0).alias("confidence")))
    return F.when(F.size(hit) > 0, hit).otherwise(default)


def known_roles(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """``mentions`` (company, theme, text and more) with roles: those of the known list, else those of the text.

    ``known``: fragment, theme, pos and roles (array of names). The entry of least pos counts whose
    theme is equal and whose fragment the company's name holds; it has confidence 0.95. The
    list is joined on the theme, and distinct (company, theme) pairs alone meet it.
    """
    pairs = mentions.select("company", "theme").distinct()
    listed = known.select(F.col("theme").alias("__t"), F.lower("fragment").alias("__f"), "pos", F.col("roles").alias("__r"))
    met = pairs.join(listed, (F.col("theme") == F.col("__t")) & F.contains(F.lower("company"), F.col("__f")))
    found = met.groupBy(F.col("company").alias("__c"), F.col("theme").alias("__th")).agg(F.min_by("__r", "pos").alias("__known"))
    joined = mentions.join(found, F.col("company").eqNullSafe(F.col("__c")) & F.col("theme").eqNullSafe(F.col("__th")), "left")
    listed_roles = F.transform("__known", lambda r: F.struct(r.alias("role"), F.lit(0).alias("hits"), F.lit(0.95).alias("confidence")))
    out = F.when(F.col("__known").isNotNull(), listed_roles).otherwise(roles(F.col("text")))
    return joined.withColumn("roles", out).withColumn("from_known_list", F.col("__known").isNotNull()).drop("__c", "__th", "__known")


# --- exploding themes --------------------------------------------------------------------


def velocity_pct(recent: Column, prior: Column) -> Column:
    """Growth in whole percent; 200 from nothing."""
    return F.when(prior == 0, 200.0).otherwise(F.floor((recent / F.nullif(prior, F.lit(0)) - 1.0) * 100.0 + 0.5).cast("double"))


def explosion_score(velocity: Column, companies: Column, concentration: Column, recent: Column) -> Column:
    """Acceleration, breadth, purity and volume of a theme."""
    return (
        0.40 * clamp((velocity + 100.0) / 200.0, 0.0, 1.0)
        + 0.30 * F.least(F.ln(1.0 + companies) / F.ln(F.lit(31.0)), F.lit(1.0))
        + 0.15 * concentration
        + 0.15 * F.least(recent / 200.0, F.lit(1.0))
    )
