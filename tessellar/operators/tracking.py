"""Per-document theme tracking, entity clean-up, keyword derivation and narrative spread."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.operators.intelligence import magnitude_weight, tracker_confidence

# Wording of sure, unsure and negative statements.
STRONG = (r"\bcommitted\b", r"\bstrong(?:ly)?\b", r"\bconfident\b", r"\baccelerat\w+\b", r"\brecord\b", r"\brobust\b", r"\bsignificant(?:ly)?\b", r"\bpositiv(?:e|ely)\b")
WEAK = (r"\bhope(?:ful)?\b", r"\bexpect(?:ing)?\b", r"\banticipat(?:e|ing)\b", r"\bpossibly\b", r"\bpotential(?:ly)?\b", r"\bmight\b", r"\bcould\b")
NEGATIVE = (r"\bheadwind\b", r"\binventory correction\b", r"\bdestocking\b", r"\bweak demand\b", r"\bpressure\b", r"\bchallenging\b", r"\bsluggish\b", r"\bdecline\b", r"\bdrop\b", r"\bfall(?:ing)?\b")


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """Number of patterns that occur in the text, any case."""
    return sum((F.when(text.rlike(f"(?iu){p}"), 1).otherwise(0) for p in patterns), F.lit(0))


def track_theme(
    docs: DataFrame, keywords: tuple[str, ...], boosters: tuple[str, ...], capex: tuple[str, ...], doc_id: str = "doc_id", text: str = "text",
    strong: tuple[str, ...] = STRONG, weak: tuple[str, ...] = WEAK, negative: tuple[str, ...] = NEGATIVE, window: int = 150, most: int = 10,
) -> DataFrame:
    """Mentions of a theme in each document that has any: count, confidence, capital, mood, strength.

    The wording around the first ``most`` mentions is judged, ``window`` characters to each side.
    """
    words = "|".join(re.escape(k) for k in keywords)
    t = F.col("__t")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t"))
    rows = rows.withColumn("mentions", F.regexp_count(t, F.lit(rf"(?iu)\b(?:{words})\b"))).filter("mentions > 0")
    around = F.regexp_extract_all(t, F.lit(rf"(?isu).{{0,{window}}}\b(?:{words})\b.{{0,{window}}}"), F.lit(0))
    rows = rows.withColumn("__c", F.array_join(F.slice(around, 1, most), " "))
    literal = lambda ks: tuple(rf"\b{re.escape(k)}\b" for k in ks)
    c = F.col("__c")
    rows = rows.withColumn("confidence", tracker_confidence(hits(c, strong), hits(c, literal(boosters)), hits(c, weak))).withColumn("capex", hits(c, literal(capex)))
    rows = rows.withColumn("negative", hits(c, negative) >= 2)
    return rows.withColumn("strength", document_strength(F.col("mentions"), F.col("confidence"), F.col("capex"), F.col("negative"))).drop("__t", "__c")


def document_strength(mentions: Column, confidence: Column, capex: Column, negative: Column) -> Column:
    """Strength of a theme in one document, lowered by negative wording."""
    share = lambda x, full: F.least(F.ln(1.0 + x) / F.ln(F.lit(1.0 + full)), F.lit(1.0))
    return (0.40 * share(mentions, 100.0) + 0.35 * confidence + 0.25 * share(capex, 10.0)) * F.when(negative, 0.70).otherwise(1.0)


def dedupe_entities(entities: DataFrame, least: int = 2, most: int = 300) -> DataFrame:
    """One row a document, name (any case) and type, the most confident; at most ``most`` a document.

    Expects doc_id, canonical_name, entity_type, confidence.
    """
    rows = entities.filter(F.length(F.trim("canonical_name")) >= least)
    one = Window.partitionBy("doc_id", F.lower("canonical_name"), "entity_type").orderBy(F.desc("confidence"), "canonical_name")
    rows = rows.withColumn("__r", F.row_number().over(one)).filter("__r = 1")
    cap = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "canonical_name", "entity_type")
    return rows.withColumn("__r", F.row_number().over(cap)).filter(F.col("__r") <= most).drop("__r")


def inject_filers(entities: DataFrame, filings: DataFrame) -> DataFrame:
    """Add each filing's own company as a COMPANY entity of full confidence, unless it is there."""
    own = filings.filter("company is not null and company <> ''").select("doc_id", F.col("company").alias("canonical_name"), F.lit("COMPANY").alias("entity_type"), F.lit(1.0).alias("confidence"))
    return dedupe_entities(entities.select("doc_id", "canonical_name", "entity_type", "confidence").unionByName(own))


def inject_from_contexts(signals: DataFrame, rules: tuple[tuple[str, str, str], ...], least: int = 20) -> DataFrame:
    """(doc_id, canonical_name, entity_type) of the first rule (name, type, pattern) that a signal's context meets."""
    found = F.lit(None).cast("struct<n:string,t:string>")
    for name, kind, pattern in reversed(rules):
        found = F.when(F.col("context").rlike(f"(?iu){pattern}"), F.struct(F.lit(name).alias("n"), F.lit(kind).alias("t"))).otherwise(found)
    rows = signals.filter(F.length("context") >= least).withColumn("__f", found).filter("__f is not null")
    return rows.select("doc_id", F.col("__f.n").alias("canonical_name"), F.col("__f.t").alias("entity_type")).distinct()


# Labels that themes end on, and further words for an entity.
THEME_LABELS = (
    "Demand Surge → Capex Response", "Demand Surge → Supply Constraint", "Demand-Supply Tension", "Supply Chain Buildout", "Demand Acceleration", "Technology Adoption",
    "Critical Shortage", "Severe Constraint", "Supply Bottleneck", "Supply Constraint", "Power Constraint", "Demand Surge", "Capex Buildout", "Capex Surge", "Supply Chain",
    "Bottleneck", "Constraint", "Shortage", "Buildout",
)
MORE_WORDS = {
    "ai": ("artificial intelligence", "machine learning", "llm"), "artificial intelligence": ("ai", "machine learning"), "data center": ("datacenter", "data centre"),
    "semiconductor": ("chip", "wafer", "foundry", "fab"), "chip": ("semiconductor", "microchip"), "electric vehicle": ("ev", "bev", "phev"), "cloud": ("cloud computing", "hyperscaler"),
}


def theme_keywords(slug: Column, name: Column) -> Column:
    """Keywords of a theme: of ``downstream-a-via-b`` b, its further words and a; else the entity in the name and its further words."""
    down = F.regexp_extract(slug, r"^downstream-(.+?)-via-(.+)$", 1), F.regexp_extract(slug, r"^downstream-(.+?)-via-(.+)$", 2)
    labels = "|".join(re.escape(x) for x in sorted(THEME_LABELS, key=len, reverse=True))
    entity = F.trim(F.regexp_replace(F.regexp_replace(name, rf"\s+(?:{labels})$", ""), r"\s+→.*$|:$", ""))
    driver = F.when(down[1] != "", F.replace(down[1], F.lit("-"), F.lit(" "))).otherwise(F.lower(entity))
    sector = F.when(down[0] != "", F.replace(down[0], F.lit("-"), F.lit(" ")))
    table = F.create_map(*[x for k, v in MORE_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    more = F.coalesce(F.try_element_at(table, driver), F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(F.array(driver), more, F.array(sector))))


def match_events(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(event_id, theme, relevance): themes whose keyword pattern an event's wording meets, where it names none itself.

    ``events``: event_id, title, description, magnitude, themes (array); ``rules``: theme, pattern, a small table.
    """
    text = F.lower(F.concat_ws(" ", "title", "description"))
    own = events.filter(F.size("themes") > 0).select("event_id", "magnitude", F.explode("themes").alias("theme"))
    rest = events.filter(F.coalesce(F.size("themes"), F.lit(0)) <= 0).join(F.broadcast(rules), F.rlike(text, F.col("pattern")))
    rows = own.unionByName(rest.select("event_id", "magnitude", "theme"))
    return rows.dropDuplicates(["event_id", "theme"]).select("event_id", "theme", magnitude_weight(F.col("magnitude")).alias("relevance"))


def narrative_spread(mentions: DataFrame, days: int = 30, confirmed: int = 3) -> DataFrame:
    """Origin, sectors, companies, mentions a window and confirmation of each narrative.

    ``mentions``: narrative, company, sector, day.
    """
    out = mentions.groupBy("narrative").agg(
        F.min_by("company", F.struct("day", "company")).alias("origin"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.array_sort(F.collect_set("sector")).alias("sectors"),
        F.countDistinct("company").alias("companies"),
        F.count("*").alias("n"),
    )
    spans = F.greatest(F.ceil((F.datediff("last_day", "first_day") + 1) / float(days)), F.lit(1))
    return out.withColumn("velocity", F.col("n") / spans).withColumn("confirmed", F.size("sectors") >= confirmed)


def freshness(first_seen: Column, as_of: Column) -> Column:
    """Fresh to 90 days, Active to 365, else Mature."""
    age = F.datediff(as_of, first_seen)
    return F.when(age <= 90, "Fresh").when(age <= 365, "Active").otherwise("Mature")


# Relation that a signal type stands for.
SIGNAL_RELATIONS = {
    "capex_increase": "INVESTS_IN", "technology_adoption": "USES", "partnership_formed": "INVESTS_IN", "acquisition_intent": "ACQUIRES",
    "technology_disruption": "DISRUPTS", "regulatory_tailwind": "REGULATED_BY", "regulatory_headwind": "REGULATED_BY",
}


def signal_edges(signals: DataFrame) -> DataFrame:
    """Edges (src, rel, dst, weight) from (company, entity, signal_type, confidence); weights add up."""
    rel = F.try_element_at(F.create_map(*[F.lit(x) for kv in SIGNAL_RELATIONS.items() for x in kv]), F.col("signal_type"))
    rows = signals.withColumn("rel", rel).filter("rel is not null")
    return rows.groupBy(F.col("company").alias("src"), "rel", F.col("entity").alias("dst")).agg(F.sum("confidence").alias("weight"))


def hierarchy_edges(canonical: DataFrame) -> DataFrame:
    """SUB_THEME_OF edges from the rows of canonical themes (slug, canonical_slug)."""
    return canonical.filter("slug <> canonical_slug").select(F.col("slug").alias("src"), F.lit("SUB_THEME_OF").alias("rel"), F.col("canonical_slug").alias("dst"), F.lit(1.0).alias("weight"))


def macro_edges(indicator_links: DataFrame, sector_inputs: DataFrame, exports: DataFrame) -> DataFrame:
    """Edge frames of the macro graph: indicators to themes, inputs to sectors, countries to commodities."""
    a = indicator_links.select(F.col("series_id").alias("src"), F.upper("link_type").alias("rel"), F.col("theme").alias("dst"), F.col("strength").cast("double").alias("weight"))
    b = sector_inputs.select(F.col("commodity").alias("src"), F.lit("INPUT_TO").alias("rel"), F.col("sector").alias("dst"), F.col("share").cast("double").alias("weight"))
    c = exports.select(F.col("country").alias("src"), F.lit("EXPORTS").alias("rel"), F.col("commodity").alias("dst"), F.col("share").cast("double").alias("weight"))
    return a.unionByName(b).unionByName(c)


def fact_changes(facts: DataFrame, keys: list[str], value: str, start: str = "valid_from") -> DataFrame:
    """Timeline of a fact: each row whose value differs from the row before it, with that value."""
    w = Window.partitionBy(*keys).orderBy(start)
    rows = facts.withColumn("previous", F.lag(value).over(w))
    return rows.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def graph_context(edges: DataFrame, entities: list[str], hubs: int = 5, evidence: DataFrame | None = None, most: int = 20) -> dict[str, DataFrame]:
    """Retrieval for a question: neighbours of the named entities, the busiest hubs, and their best evidence."""
    named = F.col("src").isin(*entities) | F.col("dst").isin(*entities)
    near = edges.filter(named).orderBy(F.desc("weight"), "src", "dst").limit(most)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    out = {"neighbours": near, "hubs": ends.orderBy(F.desc("degree"), "node").limit(hubs)}
    if evidence is not None:
        out["evidence"] = evidence.filter(F.col("entity").isin(*entities)).orderBy(F.desc("confidence"), "doc_id").limit(most)
    return out
