"""Tracking operators and stream windows."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tessellar.operators import tracking as K
from tessellar.streaming import windows as S

SF = "/root/testdata/sf0.001"


def test_theme_tracking(spark):
    text = "We are committed to AI with strong growth. AI capex rises. Weak demand and pressure elsewhere. paints are not it"
    df = spark.createDataFrame([(1, text), (2, "paint"), (3, None)], "doc_id int, text string")
    got = K.track_theme(df, ("ai",), ("growth",), ("capex",)).collect()
    assert [r["doc_id"] for r in got] == [1]
    r = got[0]
    assert r["mentions"] == 2 and math.isclose(r["confidence"], (2 + 1.5) / 8) and r["capex"] == 1 and r["negative"]
    want = (0.40 * math.log(3) / math.log(101) + 0.35 * 3.5 / 8 + 0.25 * math.log(2) / math.log(11)) * 0.7
    assert math.isclose(r["strength"], want)


def test_theme_keywords(spark):
    rows = [("downstream-energy-via-chip", "x"), ("auto-semiconductor", "Semiconductor Supply Bottleneck"), ("auto", "AI Demand Surge → Capex Response"), ("s", "Steel")]
    df = spark.createDataFrame(rows, "slug string, name string").select(K.theme_keywords(F.col("slug"), F.col("name")).alias("k"))
    got = [r["k"] for r in df.collect()]
    assert got[0] == ["chip", "semiconductor", "microchip", "energy"] and got[1][:2] == ["semiconductor", "chip"]
    assert got[2] == ["ai", "artificial intelligence", "machine learning", "llm"] and got[3] == ["steel"]


def test_entities_and_injection(spark):
    e = spark.createDataFrame([(1, "HBM", "T", 0.5), (1, "hbm", "T", 0.9), (1, "x", "T", 0.9), (1, "Co", "COMPANY", 0.2)], "doc_id int, canonical_name string, entity_type string, confidence double")
    f = spark.createDataFrame([(1, "CO"), (2, ""), (3, None)], "doc_id int, company string")
    got = {(r["canonical_name"], r["confidence"]) for r in K.inject_filers(e, f).collect()}
    assert got == {("hbm", 0.9), ("CO", 1.0)}
    s = spark.createDataFrame([(1, "solar park and wind farm expansion"), (1, "short"), (2, None)], "doc_id int, context string")
    rules = (("Solar", "SECTOR", "solar"), ("Wind", "SECTOR", "wind"))
    assert [(r["doc_id"], r["canonical_name"]) for r in K.inject_from_contexts(s, rules).collect()] == [(1, "Solar")]


def test_events_narratives_and_facts(spark):
    e = spark.createDataFrame([(1, "Chip ban", "x", "high", []), (2, "rain", None, "low", ["own"]), (3, None, None, None, None)], "event_id int, title string, description string, magnitude string, themes array<string>")
    rules = spark.createDataFrame([("semis", "chip"), ("semis", "ban")], "theme string, pattern string")
    assert {(r["event_id"], r["theme"], r["relevance"]) for r in K.match_events(e, rules).collect()} == {(1, "semis", 0.75), (2, "own", 0.25)}
    day = dt.date(2024, 1, 1)
    m = spark.createDataFrame([("n", "a", s, day + dt.timedelta(days=i * 20)) for i, s in enumerate("xyz")], "narrative string, company string, sector string, day date")
    r = K.narrative_spread(m).first()
    assert r["origin"] == "a" and r["confirmed"] and r["velocity"] == 1.5
    facts = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b")], "k string, valid_from int, v string")
    assert [(r["valid_from"], r["previous"]) for r in K.fact_changes(facts, ["k"], "v").collect()] == [(3, "a")]
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 5.0)], "src string, dst string, weight double")
    ctx = K.graph_context(edges, ["a"], hubs=1)
    assert ctx["hubs"].first()["node"] == "b" and ctx["neighbours"].count() == 1


def test_streams_equal_batch(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r["hour"], r["event_type"]): r["n"] for r in S.hourly_counts(spark, SF).collect()}
    want = batch.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").count().collect()
    assert got == {(r["hour"], r["event_type"]): r["count"] for r in want}
    kept = S.deduplicated(spark, SF).agg(F.sum("n")).first()[0]
    assert kept >= batch.select("user_id", "event_type").distinct().count()
    s = S.drain(S.sessions(S.event_stream(spark, SF), "30 minutes", "1 hour", "user_id"), "append")
    assert s.count() > 0
    look = S.drain(S.sliding(S.event_stream(spark, SF), "2 days", "1 day", "1 hour"), "complete")
    assert look.agg(F.sum("n")).first()[0] == 2 * batch.count()
