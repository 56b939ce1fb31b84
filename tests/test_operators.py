"""Operators on hand-written fixtures, with hand-computed values and properties."""

import datetime as dt
import json
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.config import Config
from tessellar.functions import scalars as S
from tessellar.operators import graph as G
from tessellar.operators import intelligence as I
from tessellar.operators import ranking as K
from tessellar.operators import relational as R
from tessellar.operators import text as T
from tessellar.operators import themes as TH
from tessellar.operators import upsert as U
from tessellar.operators import vectors as V
from tessellar.operators import windows as W
from tessellar import queries as Q
from tessellar.plans import cli, lifecycle, packages
from tessellar.sources import files, sinks
from tessellar.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    lit = F.lit
    r = one(
        spark,
        S.slug(lit("--AI & Chips: 2024!")), S.company_key(lit(""), lit("TCK")), S.strip_suffix(lit("Acme Holdings, Inc.")), S.quarter_label(lit("2024-05-01").cast("date")),
        S.parse_date(lit("03/04/2024")), S.parse_date(lit("5 Jan 2024")), S.parse_date(lit("nonsense")), S.q(lit(0.123456)), S.jaccard(F.array(lit("a")), F.array(lit("a"), lit("b"))),
    )
    assert r[0] == "ai-chips-2024" and r[1] == "TCK" and r[2] == "acme holdings" and r[3] == "Q2-2024"
    assert r[4] == dt.date(2024, 4, 3) and r[6] is None and r[7] == 0.1235 and r[8] == 0.5
    for text, value, unit in (("$1.2 billion", 1.2e9, "USD_billion"), ("$5M", 5e6, "USD_m"), ("cost $7", 7.0, "USD"), ("Rs. 1,234 crore", 1.234e10, "INR_crore"), ("none", None, None)):
        a = one(spark, S.amount(lit(text)))[0]
        assert (a is None) == (value is None) and (a is None or (math.isclose(a["value"], value) and a["unit"] == unit)), text


def test_windows(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([4, 6, 0, 3])] + [("b", 0, 5)], "k string, t int, v int")
    v = {(r["k"], r["t"]): r for r in W.velocity(rows, ["k"], "t", "v").collect()}
    assert v["a", 1]["velocity"] == 0.5 and v["a", 2]["velocity"] == -1.0 and v["a", 3]["velocity"] == 3.0 and v["a", 3]["acceleration"] == 4.0 and v["b", 0]["velocity"] == 0.0
    m = [r["moving_average"] for r in W.moving_average(rows.filter("k = 'a'"), ["k"], "t", "v").orderBy("t").collect()]
    assert m == [2.0, 5.0, 3.0, 1.5]
    s = {r["k"]: r["slope"] for r in W.half_window_slope(rows, ["k"], "t", "v").collect()}
    assert s == {"a": 1.5 - 5.0, "b": None}
    runs = spark.createDataFrame([("a", i) for i in (1, 2, 3, 5, 6)] + [("b", i) for i in range(20)], "k string, i int")
    got = {(r["k"], r["i"]): r["streak"] for r in W.streaks(runs, ["k"], "i").collect()}
    assert [got["a", i] for i in (1, 2, 3, 5, 6)] == [1, 2, 3, 1, 2] and got["b", 19] == 12
    p = {r["i"]: r["previous"] for r in W.previous_period(runs.filter("k = 'a'").withColumn("v", F.col("i") * 10), ["k"], "i", "v").collect()}
    assert p == {1: None, 2: 10, 3: 20, 5: None, 6: 50}


def test_suppression_is_a_fold(spark):
    rng = random.Random(1)
    hits = [(rng.choice("xy"), rng.choice([0.5, 0.7, 0.9]), rng.randint(0, 3000), i) for i in range(60)]
    df = spark.createDataFrame([(hits,)], "h array<struct<type:string,confidence:double,start:int,seq:int>>")
    got = [(h["type"], h["start"]) for h in df.select(W.suppress_near(F.col("h"))).first()[0]]
    kept, want = {}, []
    for t, _, s, _ in sorted(hits, key=lambda h: (-h[1], h[3])):
        if t not in kept or abs(s - kept[t]) >= 500:
            kept[t] = s
            want.append((t, s))
    assert got == want


def test_momentum_never_looks_ahead(spark):
    as_of = dt.date(2024, 6, 30)
    rows = [("e", as_of - dt.timedelta(days=d)) for d in (0, 10, 30, 31, 60, 90, 91)]
    later = [("e", as_of + dt.timedelta(days=d)) for d in (1, 5)]
    day = F.lit("2024-06-30").cast("date")
    a = W.momentum(spark.createDataFrame(rows, "k string, d date"), ["k"], "d", day).first()
    b = W.momentum(spark.createDataFrame(rows + later, "k string, d date"), ["k"], "d", day).first()
    assert a == b and (a["recent"], a["prior"]) == (3, 3) and a["momentum"] == 50.0 and a["direction"] == "stable"


def test_as_of_and_vintages(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([("s", d(1), 1.0), ("s", d(5), 2.0), ("s", d(9), 3.0), ("t", d(9), 9.0)], "k string, day date, v double")
    got = R.as_of(rows, ["k"], "day", F.lit("2024-01-06").cast("date")).collect()
    assert [(r["k"], r["v"]) for r in got] == [("s", 2.0)]
    vint = spark.createDataFrame([("s", d(1), 1, 1.0), ("s", d(1), None, 2.0), ("s", d(2), 1, 3.0), ("s", d(2), 2, 4.0)], "k string, day date, vintage int, v double")
    assert sorted(r["v"] for r in R.as_of_vintage(vint, ["k"], "day", "vintage").collect()) == [2.0, 4.0]
    prices = spark.createDataFrame([("x", d(1), 10.0), ("x", d(6), 12.0), ("x", d(12), 5.0)], "k string, date date, close double")
    left = spark.createDataFrame([("x", d(1)), ("x", d(2)), ("y", d(1))], "k string, day date")
    got = {(r["k"], r["day"]): r["close"] for r in R.forward_as_of(left, prices, "k", "day", "date", "close", 0).collect()}
    assert got == {("x", d(1)): 10.0, ("x", d(2)): 12.0, ("y", d(1)): None}


def test_contains_join_both_ways(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "AI Power grid rush"), (2, "chip shortage"), (3, None)], "i int, t string")
    words = spark.createDataFrame([("power grid",), ("chip",), ("rid",), ("I",), ("hi",), ("nowhere",), ("",), (None,)], "w string")
    want = {(1, "power grid"), (2, "chip"), (1, "rid"), (1, "I"), (2, "I"), (2, "hi")}
    assert {(r["i"], r["w"]) for r in R.contains_join(texts, "t", words, "w").collect()} == want
    monkeypatch.setattr(R, "BROADCAST_ROWS", 1)
    assert {(r["i"], r["w"]) for r in R.contains_join(texts, "t", words, "w").collect()} == want
    twice = texts.union(texts)
    assert R.contains_join(twice, "t", words, "w").count() == 2 * len(want)


def test_upsert_rules_and_idempotence(spark):
    schema = "document_id long, entity_id long, signal_type string, direction string, confidence double, value double, context string, country string, filed_at date"
    old = spark.createDataFrame([(1, None, "a", None, 0.5, 1.0, "c", None, dt.date(2024, 1, 1)), (2, 1, "a", "p", 0.9, None, None, "US", None)], schema)
    new = spark.createDataFrame([(1, None, "a", None, 0.4, None, "n", "IN", dt.date(2024, 2, 2)), (1, None, "a", None, 0.7, 3.0, None, None, None), (3, 1, "b", "p", 0.1, 1.0, "x", "US", None), (None, 1, "b", "p", 0.1, 1.0, "x", "US", None)], schema)
    out = {r["document_id"]: r for r in U.upsert_table("signals", old, new).collect()}
    assert set(out) == {1, 2, 3} and out[1]["confidence"] == 0.7 and out[1]["value"] == 3.0 and out[1]["context"] == "c" and out[1]["filed_at"] == dt.date(2024, 1, 1)
    twice = U.upsert_table("signals", U.upsert_table("signals", old, new), new)
    assert sorted(map(str, twice.collect())) == sorted(map(str, out.values()))
    base = spark.createDataFrame([("k", 1, 5)], "k string, n int, m int")
    got = U.upsert(base, spark.createDataFrame([("k", 2, 9), ("k", 3, 1), ("j", 4, 4)], "k string, n int, m int"), ["k"], {"n": "sum", "m": "least"}, F.col("m"))
    assert {(r["k"], r["n"], r["m"]) for r in got.collect()} == {("k", 6, 5), ("j", 4, 4)}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("b", "d"), ("d", "e"), ("x", "y")], "src string, dst string")
    got = sorted((r["node"], r["hops"]) for r in G.paths(e, F.col("src") == "a", 3).collect())
    assert got == [("a", 3), ("b", 1), ("c", 2), ("d", 1), ("d", 2), ("e", 2), ("e", 3)]
    assert ("a", 3) not in [(r["node"], r["hops"]) for r in G.paths(e, F.col("src") == "a", 3, simple=True).collect()]
    assert {r["node"]: r["hops"] for r in G.reach(e, "a").collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    assert {r["node"]: r["component"] for r in G.components(e).collect()} == {**dict.fromkeys("abcde", "a"), "x": "x", "y": "x"}
    line = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(70)], "src string, dst string")
    assert {r["component"] for r in G.components(line).collect()} == {"n000"}
    assert {r["node"]: r["degree"] for r in G.degree(e).collect()} == {"a": 3, "b": 3, "d": 3}
    m = spark.createDataFrame([(1, "Co", "GPU", "TECHNOLOGY", "we design it"), (1, "Co", "HBM", "TECHNOLOGY", "we saw it"), (2, "Co", "growth", "CONCEPT", None)], "doc_id int, company string, entity string, entity_type string, context string")
    edges = {(r["src"], r["rel"], r["dst"]): r["weight"] for r in lifecycle.run_graph(m).collect()}
    assert edges == {("Co", "DEVELOPS", "GPU"): 1.0, ("Co", "INVESTS_IN", "growth"): 1.0, ("GPU", "ENABLES", "HBM"): 0.3}


def test_normalize_and_keys(spark):
    raw = "“Quoted” – text\t here   and  there  \n12\nPage 3 of 10\nCONFIDENTIAL\n\n\n\nA last line that is long enough to stay in the text.\x07"
    got = one(spark, T.normalize(F.lit(raw), 10))[0]
    assert got == '"Quoted" - text here and there\n\nA last line that is long enough to stay in the text.'
    assert one(spark, T.normalize(F.lit("x" * 49)))[0] is None and one(spark, T.normalize(F.lit("x" * 50)))[0] == "x" * 50
    docs = spark.createDataFrame([(1, "http://a/x", "Some text"), (2, "HTTP://A/x/", "other"), (3, "http://b", "some  TEXT"), (4, "http://c", "other")], "n int, url string, text string")
    assert [r["status"] for r in T.dedupe(docs, "n").orderBy("n").collect()] == ["NEW", "URL_DUPLICATE", "CONTENT_DUPLICATE", "NEW"]


def test_chunks(spark):
    words = [f"w{i}" for i in range(1000)]
    got = one(spark, T.chunks(F.lit(" ".join(words))))[0]
    assert [len(c.split()) for c in got] == [400, 400, 300] and got[1].split()[0] == "w350"
    assert one(spark, T.chunks(F.lit("")))[0] == [] and one(spark, T.chunks(F.lit("a b")))[0] == ["a b"]


def test_signals_and_events(spark):
    far = "x" * 600
    text = f"We see strong demand outlook, strong. {far} record demand again, a chip shortage of wafer supply and solar capex will increase by $2.5 billion."
    rows = T.extract_signals(spark.createDataFrame([(1, text), (2, None), (3, "merger of equals")], "doc_id long, text string")).collect()
    kinds = [r["signal_type"] for r in rows if r["doc_id"] == 1]
    # only the hit kept last suppresses, so the weaker hit at the text's begin comes again
    assert kinds.count("demand_surge") == 3 and "supply_bottleneck" in kinds and "capex_increase" in kinds and not [r for r in rows if r["doc_id"] == 3]
    capex = next(r for r in rows if r["signal_type"] == "capex_increase")
    assert (capex["value"], capex["unit"], capex["entity"]) == (2.5e9, "USD_billion", "Solar") and sorted(r["seq"] for r in rows) == list(range(len(rows)))
    assert (len(T.SIGNAL_PATTERNS), len(T.EVENT_PATTERNS), len({k for k, _, _, _ in T.EVENT_PATTERNS})) == (49, 25, 18)
    many = spark.createDataFrame([(1, f"record demand {far} " * 150)], "doc_id long, text string")
    assert T.extract_signals(many, most=None).count() >= 150
    built = T.extract_events(spark.createDataFrame([(1, "We will build a new fab and invest $3 million in it")], "doc_id long, text string")).collect()
    assert "factory_expansion" in {r["event_type"] for r in built} and {r["direction"] for r in built} == {"positive"}
    assert all(text[r["start"] : r["end"]] in r["context"] for r in rows)
    ev = T.extract_events(spark.createDataFrame([(1, "acquired a firm for $3 million. acquired a plant. " + far + "acquired")], "doc_id long, text string"), [("deal", "positive", 0.9, "acquired")]).collect()
    assert [(r["start"], r["magnitude"]) for r in ev][0] == (0, 3e6) and len(ev) == 2


def test_keyword_entities_and_search(spark):
    docs = spark.createDataFrame([(1, "The power grid and AI; Éa"), (2, "aid power-grid"), (3, None)], "doc_id int, text string")
    lex = spark.createDataFrame([("AI", "TECH"), ("power grid", "SECTOR"), ("éa", "X")], "keyword string, entity_type string")
    assert {(r["doc_id"], r["keyword"]) for r in T.keyword_entities(docs, lex).collect()} == {(1, "AI"), (1, "power grid"), (1, "éa")}
    hits = T.search(docs, ["power"]).collect()
    assert [r["doc_id"] for r in hits] == [2, 1]
    assert [r["doc_id"] for r in T.search(docs, ["power", "AI"], every=True).collect()] == [1]
    own = spark.createDataFrame([(1, "China+1 and 5G, ai_x; an EV; semiconductor"), (2, ""), (3, None), (4, "China + 1 datacenter")], "doc_id int, text string")
    found = {(r["doc_id"], r["keyword"], r["entity_type"]) for r in T.keyword_entities(own).collect()}
    assert found == {(1, "China+1", "CONCEPT"), (1, "5G", "TECHNOLOGY"), (1, "EV", "TECHNOLOGY"), (1, "Semiconductor", "TECHNOLOGY"), (1, "Semiconductor", "SECTOR")}
    assert T.lexicon_rows(spark).groupBy("entity_type").count().sort("entity_type").collect() == [("CONCEPT", 40), ("SECTOR", 26), ("TECHNOLOGY", 40)]


def test_index_search_equals_search_and_snippets(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["grid", "Power,", "ai", "coal", "sun-power", "ore"]) for _ in range(rng.randrange(30))) for _ in range(60)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    index, total = T.postings(docs), T.totals(docs)
    for query in (["power"], ["power", "AI"], ["ai", "ai"], ["absent"], []):
        for every in (False, True):
            a = [(r["doc_id"], round(r["score"], 9)) for r in T.search(docs, query, every=every).collect()]
            b = [(r["doc_id"], round(r["score"], 9)) for r in T.search_postings(index, total, query, every=every).collect()]
            assert sorted(a) == sorted(b), (query, every)
    one = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)) + " Power, grid " + "z " * 60)], "doc_id int, text string")
    got = T.search(one, ["power"], words=12).first()["snippet"]
    assert got == "..." + " ".join(f"w{i}" for i in range(12, 20)) + " <b>Power,</b> grid z z..."
    plain = one.select(T.snippet(F.lit("a b"), ["x"]).alias("none"), T.snippet(F.lit(None).cast("string"), ["x"]).alias("null"), T.snippet(F.lit(""), ["x"]).alias("empty")).first()
    assert tuple(plain) == ("a b", None, "")
    assert [r["doc_id"] for r in T.search_phrase(one.withColumn("day", F.lit(1)), "POWER, GRID", "day").collect()] == [1]


def test_signals_in_sql(spark):
    T.register(spark)
    docs = spark.createDataFrame([(1, "record demand for solar of $3 billion"), (2, None), (3, "")], "doc_id long, text string")
    docs.createOrReplaceTempView("signal_docs")
    rows = spark.sql("select doc_id, s.* from (select doc_id, inline_outer(signal_extract(text)) as (signal_type, direction, confidence, start, end, context, value, unit, entity) from signal_docs) s where signal_type is not null").collect()
    want = [tuple(r[c] for c in ("doc_id", "signal_type", "start", "value", "entity")) for r in T.extract_signals(docs).collect()]
    assert sorted((r["doc_id"], r["signal_type"], r["start"], r["value"], r["entity"]) for r in rows) == sorted(want) and want


def test_exact_search_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)] + [(80, None), (81, [0.0] * 6)], "vec_id long, e array<double>")
    asked = df.filter("vec_id < 25").select(F.col("vec_id").alias("query"), F.col("e").alias("vector"))
    whole = sorted(tuple(r) for r in V.exact_topk(df, "vec_id", "e", asked, 5).collect())
    monkeypatch.setattr(V, "MAX_QUERIES", 7)
    assert sorted(tuple(r) for r in V.exact_topk(df, "vec_id", "e", asked, 5).collect()) == whole and len(whole) == 125
    assert V.exact_topk(df, "vec_id", "e", asked.limit(0), 5).count() == 0


def test_chain_aliases(spark):
    links = [("a", 0, "Artificial Intelligence", 0.5), ("a", 1, "coal", 0.5), ("b", 0, "power demand", 0.6), ("b", 1, " Mining Capex ", 0.4), ("c", 0, "ai", 1.0),
             ("d", 0, "solar panel glass", 0.7), ("d", 1, "tin", 0.3), ("data-e", 0, "coal", 0.5), ("data-e", 1, "coal", 0.5), ("f", 0, None, 0.5), ("f", 1, "x", 0.5)]
    df = spark.createDataFrame([(*r, 77.0 if r[0].startswith("data-") else None) for r in links], "chain_id string, pos int, cause string, probability double, score double")
    active = spark.createDataFrame([("AI",), ("new mining investment",), ("panel",), ("Electricity Demand growth",), ("tin ore",), (None,)], "name string")
    got = {r["chain_id"]: round(r["score"], 6) for r in I.score_chains(df, active).collect()}
    assert got == {"a": 50.0, "b": 100.0, "c": 0.0, "d": 70.0, "data-e": 77.0, "f": 0.0}
    none = {r["chain_id"]: r["score"] for r in I.score_chains(df.drop("score"), active.limit(0)).collect()}
    assert set(none.values()) == {0.0} and len(none) == 6


def test_word_shapes_and_names(spark):
    shapes = {"GPU": 0.05, "HBM3": 0.1, "Advanced Packaging": 0.15, "multi-chip": 0.2, "solar": 0.1, "cost": 0.75, "taxation": 0.6, "selling": 0.55, "copper": 0.45, "copper ore": 0.4, "": None}
    for name, want in shapes.items():
        if want is not None:
            assert one(spark, TH.word_shape_noise(F.lit(name)))[0] == want, name
    noise = {"AI": False, "ab": True, "GPU": False, "the of": True, "1st": True, "a b c d e f": True, "RevenueFromContract": True, "Data Center": False, "": True}
    for name, want in noise.items():
        assert one(spark, TH.is_noise_name(F.lit(name)))[0] is want, name
    assert one(spark, TH.canonical_name(F.lit(" Chips ")))[0] == "semiconductor"


def stage(spark, n, strength, momentum, conviction, kinds, tension):
    return one(spark, TH.stage(F.lit(n), F.lit(strength), F.lit(momentum), F.lit(conviction), F.array(*[F.lit(k) for k in kinds]), F.lit(tension)))[0]


def test_stages(spark):
    assert stage(spark, 8, 50.0, 50.0, "emerging", ["demand_slowdown", "supply_easing"], 0.0) == 5
    assert stage(spark, 12, 50.0, 50.0, "emerging", ["supply_easing"], 0.0) == 4
    assert stage(spark, 25, 100.0, 50.0, "confirmed", ["supply_bottleneck"], 0.0) == 3
    assert stage(spark, 10, 50.0, 50.0, "confirmed", ["capex_increase"], 0.0) == 2
    assert stage(spark, 4, 50.0, 50.0, "emerging", ["supply_bottleneck", "demand_surge"], 0.0) == 1
    assert stage(spark, 3, 50.0, 50.0, "emerging", ["demand_surge"], 0.0) == 0
    p = one(spark, TH.progression(F.lit(13.0), F.lit(10.0), F.array(F.lit("supply_bottleneck")), F.array(F.lit("x"))))[0]
    assert p["trend"] == "advancing" and p["score"] == 50 + 15 + 20 and p["growth_pct"] == 30.0


def test_formulas(spark):
    lit = F.lit
    r = one(
        spark,
        I.window_activation(lit(0), lit(0)), I.trend_class(lit(0.2), lit(0.2)), I.trend_class(lit(-0.2), lit(0.1)), I.trend_score(lit(4), lit(0.2), lit(0.2), lit("EMERGING")),
        I.import_risk(lit(0.85)), I.tender_sector(lit("Supply of 220kV Transformer")), I.tender_strength(lit("solar"), lit(500.0)), I.velocity_pct(lit(3), lit(2)), I.velocity_pct(lit(3), lit(0)),
        I.magnitude_weight(lit("game_changer")), K.hop(lit(26)), K.macro_cluster(lit("Chip wafer rush")), I.emerging(lit(3), lit(2)), I.tracker_confidence(lit(4), lit(2), lit(2)),
        I.economic_context(lit("AI is nice. AI demand and capacity and orders grow."), ("ai",), ("demand", "capacity", "order")),
    )
    assert r[0] == 20.0 and r[1] == "EMERGING" and r[2] == "DORMANT" and r[3] == 20.0 + 20.0 + 20.0 + 10.0
    assert r[4] == "critical" and r[5] == "power_transmission" and math.isclose(r[6], 0.85) and r[7] == 50.0 and r[8] == 200.0
    assert r[9] == 1.0 and r[10] == 2 and r[11] == "semiconductor" and r[12] is True and math.isclose(r[13], 0.75) and math.isclose(r[14], 0.85)


def test_contradictions_cross_year(spark):
    rows = [("Co", "chips", "2023Q4", "strong demand and record growth"), ("Co", "chips", "2024Q1", "weak demand, slowing and cutting"), ("Co", "chips", "2024Q2", "nothing said")]
    got = I.contradictions(spark.createDataFrame(rows, "company string, entity string, period string, text string")).collect()
    assert [(r["from_period"], r["period"], r["change"]) for r in got] == [("2023Q4", "2024Q1", "positive_to_negative"), ("2024Q1", "2024Q2", "negative_to_positive")]
    assert got[0]["delta"] == -2.0 and got[0]["pairs"] == 1 and got[0]["confidence"] == 1.0


def test_canonical_chain(spark):
    day = dt.date(2024, 1, 1)
    rows = [("power-grid", "power grid", "power grid build", 5.0, day, day, ["a", "b"]), ("power-grid-rush", "power grid rush", "power grid build", 9.0, day, day, ["a", "b"]),
            ("grid-rush", "grid rush", "power grid build rush", 1.0, day, day, ["a", "b"]), ("cloud", "cloud", "software", 3.0, day, day, ["z"])]
    df = spark.createDataFrame(rows, "slug string, name string, description string, strength double, first_day date, last_day date, companies array<string>")
    got = {r["slug"]: r for r in I.canonical_themes(df, 0.65).collect()}
    assert {got[s]["canonical_slug"] for s in ("power-grid", "power-grid-rush", "grid-rush")} == {"power-grid-rush"} and got["cloud"]["is_canonical"] and len(got["cloud"]["cluster_id"]) == 16


def test_canonical_themes_equal_all_pairs(spark):
    rng = random.Random(8)
    words = ["power", "grid", "build", "rush", "cloud", "software", "lithium", "ore", "the", "demand", "rare", "earth"]
    rows = []
    for i in range(90):
        name = " ".join(rng.sample(words, rng.randrange(0, 4)))
        about = rng.choice([None, "", " ".join(rng.sample(words, 2)), "power grid build"])
        rows.append((f"{name.replace(' ', '-')}-auto-{i % 7}x{i}", name, about, float(rng.randrange(9)), rng.choice([None, dt.date(2023, 1, 1), dt.date(2023, 7, 1), dt.date(2024, 7, 1)]), rng.choice([None, [], ["a"], ["a", "b"], ["b", "a", "z"]])))
    df = spark.createDataFrame(rows, "slug string, name string, description string, strength double, first_day date, companies array<string>")

    def jac(x, y):
        return len(x & y) / len(x | y) if x | y else 0.0

    def score(p, q):
        def text(r):
            return {w for w in re.split(r"\W+", f"{r[1]} {(r[2] or '')[:100]}".lower()) if len(w) >= 3} - set(I.THEME_STOPS)

        def parts(r):
            return {w for w in re.split(r"[-_\s]+", r[0]) if len(w) >= 3} - set(I.SLUG_STOPS)

        def supply(r):
            return {t for t in I.SUPPLY_TERMS if t in f"{r[1]} {r[2] or ''}".lower()}

        gap = abs((p[4] - q[4]).days) if p[4] and q[4] else None
        near = 0.5 if gap is None else 1.0 if gap <= 90 else 0.0 if gap >= 365 else 1 - (gap - 90) / 275
        chain = 0.5 if not supply(p) and not supply(q) else jac(supply(p), supply(q))
        return 0.35 * jac(text(p), text(q)) + 0.25 * jac(set(p[5] or []), set(q[5] or [])) + 0.2 * jac(parts(p), parts(q)) + 0.1 * near + 0.1 * chain

    for threshold in (0.45, 0.65):
        group = {r[0]: r[0] for r in rows}
        for p in rows:
            for q in rows:
                s = score(p, q)
                if p[0] < q[0] and s >= threshold and group[p[0]] != group[q[0]]:
                    old, new = group[q[0]], group[p[0]]
                    group = {k: new if v == old else v for k, v in group.items()}
        got = {r["slug"]: r["cluster_id"] for r in I.canonical_themes(df, threshold).collect()}
        assert len(got) == len(rows)
        assert {frozenset(k for k in got if got[k] == c) for c in got.values()} == {frozenset(k for k in group if group[k] == c) for c in group.values()}
        assert I.theme_pairs(I.theme_tokens(df), 0.65).count() < 90 * 89 / 2


def test_themes_replay_has_no_leakage(spark):
    rng = random.Random(2)
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=9 * i) for i in range(80)]
    filings = [(i, f"c{rng.randrange(12)}", f"t{i % 12}", d, "US") for i, d in enumerate(days)]
    signals = [(i, rng.choice(["demand_surge", "supply_bottleneck", "capex_increase"])) for i in range(80) for _ in range(2)]
    mentions = [(i, rng.randrange(30)) for i in range(80)]
    entities = [(i, f"solar grid {chr(97 + i)}", "TECHNOLOGY") for i in range(30)]

    def tables(n):
        keep = {f[0] for f in filings[:n]}
        return lifecycle.Tables(
            spark.createDataFrame(filings[:n], "doc_id int, company string, ticker string, filed_at date, country string"),
            spark.createDataFrame([s for s in signals if s[0] in keep], "doc_id int, signal_type string"),
            spark.createDataFrame([m for m in mentions if m[0] in keep], "doc_id int, entity_id int"),
            spark.createDataFrame(entities, "entity_id int, canonical_name string, entity_type string"),
        )

    cfg, as_of = Config(max_ubiquity=0.9, min_eligibility=0.0, min_composite=0.0, min_companies=2, min_early_companies=2, max_adaptive_companies=2), days[59]
    full = sorted(map(str, lifecycle.run_themes(tables(80), as_of, cfg, universe=8).collect()))
    cut = sorted(map(str, lifecycle.run_themes(tables(60), as_of, cfg, universe=8).collect()))
    assert full == cut and full
    months = lifecycle.month_ends(dt.date(2024, 1, 15), dt.date(2024, 4, 30))
    assert months == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 31), dt.date(2024, 4, 30)]
    t = tables(80)
    b = lifecycle.run_beneficiaries(lifecycle.run_themes(t, as_of, cfg, universe=8), t)
    assert b.count() > 0 and set(b.columns) >= {"theme", "company", "rank"}
    assert lifecycle.replay(t, dt.date(2024, 1, 1), dt.date(2024, 2, 29), cfg).select("as_of").distinct().count() <= 2


def test_forward_performance(spark):
    day = dt.date(2024, 1, 1)
    prices = [(t, day + dt.timedelta(days=i), p) for t, i, p in (("X", 0, 10.0), ("X", 32, 12.0), ("BENCH", 0, 100.0), ("BENCH", 30, 110.0))]
    got = lifecycle.forward_performance(spark.createDataFrame([("X", day)], "ticker string, day date"), spark.createDataFrame(prices, "ticker string, date date, close double"), (30,)).first()
    assert math.isclose(got["return_30d"], 0.2) and math.isclose(got["alpha_30d"], 0.1)


def test_sources_sinks_and_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"url": f"http://x/{i}", "title": f"t{i}", "text": "body", "filed_at": f"2024-01-0{i}", "word_count": i} for i in range(1, 6)]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    files.register(spark)
    df = spark.read.format("tessellar_documents").option("path", str(tmp_path / "in")).option("since", "2024-01-03").load()
    assert sorted(r["title"] for r in df.collect()) == ["t3", "t4", "t5"]
    (tmp_path / "p.html").write_text("<nav>x</nav><p>Hello &amp; bye</p>")
    assert files.pages(spark, str(tmp_path), "*.html").first()["text"] == "Hello & bye"
    assert files.pdf_pages(spark, str(tmp_path)).count() == 0
    months = files.month_chunks(spark, "2024-01-15", "2024-03-02").collect()
    assert [(str(r["start"]), str(r["end"])) for r in months] == [("2024-01-15", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-02")]
    p = files.policy_impact(spark.createDataFrame([("New tariff on chips act goods",), ("x",)], "title string")).collect()
    assert p[0]["sectors"] == ["semiconductor", "trade"] and p[0]["direction"] == "positive" and p[1]["direction"] == "neutral"
    stream = lambda: ingest.new_documents(spark, str(tmp_path / "in"), "url string, title string, word_count long")
    table, ck = str(tmp_path / "table"), str(tmp_path / "ck")
    assert ingest.ingest(stream(), "documents", table, ck) == 1 and sinks.current(spark, table).count() == 5
    (tmp_path / "in" / "b.jsonl").write_text(json.dumps({"url": "http://x/1", "title": None, "word_count": 1}) + "\n" + json.dumps({"url": "http://x/9", "title": "n", "word_count": 2}))
    ingest.ingest(stream(), "documents", table, ck)
    got = {r["url"]: r for r in sinks.current(spark, table).collect()}
    assert len(got) == 6 and got["http://x/1"]["title"] == "t1"
    assert ingest.ingest(stream(), "documents", table, ck) == 0
    sinks.export(df.withColumn("a", F.array("title")), str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    edge = spark.createDataFrame([("O'Neil", "USES", "b", 1.0)], "src string, rel string, dst string, weight double")
    assert "O\\'Neil" in sinks.cypher(edge).first()[0]
    sinks.append_log(spark, str(tmp_path / "log"), "r1", "nlp", "ok", {"new": 3})
    assert spark.read.parquet(str(tmp_path / "log")).first()["counts"] == {"new": 3}


def test_packages():
    assert packages.numbered_batches(["a", "b", "c"], 2) == ["1. a\n2. b", "1. c"]
    assert packages.parse_numbered("1. yes\n3) no\nchat", 3) == ["yes", None, "no"]
    b = packages.Budget(1)
    assert b.ask("p", "d", lambda _: "r") == "r" and b.ask("p", "d", lambda _: "x") == "r" and b.ask("q", "d", lambda _: "x") is None


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 1.0, 0.0]) for i in range(40)], "k int, e array<double>")
    assert {r["k"] % 2: round(r["c"][0], 3) for r in V.centroid(df.withColumn("p", F.col("k") % 2), ["p"], "e").select(F.col("p").alias("k"), F.col("centroid").alias("c")).collect()} == {0: 0.0, 1: 1.0}
    c = {r["key"]: r["cluster"] for r in V.kmeans(df, "k", "e", 2).collect()}
    assert c[0] == c[2] != c[1]
    n = V.lsh_neighbours(df, "k", "e", k=5).collect()
    assert n and all(r["neighbour_id"] % 2 == 0 for r in n if r["query_id"] == 0)
    e = V.embed(spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id int, text string"), "doc_id", "text").collect()
    assert len(e) == 1 and math.isclose(sum(x * x for x in e[0]["embedding"]), 1.0)


def test_cli_lists_and_rejects(capsys):
    assert cli.main(["list"]) == 0 and "entity_signal_clusters" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main([])


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_known_roles_come_first(spark):
    known = spark.createDataFrame([("acme", "AI", 1, ["supplier"]), ("acm", "AI", 2, ["beneficiary"]), ("acme", "EV", 3, ["beneficiary", "supplier"])], "fragment string, theme string, pos int, roles array<string>")
    rows = spark.createDataFrame([(1, "ACME Corp", "AI", "sole source"), (2, "Acme", "EV", None), (3, "Other", "AI", "we are sold out"), (4, None, "AI", "x")], "i int, company string, theme string, text string")
    got = {r["i"]: r for r in I.known_roles(rows, known).collect()}
    assert [x["role"] for x in got[1]["roles"]] == ["supplier"] and got[1]["roles"][0]["confidence"] == 0.95 and got[1]["from_known_list"]
    assert [x["role"] for x in got[2]["roles"]] == ["beneficiary", "supplier"] and [x["role"] for x in got[3]["roles"]] == ["bottleneck_player"] and not got[4]["from_known_list"]


def test_upsert_of_empty_strings_and_new_tables(spark):
    old = spark.createDataFrame([("u", "Good", 5)], "url string, title string, word_count int")
    new = spark.createDataFrame([("u", "", 9)], "url string, title string, word_count int")
    assert tuple(U.upsert_table("documents", old, new).first()) == ("u", "Good", 9)
    sig = "document_id long, entity_id long, signal_type string, direction string, confidence double, note string"
    out = U.upsert_table("signals", spark.createDataFrame([(1, 2, "a", None, 0.5, "first")], sig), spark.createDataFrame([(1, 2, "a", "", 0.9, "later")], sig)).collect()
    assert [tuple(r) for r in out] == [(1, 2, "a", "", 0.9, "first")]
    ev = "event_type string, series_id string, event_date date, severity double, description string"
    day = dt.date(2024, 1, 1)
    out = U.upsert_table("macro_events", spark.createDataFrame([("e", "s", day, 0.9, "x")], ev), spark.createDataFrame([("e", "s", day, 0.4, "y")], ev)).first()
    assert (out["severity"], out["description"]) == (0.9, "y")
    for name in ("entity_timeseries", "contradictions", "theme_propagation", "canonical_reviews", "commodity_series", "policy_events", "macro_theme_links"):
        keys, rules = U.TABLE_RULES[name]
        schema = ", ".join(f"{k} string" for k in keys) + ", strength double"
        one = lambda v: spark.createDataFrame([(*keys, v)], schema)
        assert U.upsert_table(name, one(1.0), one(0.5)).first()["strength"] == (1.0 if rules.get("strength") == "greatest" else 0.5)


def test_detect_from_raw_rows(spark):
    """Counts, gates, strength and conviction of the raw-row detector against a plain loop."""
    cfg = Config()
    rng = random.Random(3)
    rows = []
    for i in range(600):
        name = f"Solar Grid {i % 6} X"
        kind = rng.choice(["demand_surge", "supply_bottleneck", "capex_increase"] if i % 6 < 4 else ["inventory_buildup", "demand_surge"])
        rows.append((i, name, "SECTOR" if i % 6 == 1 else "TECHNOLOGY", f"c{rng.randrange(30)}", f"s{i % 4}", kind, i // 2))
    rows += [(0, *rows[0][1:]), (700, "  ", "X", "c1", "s1", "demand_surge", 1), (701, None, "X", None, None, None, None)]
    schema = "signal_id long, canonical_name string, entity_type string, company string, sector string, signal_type string, doc_id long"
    got = {r["name"]: r for r in TH.detect_raw(spark.createDataFrame(rows, schema), cfg).collect()}
    assert got
    for name, r in got.items():
        own = {(x[0], x[5]) for x in rows if x[1] == name}
        count = lambda *kinds: sum(k in kinds for _, k in own)
        d, s, c = count("demand_surge", "capex_increase"), count("supply_bottleneck"), count("capex_increase")
        assert (r["demand_count"], r["supply_count"], r["capex_count"], r["total_signals"]) == (d, s, c, len(own))
        n, docs = len({x[3] for x in rows if x[1] == name}), len({x[6] for x in rows if x[1] == name})
        tension = min(2.0 * d * s / (d + s) * 12, 60) if d >= cfg.min_tension_demand and s >= cfg.min_tension_supply else min(d * 4.0, 30) if c >= 2 and d >= cfg.min_early_demand else 0.0
        assert abs(r["tension"] - tension) < 1e-9 and (r["n_companies"], r["n_docs"]) == (n, docs)
        assert abs(r["strength"] - min(tension + min(c * 8, 30) + min(n * 2, 20) + (10 if docs >= 6 else 5), 100)) < 1e-9
    assert TH.detect_raw(spark.createDataFrame([], schema)).count() == 0


def _shuffled(spark):
    """Bytes of shuffle files written so far."""
    return sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(spark._jsc.sc().statusStore().executorList(False)))


def test_lsh_with_coarse_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype("float32")
    x[100:400] = x[100]  # many copies, whose ties go to the smaller key
    x[7] = 0
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "k long, e array<float>").repartition(4)
    search = lambda: sorted((r["query_id"], r["rank"], r["neighbour_id"], r["score"] is None, r["score"] or 0.0) for r in V.lsh_neighbours(df, "k", "e", k=5, width=20.0).collect())
    before = _shuffled(spark)
    got = search()
    assert _shuffled(spark) - before < 3_000_000  # the table's own size a few times, not a row for each pair
    want = []
    y = x.astype("float64")
    for q in range(0, 1500, 20):
        size = np.sqrt((y[q] ** 2).sum()) * np.sqrt((y**2).sum(1))
        s = (y @ y[q]) / np.where(size == 0, 1, size)
        order = sorted((size[i] == 0, -round(s[i], 9), i) for i in range(1500) if i != q)[:5]
        want += [(q, rank, i) for rank, (_, _, i) in enumerate(order, 1)]
    assert [g[:3] for g in got] == want
    for name, value in (("BLOCK_ROWS", 200), ("BLOCK_QUERIES", 20), ("BATCH_QUERIES", 7)):
        monkeypatch.setattr(V, name, value)
    assert search() == got
    monkeypatch.setattr(V, "PAIRS_A_ROW", 10**9)
    assert search() == got


def test_lsh_leaves_out_nulls(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (None, [1.0, 2.0])], "k long, e array<double>")
    assert [(r["query_id"], r["neighbour_id"]) for r in V.lsh_neighbours(df, "k", "e", width=9.0, tables=20).collect()] == [(0, 1)]


def test_title_strips_blanks_and_no_digits(spark):
    texts = ["0997 lines open with a digit 0", "x\n1 second line 1", "  six ch  ", "\u3000\u00a0wide blanks\u2003", "\ttab line\t\r\nmore text", "123456", "     5     \n\u2003ab\u2003\n  sixsix", "0" * 300, "e\u0301\U0001f469\u200dabc", "a\nb", "", None]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [*enumerate(texts)])
    want = con.execute(Q.ORACLES["title_extract"] + " order by doc_id").fetchall()
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = [(r["doc_id"], r["t"]) for r in rows.select("doc_id", T.title(F.col("text")).alias("t")).orderBy("doc_id").collect()]
    assert got == want
    assert got[0][1] == texts[0] and got[1][1] == "1 second line 1" and got[3][1] == "wide blanks" and got[11][1] is None
