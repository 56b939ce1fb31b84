"""Clusters, theme detection, noise, stages and ranking."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessellar.bindings import bind, sql, window
from tessellar.config import Config
from tessellar.functions.scalars import first_tier, q
from tessellar.operators import themes as T
from tessellar.queries import AS_OF, as_of_day, query

CFG = Config(max_ubiquity=0.05)

# Facts of the fan-out join, one row a signal, filing and entity, and the clusters over them.
_RAW = f"""select e.canonical_name, e.entity_type, f.company, f.doc_id, f.filed_at, s.signal_type
    from {{signals}} s join {{filings}} f on f.doc_id = s.doc_id join {{mentions}} m on m.doc_id = s.doc_id join {{entities}} e on e.entity_id = m.entity_id
    where f.filed_at >= date '{AS_OF}' - 730 and f.filed_at <= date '{AS_OF}'"""
_CLUSTERS = f"""select canonical_name, entity_type, cast(count(distinct company) as bigint) as n_companies, cast(count(distinct doc_id) as bigint) as n_docs,
    cast(count(distinct date_trunc('quarter', filed_at)) as bigint) as quarter_count, cast(count(distinct doc_id) filter (where filed_at >= date '{AS_OF}' - 90) as bigint) as recent_docs,
    cast(count(*) as bigint) as total_signals, min(filed_at) as first_date, max(filed_at) as last_date, any_value(t.total) as total_companies,
    cast(count(*) filter (where signal_type = 'capex_increase') as bigint) as capex_count,
    cast(count(*) filter (where signal_type in ('demand_surge', 'capex_increase', 'hiring_surge', 'technology_adoption', 'market_entry')) as bigint) as demand_count,
    cast(count(*) filter (where signal_type in ('supply_bottleneck', 'inventory_drawdown')) as bigint) as supply_count,
    cast(count(*) filter (where signal_type = 'regulatory_tailwind') as bigint) as regulatory_count
    from ({_RAW}) r, (select count(distinct company) as total from ({_RAW}) r2) t group by 1, 2
    having count(*) filter (where signal_type = 'capex_increase') + count(*) >= 2 and cast(count(distinct company) as double) / nullif(any_value(t.total), 0) < 0.05"""
COLUMNS = ["canonical_name", "entity_type", "n_companies", "n_docs", "quarter_count", "recent_docs", "total_signals", "first_date", "last_date", "capex_count", "demand_count", "supply_count", "regulatory_count"]


def _clusters(spark, d):
    filings = window(bind(spark, d, "filings"), str(datetime.date.fromisoformat(AS_OF) - datetime.timedelta(days=730)), AS_OF)
    return T.clusters(bind(spark, d, "signals"), filings, bind(spark, d, "mentions"), bind(spark, d, "entities"), F.date_sub(as_of_day(), 730), as_of_day(), CFG)


@query(f"select {', '.join(COLUMNS)} from ({_CLUSTERS}) c")
def entity_signal_clusters(spark, d):
    return _clusters(spark, d).select(*COLUMNS)


_SHAPE = """case when regexp_full_match(x, '[A-Z]{2,6}') then 0.05 when length(x) <= 6 and regexp_matches(x, '[A-Z]') and regexp_matches(x, '[0-9]') then 0.1
    when n >= 2 and len(list_filter(string_split(x, ' '), lambda w: regexp_matches(w, '^[A-Z]') or w in ('a','an','and','for','in','of','on','or','the','to','with','by','from','at'))) = n then 0.15
    when x like '%-%' and n <= 3 then 0.2
    when regexp_matches(lower(x), 'chip|semi|solar|grid|power|data|cloud|fiber|nuclear|battery|lithium|hydrogen|drone|satellite|quantum|biotech|genomic|wafer|foundry|transformer|turbine|laser|radar|sensor|roboti|autonomous|neural') then 0.1
    when n = 1 and length(x) <= 4 then 0.75 when n = 1 and length(x) <= 10 and regexp_matches(lower(x), '(tion|ment|ness|ity|ance|ence)$') then 0.6
    when n = 1 and length(x) <= 9 and regexp_matches(lower(x), 'ing$') then 0.55 when n = 1 then 0.45 when x = lower(x) then 0.4 else 0.35 end"""


@query(f"select x as name, cast({_SHAPE} as double) as shape from (select x, len(string_split(x, ' ')) as n from (select p_name as x from {{part}} union select p_type from {{part}} union select s_name from {{supplier}} union select upper(split_part(p_name, ' ', 2)) from {{part}} union select split_part(p_name, ' ', 1) from {{part}}) y) z")
def noise_word_shape(spark, d):
    p, s = bind(spark, d, "part"), bind(spark, d, "supplier")
    parts = F.split("p_name", " ")
    names = p.select(F.col("p_name").alias("name")).union(p.select("p_type")).union(s.select("s_name")).union(p.select(F.upper(parts[1]))).union(p.select(parts[0])).distinct()
    return names.select("name", T.word_shape_noise(F.col("name")).alias("shape"))


_NOISE = f"""select c.*, lower(trim(canonical_name)) as name, least(greatest(2, cast(floor(sqrt(total_companies) * 0.5) as bigint)), 6) as least_cos,
    0.30 / (1.0 + exp(-8.0 * (cast(n_companies as double) / total_companies - least(0.7, 0.4 + 3.0 / total_companies)))) + 0.15 * (1.0 - least(cast(total_signals as double) / n_companies / 5.0, 1.0)) * 0.5
    + 0.25 * case when canonical_name like '%-%' then 0.2 else 0.4 end
    + 0.15 * case when demand_count > 0 and supply_count > 0 then 0.05 else null end as noise from ({_CLUSTERS}) c"""


@query(f"select canonical_name, floor(noise * 1e4 + 0.5) / 1e4 as noise from ({_NOISE}) x where demand_count > 0 and supply_count > 0 and total_companies > 0")
def noise_score(spark, d):
    rows = _clusters(spark, d).filter("demand_count > 0 and supply_count > 0").withColumn("name", F.lower(F.trim("canonical_name")))
    score = T.noise_score(F.col("n_companies"), F.col("total_companies"), F.col("total_signals"), T.word_shape_noise(F.col("name")), T.coherence_noise(F.col("total_signals"), F.lit(2), F.lit(1), F.col("demand_count"), F.col("supply_count")))
    return rows.select("canonical_name", q(score).alias("noise"))


_DETECT = f"""select * from (select *, least(raw * (0.10 + 0.90 * recent_docs / greatest(n_docs, 1)), 100.0) as strength, row_number() over (partition by slug order by n_companies desc, total_signals desc, canonical_name, entity_type) as r from (
    select *, least(2.0 * demand_count * supply_count / (demand_count + supply_count) * 12.0, 60.0) as tension,
      least(2.0 * demand_count * supply_count / (demand_count + supply_count) * 12.0, 60.0) + least(capex_count * 8.0, 30.0) + least(n_companies * 2.0, 20.0)
      + case when quarter_count >= 4 then 20.0 when quarter_count >= 3 then 14.0 when quarter_count >= 2 then 8.0 else 0.0 end + greatest(0.0, least((demand_count - capex_count) * 3.0, 15.0)) as raw,
      substr(regexp_replace(regexp_replace(name, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30) as slug
    from ({_NOISE}) n where demand_count >= 1 and supply_count >= 1 and noise <= case when total_companies > 50 then 0.50 when total_companies < 10 then 0.60 else 0.55 end
      and n_companies >= least_cos and n_docs >= greatest(2, floor(least_cos * 1.2))) t) u where r = 1"""


@query(f"""select slug as entity_slug, floor(tension * 1e4 + 0.5) / 1e4 as tension, floor(strength * 1e4 + 0.5) / 1e4 as strength,
           case when quarter_count < 2 then 'emerging' when quarter_count < 3 and tension >= 40 and n_companies >= 4 then 'developing' when tension >= 40 and n_companies >= 4 then 'confirmed' else 'developing' end as conviction,
           case when quarter_count >= 2 then first_date end as first_detected
           from ({_DETECT}) v order by v.tension + v.strength desc, 'auto-' || slug || '-' limit 25""")
def theme_detect_tension(spark, d):
    rows = T.detect(_clusters(spark, d).filter("demand_count >= 1 and supply_count >= 1"), CFG)
    return rows.select("entity_slug", q(F.col("tension")).alias("tension"), q(F.col("strength")).alias("strength"), "conviction", "first_detected")


_RAW_ROWS = "select m.doc_id, s.entity_id as source_id, s.signal_type, f.company, f.sector, e.canonical_name, e.entity_type from {signals} s join {filings} f on f.doc_id = s.doc_id join {mentions} m on m.doc_id = s.doc_id join {entities} e on e.entity_id = m.entity_id"


@query()
def theme_detect_raw(spark, d):
    rows = sql(spark, d, _RAW_ROWS).withColumn("signal_id", F.xxhash64("doc_id", "source_id", "signal_type"))
    return T.detect_raw(rows, CFG).select("theme_slug", "conviction", "n_companies", "n_docs", q(F.col("tension")).alias("tension"), q(F.col("strength")).alias("strength"))


@query(f"""select entity_slug, rank, floor(composite * 100 + 0.5) / 100 as composite from (select slug as entity_slug, composite, row_number() over (order by composite desc, slug) as rank from (
           select slug, (0.40 * least(tension + least(capex_count * 5.0, 20.0), 100.0) + 0.25 * least(capex_count * 10.0, 100.0) + 0.20 * 50.0 + 0.10 * least(n_companies * 2.0, 40.0) + 0.05 * 50.0)
             * case conviction when 'confirmed' then 1.25 when 'developing' then 1.00 else 0.75 end * case when quarter_count >= 4 then 1.40 when quarter_count = 3 then 1.25 when quarter_count = 2 then 1.12 else 1.0 end as composite,
             0.20 * least(demand_count / 50.0, 1.0) + 0.25 * least(supply_count / 40.0, 1.0) + 0.20 * least(capex_count / 15.0, 1.0) + 0.15 * least(n_companies / 10.0, 1.0)
             + 0.10 * case when quarter_count >= 3 then 1.0 when quarter_count = 2 then 0.7 else 0.3 end as eligibility
           from (select *, case when quarter_count < 2 then 'emerging' when quarter_count < 3 and tension >= 40 and n_companies >= 4 then 'developing' when tension >= 40 and n_companies >= 4 then 'confirmed' else 'developing' end as conviction
                 from (select * from ({_DETECT}) v order by v.tension + v.strength desc, 'auto-' || slug || '-' limit 25) w) x) y where eligibility >= 0.5 and composite >= 20) z""")
def rank_composite(spark, d):
    rows = T.detect(_clusters(spark, d).filter("demand_count >= 1 and supply_count >= 1"), CFG).withColumn("momentum", F.lit(50.0)).withColumn("confidence", F.lit(50.0))
    return T.rank(rows, 1000, CFG).select("entity_slug", "rank", q(F.col("composite"), 2).alias("composite"))


_TIER = "case when regexp_matches(lower(text), '{0}') then 1.5 when regexp_matches(lower(text), '{1}') then 1.35 when regexp_matches(lower(text), '{2}') then 1.25 when regexp_matches(lower(text), '{3}') then 1.15 else 0.0 end"
_TIERS = ((("tion",), 1.5), (("les ", "los "), 1.35), (("der ", "die "), 1.25), (("the ",), 1.15))


@query("select doc_id, cast(" + _TIER.format("tion", "les |los ", "der |die ", "the ") + " as double) as weight from {documents}")
def bottleneck_weights(spark, d):
    return bind(spark, d, "documents").select("doc_id", first_tier(F.col("text"), _TIERS).alias("weight"))


@query("""select source, cast(wc as bigint) as weight_c, severity, floor(least(wc / 100.0 * 5.0 + n_companies * 3.0 + (quarter_count - 1) * 8.0, 100.0) * 100 + 0.5) / 100 as strength, conviction from (
          select *, case when idx >= 1.2 and quarter_count >= 2 then 'Critical Shortage' when idx >= 0.7 then 'Severe Constraint' else 'Supply Bottleneck' end as severity,
            case when quarter_count >= 3 and n_companies >= 5 then 'confirmed' when quarter_count >= 2 or n_companies >= 4 then 'developing' else 'emerging' end as conviction
          from (select *, wc / 100.0 / n_docs * least(n_companies / 3.0, 2.0) * least(quarter_count / 2.0, 1.5) as idx
                from (select source, sum(w) as wc, count(*) as n_docs, count(distinct lang) as n_companies, count(distinct doc_id % 4) as quarter_count
                      from (select source, lang, doc_id, case when lower(text) like '%tion%' then 150 when lower(text) like '%der %' then 125 else 0 end as w from {documents} where length(text) > 20) a where w > 0 group by 1) b) c) e""")
def bottleneck_severity(spark, d):
    day = F.make_date(F.lit(2020), (F.col("doc_id") % 4 * 3 + 1).cast("int"), F.lit(1))
    rows = bind(spark, d, "documents").select(
        F.col("source").alias("canonical_name"), F.lit("SOURCE").alias("entity_type"), F.col("lang").alias("company"), "doc_id", F.col("text").alias("context"), day.alias("filed_at")
    )
    out = T.bottlenecks(rows, 0, 0, 1000, ((("tion",), 1.5), (("der ",), 1.25)))
    return out.select(F.col("canonical_name").alias("source"), "weight_c", "severity", q(F.col("strength"), 2).alias("strength"), "conviction")


_FACTS = "select m.doc_id, m.entity_id, f.company from {mentions} m join {filings} f on f.doc_id = m.doc_id"
_SUPPLY = """select m.entity_id, cast(count(*) filter (where s.signal_type in ('supply_bottleneck', 'inventory_drawdown')) as bigint) as supply_signals, cast(count(*) filter (where s.signal_type = 'demand_surge') as bigint) as demand_signals,
    cast(count(*) filter (where s.signal_type = 'capex_increase') as bigint) as capex_signals from {mentions} m join {signals} s on s.doc_id = m.doc_id group by 1"""
_PRIM = f"select entity_id, count(distinct doc_id) as n_docs from ({_FACTS}) x group by 1 order by n_docs desc, entity_id limit 15"
_DOWN = f"""select * from (select p.entity_id as primary_id, c.entity_id, c.docs, c.companies, s.supply_signals, s.demand_signals, s.capex_signals, c.docs / cast(p.n_docs as double) * 100.0 as cooccur_pct,
    row_number() over (partition by p.entity_id order by s.supply_signals desc, c.docs desc, c.entity_id) as rank
    from ({_PRIM}) p join (select a.entity_id as pid, b.entity_id, count(distinct b.doc_id) as docs, count(distinct b.company) as companies from ({_FACTS}) a join ({_FACTS}) b on a.doc_id = b.doc_id and a.entity_id <> b.entity_id
      where a.entity_id in (select entity_id from ({_PRIM}) pp) group by 1, 2) c on c.pid = p.entity_id join ({_SUPPLY}) s on s.entity_id = c.entity_id
    where c.docs >= greatest(2.0, p.n_docs * 0.03) and s.supply_signals >= 2) x where rank <= 8"""


@query(f"select primary_id, entity_id, cast(docs as bigint) as docs, cast(companies as bigint) as companies, supply_signals, floor(cooccur_pct * 1e4 + 0.5) / 1e4 as cooccur_pct, rank from ({_DOWN}) y")
def cooccurrence_downstream(spark, d):
    return _downstream(spark, d).select("primary_id", "entity_id", "docs", "companies", "supply_signals", q(F.col("cooccur_pct")).alias("cooccur_pct"), "rank")


def _downstream(spark, d):
    m = bind(spark, d, "mentions").join(bind(spark, d, "filings").select("doc_id", "company"), "doc_id")
    prim = m.groupBy("entity_id").agg(F.countDistinct("doc_id").alias("n_docs")).orderBy(F.desc("n_docs"), "entity_id").limit(15)
    kind = F.col("signal_type")
    per_doc = bind(spark, d, "signals").groupBy("doc_id").agg(
        F.count(F.when(kind.isin("supply_bottleneck", "inventory_drawdown"), 1)).alias("s"), F.count(F.when(kind == "demand_surge", 1)).alias("g"), F.count(F.when(kind == "capex_increase", 1)).alias("c")
    )
    supply = bind(spark, d, "mentions").join(per_doc, "doc_id").groupBy("entity_id").agg(F.sum("s").alias("supply_signals"), F.sum("g").alias("demand_signals"), F.sum("c").alias("capex_signals"))
    return T.downstream(prim, m, supply, share=0.03)


@query(f"""select primary_id, entity_id, floor(least(least(cast(supply_signals as double) / greatest(companies, 1), 5.0) * 8.0 + least(cooccur_pct * 0.4 * 1.0, 25.0) + least(2.0 * demand_signals * supply_signals / greatest(demand_signals + supply_signals, 1) * 5.0, 25.0)
           + least(capex_signals * 4.0, 15.0) + (0.9 * 0.5 + 1.0 * 0.5) * 15.0 + 10.0, 100.0) * 1e4 + 0.5) / 1e4 as strength from ({_DOWN}) y where supply_signals >= 3 and companies >= 3""")
def downstream_strength(spark, d):
    rows = T.downstream_strength(_downstream(spark, d).filter("supply_signals >= 3"), F.lit(0.9))
    return rows.select("primary_id", "entity_id", q(F.col("strength")).alias("strength"))


_KINDS = "select f.sector, f.country, count(distinct f.company) as companies, sum(s.cents) % 10000 / 100.0 as strength, sum(s.cents) % 9000 / 90.0 as momentum, count(distinct s.signal_type) as nk, bool_or(s.signal_type = 'supply_bottleneck' and s.confidence_pm >= 100) as tight, bool_or(s.signal_type = 'demand_surge') as surge, bool_or(s.signal_type = 'capex_increase') as capex, count(*) filter (where s.signal_type = 'supply_bottleneck') as ns, count(*) filter (where s.signal_type = 'demand_surge') as nd from {signals} s join {filings} f on f.doc_id = s.doc_id where f.segment = 'FURNITURE' and f.filed_at between date '1998-01-01' and date '1998-01-31' group by 1, 2"


@query(f"""select sector, case when companies >= 25 and companies >= 8 and case when strength > 0 then momentum / strength else 1.0 end < 0.75 then 3 when companies >= 40 and not tight then 3 when companies >= 10 and capex and (surge or capex) and companies >= 8 then 2
           when companies >= 10 and t >= 40 then 2 when companies >= 4 and tight and (surge or capex) then 1 when companies >= 4 and t >= 20 then 1 when companies >= 6 and capex then 1 else 0 end as stage
           from (select *, least(2.0 * nd * ns / greatest(nd + ns, 1) * 12.0, 60.0) as t from ({_KINDS}) k) x""")
def stage_classify(spark, d):
    return _staged(spark, d).select("sector", "stage")


def _staged(spark, d):
    f = window(bind(spark, d, "filings"), "1998-01-01", "1998-01-31").filter("segment = 'FURNITURE'").select("doc_id", "sector", "country", "company")
    kind = F.col("signal_type")
    rows = bind(spark, d, "signals").join(f, "doc_id").groupBy("sector", "country").agg(
        F.countDistinct("company").alias("companies"), (F.sum("cents") % 10000 / 100.0).alias("strength"), (F.sum("cents") % 9000 / 90.0).alias("momentum"),
        F.collect_set(F.when((kind != "supply_bottleneck") & (kind != "inventory_drawdown") | (kind == "supply_bottleneck") & (F.col("confidence_pm") >= 100), kind)).alias("kinds"),
        F.count(F.when(kind == "supply_bottleneck", 1)).alias("ns"), F.count(F.when(kind == "demand_surge", 1)).alias("nd"),
    )
    tension = F.least(2.0 * F.col("nd") * F.col("ns") / F.greatest(F.col("nd") + F.col("ns"), F.lit(1)) * 12.0, F.lit(60.0))
    rows = rows.withColumn("tension", tension).withColumn("conviction", F.when(F.col("companies") >= 8, "confirmed").otherwise("developing"))
    return rows.withColumn("stage", T.stage(F.col("companies"), F.col("strength"), F.col("momentum"), F.col("conviction"), F.col("kinds"), F.col("tension")))


_PROG = """select n.theme, n.company_count as now, b.company_count as before from (select theme, company_count from {snapshots} where snapshot_date = date '1998-06-01') n left join (select theme, company_count from {snapshots} where snapshot_date = date '1998-03-01') b on b.theme = n.theme"""


@query(f"""select theme, case when before is null then 'new' when s >= 70 or g >= 30 then 'advancing' when s <= 30 or g <= -20 then 'weakening' else 'stable' end as trend, floor(case when before is null then 50.0 else s end * 100 + 0.5) / 100 as score, floor(coalesce(g, 0.0) * 100 + 0.5) / 100 as growth_pct
           from (select *, greatest(0.0, least(100.0, 50.0 + case when g >= 30 then least(g * 0.5, 30.0) when g >= 15 then 10.0 when g <= -20 then -20.0 else 0.0 end)) as s from (select *, cast(now - before as double) / before * 100.0 as g from ({_PROG}) p) x) y""")
def stage_progression(spark, d):
    s = bind(spark, d, "snapshots").select("theme", "company_count", "snapshot_date")
    now = s.filter("snapshot_date = date '1998-06-01'").select("theme", F.col("company_count").alias("now"))
    before = s.filter("snapshot_date = date '1998-03-01'").select("theme", F.col("company_count").alias("before"))
    same = F.array(F.lit("demand_surge"))
    rows = now.join(before, "theme", "left").withColumn("p", T.progression(F.col("now").cast("double"), F.col("before").cast("double"), same, same))
    return rows.select("theme", "p.trend", q(F.col("p.score"), 2).alias("score"), q(F.col("p.growth_pct"), 2).alias("growth_pct"))


@query(f"""select sector, cast(least(30.0 * cast(ns % 2 = 0 as int) + case when ns >= 3 and companies between 1 and 8 then 20.0 when ns >= 2 and companies <= 12 then 10.0 else 0.0 end + case when t >= 40 then 20.0 when t >= 20 then 10.0 else 0.0 end + 10.0, 100.0) as double) as score
           from (select *, least(2.0 * nd * ns / greatest(nd + ns, 1) * 12.0, 60.0) as t from ({_KINDS}) k) x""")
def explosive_potential(spark, d):
    rows = _staged(spark, d)
    score = T.explosive(F.col("ns") % 2 == 0, F.col("companies"), F.col("ns"), F.col("tension"), F.lit("stable"), F.lit(2))
    return rows.select("sector", score.alias("score"))


@query("""select theme_slug, max(strength) as strength, max(docs) as docs from (select theme as theme_slug, strength_c as strength, doc_count as docs from {snapshots} where snapshot_date = date '1998-06-01'
          union all select theme, strength_c, doc_count from {snapshots} where snapshot_date = date '1998-07-01') x group by 1""")
def merge_themes(spark, d):
    s = bind(spark, d, "snapshots").select(F.col("theme").alias("theme_slug"), F.col("strength_c").alias("strength"), F.col("doc_count").alias("docs"), "snapshot_date")
    return T.merge(s.filter("snapshot_date = date '1998-06-01'").drop("snapshot_date"), s.filter("snapshot_date = date '1998-07-01'").drop("snapshot_date")).select("theme_slug", "strength", "docs")


@query("select source, cast(least(3.0 * count(*), 100.0) as double) as strength from {documents} group by 1 having count(*) >= 3")
def topic_themes(spark, d):
    rows = bind(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).filter("n >= 3")
    return rows.select("source", F.least(F.col("n") * 3.0, F.lit(100.0)).alias("strength"))
