"""Rankings, beneficiaries, causal chains, contradictions, macro overlays and India layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.bindings import bind, sql, window
from tessellar.functions.scalars import amount, q
from tessellar.operators import intelligence as I
from tessellar.operators import ranking as K
from tessellar.queries import AS_OF, as_of_day, query
from tessellar.sources import static_tables as ST


_THEMES = "select theme, 'confirmed' as conviction, max(company_count) as company_count, case when theme like 'machinery%' then theme || ' shortage' when theme like 'furniture%' then theme || ' wafer' else theme end as name from {snapshots} group by 1"
_SCORES = f"""select t.theme, t.name, t.company_count, least(1.0, greatest(0.0, m / 10000.0)) as momentum, least(cast(n as double) / mx, 1.0) as persistence, greatest(0.0, 1.0 - (lt - d) / 365.0) as novelty,
    case when n >= 2 then greatest(0.0, least(1.0, (m / 100.0 - p / 100.0 + 30) / 60.0)) else 0.5 end as acceleration,
    greatest(0.02, least(1.0, (0.40 * case when t.name like '%wafer%' then 0.78 when t.name like '%shortage%' then 0.55 else 0.25 end + 0.30 * greatest(0.05, 1.0 - t.company_count / 60.0) + 0.20 * least(1.0, greatest(0.0, m / 10000.0)))
      * greatest(0.10, least(1.0, pow(30.0 / greatest(t.company_count, 1), 1.5))))) as theme_cq
    from ({_THEMES}) t join (select theme, arg_max(momentum_c, snapshot_date) as m, max(snapshot_date) as d, count(*) as n from {{snapshots}} group by 1) s on s.theme = t.theme
    left join (select theme, momentum_c as p, row_number() over (partition by theme order by snapshot_date desc) as r from {{snapshots}}) pp on pp.theme = t.theme and pp.r = 2,
    (select max(n) as mx, max(d) as lt from (select theme, count(*) as n, max(snapshot_date) as d from {{snapshots}} group by 1) z) g"""


def _scores(spark, d):
    snap = bind(spark, d, "snapshots").withColumn("momentum", F.col("momentum_c") / 100.0)
    return K.theme_scores(sql(spark, d, _THEMES), snap)


@query(f"""select theme, floor(momentum * 1e4 + 0.5) / 1e4 as momentum, floor(persistence * 1e4 + 0.5) / 1e4 as persistence, floor(novelty * 1e4 + 0.5) / 1e4 as novelty, floor(acceleration * 1e4 + 0.5) / 1e4 as acceleration, floor(theme_cq * 1e4 + 0.5) / 1e4 as theme_cq,
           floor((0.40 * theme_cq + 0.20 * momentum + 0.10 * persistence + 0.12 * novelty + 0.10 * acceleration + 0.03 * 1.0) * 1e4 + 0.5) / 1e4 as rank_score from ({_SCORES}) x""")
def theme_scores(spark, d):
    cols = ["momentum", "persistence", "novelty", "acceleration", "theme_cq", "rank_score"]
    return _scores(spark, d).select("theme", *[q(F.col(c)).alias(c) for c in cols])


_POOL = f"select * from (select *, row_number() over (order by floor(rank_score * 1e6) desc, theme) as r from (select *, 0.40 * theme_cq + 0.20 * momentum + 0.10 * persistence + 0.12 * novelty + 0.10 * acceleration + 0.03 * 1.0 as rank_score from ({_SCORES}) a) b) c where r <= 15 or theme_cq >= 0.45"


@query(f"select theme from ({_POOL}) x")
def theme_pool(spark, d):
    return K.theme_pool(_scores(spark, d)).select("theme")


_SIGS = """select f.ticker, count(*) as total, count(*) filter (where signal_type in ('supply_bottleneck', 'capex_increase', 'inventory_drawdown') and direction <> 'negative') as bn,
    count(*) filter (where signal_type in ('supply_bottleneck', 'capex_increase', 'inventory_drawdown') and direction <> 'negative') as sn, count(*) filter (where signal_type in ('demand_surge', 'technology_adoption', 'regulatory_tailwind') and direction <> 'negative') as bf
    from {signals} s join {filings} f on f.doc_id = s.doc_id group by 1"""
_EDGE = f"""select b.theme, b.ticker, role, conf, edge, theme_cq * decay * (0.40 + 0.60 * case when total > 0 then least(cast(bn as double) / total, 1.0) else 0.0 end) * case when total > 0 and signal_count > 0 then 0.70 + 0.60 * least(cast(signal_count as double) / total, 1.0) else 1.0 end as edge_cq, cluster from (
    select *, least((0.6 * least(relevance / 100.0, 1.0) + 0.4 * least(signal_count / greatest(ms * 0.4, 1.0), 1.0)) * conf * pow(0.7, hop) * (0.4 + 0.6 * rank_score), 1.0) as edge from (
      select *, greatest(0.12, least(1.0, 0.30 * least(signal_count / greatest(ms * 0.6, 1.0), 1.0) + 0.30 * ln(1 + 1.0) / ln(2 + 1.0) + 0.20 * least(relevance / 100.0, 1.0) * 0.45 + 0.20 * 1.0)) as conf from (
        select b.theme, b.ticker, b.signal_count, b.relevance_c / 100.0 as relevance, p.theme_cq, p.rank_score, coalesce(s.total, 0) as total, coalesce(s.bn, 0) as bn,
          case when b.rank_in_theme <= 10 then 0 when b.rank_in_theme <= 25 then 1 when b.rank_in_theme <= 50 then 2 when b.rank_in_theme <= 100 then 3 else 4 end as hop,
          case when b.rank_in_theme <= 10 then 1.0 when b.rank_in_theme <= 25 then 0.80 when b.rank_in_theme <= 50 then 0.60 when b.rank_in_theme <= 100 then 0.30 else 0.10 end as decay,
          case when coalesce(sn, 0) + coalesce(bf, 0) = 0 then 'beneficiary' when sn >= bf then 'supply' else 'beneficiary' end as role, case when p.name like '%wafer%' then 'semiconductor' else 'other' end as cluster, max(b.signal_count) over () as ms
        from {{beneficiaries}} b join ({_POOL}) p on p.theme = b.theme left join ({_SIGS}) s on s.ticker = b.ticker) a) a2) b where edge >= 0.03"""


def _edges(spark, d):
    f = bind(spark, d, "filings").select("doc_id", "ticker")
    counts = K.company_signals(bind(spark, d, "signals").join(f, "doc_id"))
    b = bind(spark, d, "beneficiaries").withColumn("relevance", F.col("relevance_c") / 100.0).withColumn("role", F.lit(None).cast("string"))
    b = b.withColumn("mention_count", F.lit(1)).withColumn("confidence", F.lit(1.0))
    return K.edges(K.theme_pool(_scores(spark, d)), b, counts)


@query(f"select theme, ticker, role, floor(conf * 1e4 + 0.5) / 1e4 as confidence, floor(edge * 1e4 + 0.5) / 1e4 as edge, floor(edge_cq * 1e4 + 0.5) / 1e4 as edge_cq from ({_EDGE}) x where edge_cq >= 0.02")
def company_edges(spark, d):
    return _edges(spark, d).select("theme", "ticker", F.col("company_role").alias("role"), q(F.col("role_confidence")).alias("confidence"), q(F.col("edge")).alias("edge"), q(F.col("edge_cq")).alias("edge_cq"))


@query(f"""select ticker, floor(best * 1e4 + 0.5) / 1e4 as best, floor((0.65 * best + 0.20 * top3 + 0.15 * least(greatest(0.05, least(1.0, 0.25 * conf * case role when 'supply' then 1.0 else 0.35 end + 0.20 * least(1.0 + least((ne - 1) * 0.08, 0.25), 1.0) + 0.20 * least(sc / greatest(ms * 0.5, 1.0), 1.0)
             + 0.20 / (1.0 + br * 0.10) + 0.15 * least(ne / 15.0 * 2.0, 1.0))), best * 10.0)) * (1.0 + least(0.25, ln(1.0 + 1) / ln(5.0))) * case role when 'supply' then 1.5 else 1.2 end * 1e3 + 0.5) / 1e3 as final_score
           from (select e.ticker, max(edge_cq) as best, avg(edge_cq) as top3, any_value(role) as role, max(conf) as conf, count(*) as ne, max(b.signal_count) as sc, min(b.rank_in_theme) as br, (select max(bb.signal_count) from {{beneficiaries}} bb join ({_POOL}) pp on pp.theme = bb.theme) as ms
                 from (select * from ({_EDGE}) y where edge_cq >= 0.02) e join {{beneficiaries}} b on b.theme = e.theme and b.ticker = e.ticker group by 1) z""")
def edge_cq_rank(spark, d):
    rows = K.rank_companies(_edges(spark, d), 15)
    return rows.select("ticker", q(F.col("best")).alias("best"), q(F.col("final_score"), 3).alias("final_score"))


_STATS = f"""select f.company, count(*) as total, count(*) filter (where signal_type = 'capex_increase') as capex, count(*) filter (where signal_type in ('supply_bottleneck', 'inventory_drawdown')) as constraints,
    count(*) filter (where signal_type in ('demand_surge', 'supply_bottleneck')) as orders from {{signals}} s join {{filings}} f on f.doc_id = s.doc_id where f.country = 'ASIA' and f.filed_at between date '{AS_OF}' - 365 and date '{AS_OF}' group by 1"""


@query(f"""select company, floor(final_score * 1e3 + 0.5) / 1e3 as final_score from (select company, (0.30 * (0.5 * 0.50 + 0.6 * 0.30 + greatest(0.25, least(1.0, 60.0 / greatest(cc, 1))) * 0.20) + rel * 0.25
           + (rel * 0.35 + cap * 0.25 + mk * 0.20 + ord * 0.10 + con * 0.10) * 0.20 + 0.8 * 0.15 + cap * 0.10) * case when rel = 0 then 0.10 else 1.0 end as final_score
           from (select b.company, cc, 0.5 * 0.60 + least(ln(1.0 + coalesce(total, 0)) / ln(51.0), 1.0) * 0.40 as rel, least(ln(1.0 + coalesce(capex, 0)) / ln(11.0), 1.0) as cap, case when coalesce(total, 0) > 0 then least(ln(1.0 + total) / ln(1.0 + greatest(na, 1) * 3.0), 1.0) else 0.0 end as mk,
                   least(ln(1.0 + coalesce(orders, 0)) / ln(9.0), 1.0) as ord, least(ln(1.0 + coalesce(constraints, 0)) / ln(6.0), 1.0) as con
                 from (select *, count(*) over () as na from {{beneficiaries}} where country = 'ASIA') b join (select theme, max(company_count) as cc from {{snapshots}} group by 1) t on t.theme = b.theme left join ({_STATS}) s on s.company = b.company) x) y
           order by floor(final_score * 1e6) desc, company limit 50""")
def india_ranking(spark, d):
    f = window(bind(spark, d, "filings"), "1997-12-31", AS_OF).filter("country = 'ASIA'").select("doc_id", "company")
    kind = F.col("signal_type")
    stats = bind(spark, d, "signals").join(f, "doc_id").groupBy("company").agg(
        F.count("*").alias("total"), F.count(F.when(kind == "capex_increase", 1)).alias("capex"), F.count(F.when(kind.isin("supply_bottleneck", "inventory_drawdown"), 1)).alias("constraints"),
        F.count(F.when(kind.isin("demand_surge", "supply_bottleneck"), 1)).alias("orders"),
    )
    b = bind(spark, d, "beneficiaries").filter("country = 'ASIA'").select("company", "theme", F.lit("supplier").alias("role"), F.lit(0.5).alias("conviction"))
    t = bind(spark, d, "snapshots").groupBy("theme").agg(F.max("company_count").alias("company_count")).withColumn("strength", F.lit(50.0)).withColumn("conviction_label", F.lit("developing"))
    return K.india_ranking(b, t, stats).select("company", q(F.col("final_score"), 3).alias("final_score"))


_FACT = "select e.canonical_name as entity, s.signal_type, f.company, f.filed_at as day from {signals} s join {filings} f on f.doc_id = s.doc_id join {entities} e on e.entity_id = s.entity_id where f.filed_at between date '1997-01-01' and date '1998-12-31'"


def _facts(spark, d):
    f = window(bind(spark, d, "filings"), "1997-01-01", "1998-12-31").select("doc_id", "company", F.col("filed_at").alias("day"))
    e = bind(spark, d, "entities").select("entity_id", F.col("canonical_name").alias("entity"))
    return bind(spark, d, "signals").select("doc_id", "entity_id", "signal_type").join(f, "doc_id").join(e, "entity_id")


# policy documents = the filings of one segment
_POLICY = "select e.canonical_name as entity, s.signal_type, s.doc_id, f.company, f.filed_at as day, f.segment = 'MACHINERY' as policy from {signals} s join {filings} f on f.doc_id = s.doc_id join {entities} e on e.entity_id = s.entity_id where f.filed_at between date '1996-01-01' and date '1998-12-31'"


def _policy(spark, d):
    f = window(bind(spark, d, "filings"), "1996-01-01", "1998-12-31").select("doc_id", "company", F.col("filed_at").alias("day"), (F.col("segment") == "MACHINERY").alias("policy"))
    e = bind(spark, d, "entities").select("entity_id", F.col("canonical_name").alias("entity"))
    return bind(spark, d, "signals").select("doc_id", "entity_id", "signal_type").join(f, "doc_id").join(e, "entity_id")


@query(f"""select entity, demand_docs, supply_docs, least(greatest(abs(supply_first - demand_first), 30), 365) as lag_days, floor(least(0.92, 0.65 + 0.06 * demand_docs) * least(0.90, 0.60 + 0.08 * supply_docs) * 100.0 * 1e4 + 0.5) / 1e4 as activation
           from (select entity, count(distinct doc_id) filter (where signal_type = 'demand_surge') as demand_docs, count(distinct doc_id) filter (where signal_type = 'supply_bottleneck') as supply_docs,
                   count(*) filter (where signal_type in ('demand_surge', 'supply_bottleneck')) as signals, min(day) filter (where signal_type = 'demand_surge') as demand_first, min(day) filter (where signal_type = 'supply_bottleneck') as supply_first
                 from ({_POLICY}) p where policy group by 1) x where demand_docs >= 2 and supply_docs >= 1 order by signals desc, entity limit 40""")
def policy_tension_chains(spark, d):
    rows = I.policy_tension(_policy(spark, d).filter("policy"))
    return rows.select("entity", "demand_docs", "supply_docs", F.col("lag_days").cast("bigint").alias("lag_days"), q(F.col("activation")).alias("activation"))


@query(f"""select x.entity, policy_docs, companies, floor(least(0.95, 0.70 + 0.05 * policy_docs) * least(0.92, 0.65 + 0.04 * companies) * 100.0 * 1e4 + 0.5) / 1e4 as activation
           from (select entity, count(distinct doc_id) as policy_docs from ({_POLICY}) p where policy and signal_type in ('regulatory_tailwind', 'demand_surge') group by 1 having count(distinct doc_id) >= 2) x
           join (select entity, count(distinct company) as companies from ({_POLICY}) p where not policy and signal_type = 'demand_surge' group by 1 having count(distinct company) >= 2) y on lower(x.entity) = lower(y.entity)
           order by policy_docs desc, companies desc, x.entity limit 30""")
def policy_confirmed_chains(spark, d):
    rows = _policy(spark, d)
    return I.policy_confirmed(rows.filter("policy"), rows.filter("not policy")).select("entity", "policy_docs", "companies", q(F.col("activation")).alias("activation"))


def _chain_sql(a, b, la, lb):
    return f"""select x.entity, cast(x.c as bigint) as first_companies, cast(y.c as bigint) as second_companies, least(greatest(abs(y.d - x.d), 30), 365) as lag_days, floor(least(0.95, 0.6 + 0.05 * x.c) * least(0.95, 0.6 + 0.05 * y.c) * 100.0 * 1e4 + 0.5) / 1e4 as activation
        from (select entity, count(distinct company) as c, min(day) as d from ({_FACT}) f where signal_type = '{a}' group by 1 having count(distinct company) >= {la}) x
        join (select entity, count(distinct company) as c, min(day) as d from ({_FACT}) f where signal_type = '{b}' group by 1 having count(distinct company) >= {lb}) y on lower(x.entity) = lower(y.entity)"""


def _chains(spark, d, a, b, la, lb):
    rows = I.tension_chains(_facts(spark, d), a, b, la, lb)
    return rows.select("entity", "first_companies", "second_companies", F.col("lag_days").cast("bigint").alias("lag_days"), q(F.col("activation")).alias("activation"))


@query(_chain_sql("demand_surge", "supply_bottleneck", 3, 2))
def causal_demand_supply(spark, d):
    return _chains(spark, d, "demand_surge", "supply_bottleneck", 3, 2)


@query(_chain_sql("demand_surge", "capex_increase", 4, 3))
def causal_demand_capex(spark, d):
    return _chains(spark, d, "demand_surge", "capex_increase", 4, 3)


@query(f"""select tech, downstream, cast(t.n as bigint) as adoptions, cast(w.n as bigint) as demands from (select entity as tech, count(*) as n from ({_FACT}) f where signal_type = 'technology_adoption' group by 1 having count(distinct company) >= 4 order by n desc, tech limit 25) t,
           (select entity as downstream, count(*) as n from ({_FACT}) f where signal_type in ('demand_surge', 'capex_increase') group by 1 having count(distinct company) >= 3) w where lower(tech) <> lower(downstream) order by adoptions desc, demands desc, tech, downstream limit 60""")
def cross_tech_downstream(spark, d):
    return I.adoption_pairs(_facts(spark, d)).select("tech", "downstream", "adoptions", "demands")


_LINKS = "select p_partkey % 40 as chain_id, p_partkey as pos, p_name as cause, p_type as effect, 0.5 + (p_size % 5) / 10.0 as probability from {part}"


@query(f"""select cast(chain_id as bigint) as chain_id, floor(case when count(*) < 2 then 0.0 else sum(case when exists (select 1 from (select distinct p_name as n from {{part}} where p_size <= 3) a where a.n = cause or (cause like '% %' and length(cause) >= 8 and length(a.n) >= 4 and (a.n like '%' || cause || '%' or cause like '%' || a.n || '%'))) then probability else 0 end) / sum(probability) * 100.0 end * 1e4 + 0.5) / 1e4 as score
           from ({_LINKS}) l group by 1""")
def causal_chain_scores(spark, d):
    links = sql(spark, d, _LINKS)
    active = bind(spark, d, "part").filter("p_size <= 3").select(F.col("p_name").alias("name")).distinct()
    return I.score_chains(links.withColumn("probability", F.col("probability").cast("double")), active).select(F.col("chain_id").cast("bigint").alias("chain_id"), q(F.col("score")).alias("score"))


@query("select cast(o_custkey as bigint) as chain_id, cast(r - 1 as bigint) as pos, o_orderkey as effect from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from {orders}) x where r > 1")
def second_order_links(spark, d):
    o = bind(spark, d, "orders").groupBy(F.col("o_custkey").cast("bigint").alias("chain_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("links"))
    links = o.select("chain_id", F.posexplode("links").alias("pos", "l")).select("chain_id", F.col("pos").cast("bigint").alias("pos"), F.col("l.o_orderkey").alias("effect"))
    return I.second_order(links)


@query(f"select entity, floor(greatest(20.0, 20.0 + 80.0 * (0.5 * least(ln(1.0 + count(distinct company)) / ln(601.0), 1.0) + 0.5 * least(ln(1.0 + count(*)) / ln(5001.0), 1.0))) * 1e4 + 0.5) / 1e4 as activation from ({_FACT}) f group by 1")
def chain_window_activation(spark, d):
    rows = _facts(spark, d).groupBy("entity").agg(F.countDistinct("company").alias("c"), F.count("*").alias("n"))
    return rows.select("entity", q(I.window_activation(F.col("c"), F.col("n"))).alias("activation"))


_POS, _NEG = ("the", "tion"), ("ou", "eau", "ein")


def _mood_sql():
    p = " + ".join(f"cast(lower(text) like '%{w}%' as int)" for w in _POS)
    n = " + ".join(f"cast(lower(text) like '%{w}%' as int)" for w in _NEG)
    return f"select conv_id, role, turn, text, case when ({p}) + ({n}) > 0 then cast(({p}) - ({n}) as double) / (({p}) + ({n})) else 0.0 end as mood from {{conversations}}"


@query(f"""select conv_id, role, turn, floor((mood - pm) * 1e4 + 0.5) / 1e4 as delta, case when mood < pm then 'positive_to_negative' else 'negative_to_positive' end as change, floor(least(1.0, abs(mood - pm) * 0.8 + 0.25 * cast((pt like '%the%' and lower(text) like '%ein%') or (pt like '%ein%' and lower(text) like '%the%') as int)) * 1e4 + 0.5) / 1e4 as confidence
           from (select *, lag(mood) over (partition by conv_id, role order by turn) as pm, lower(lag(text) over (partition by conv_id, role order by turn)) as pt from ({_mood_sql()}) m) x where pm is not null and abs(mood - pm) >= 0.35""")
def contradiction_pairs(spark, d):
    rows = bind(spark, d, "conversations").select(F.col("conv_id").alias("company"), F.col("role").alias("entity"), F.col("turn").alias("period"), "text")
    out = I.contradictions(rows, positive=_POS, negative=_NEG, reversals=(("the", "ein"),))
    return out.select(F.col("company").alias("conv_id"), F.col("entity").alias("role"), F.col("period").alias("turn"), q(F.col("delta")).alias("delta"), "change", q(F.col("confidence")).alias("confidence"))


_BM = "select f.company, m.doc_id, m.entity_id, s.n from {mentions} m join {entities} e on e.entity_id = m.entity_id and e.brand = 'Brand#7' join {filings} f on f.doc_id = m.doc_id join (select doc_id, count(*) as n from {signals} where signal_type in ('demand_surge', 'supply_bottleneck', 'capex_increase') group by 1) s on s.doc_id = m.doc_id"


@query(f"select company, cast(sum(m) as bigint) as entity_mentions, cast(sum(s) as bigint) as signal_count, floor(least(ln(1.0 + sum(m)) * 18.0 + ln(1.0 + sum(s)) * 8.0, 100.0) * 1e4 + 0.5) / 1e4 as relevance from (select company, doc_id, count(*) as m, max(n) as s from ({_BM}) x group by 1, 2) y group by 1 having sum(m) >= 2")
def beneficiary_entity_match(spark, d):
    e = bind(spark, d, "entities").filter("brand = 'Brand#7'").select("entity_id")
    m = bind(spark, d, "mentions").join(e, "entity_id").join(bind(spark, d, "filings").select("doc_id", "company"), "doc_id")
    s = bind(spark, d, "signals").filter(F.col("signal_type").isin("demand_surge", "supply_bottleneck", "capex_increase")).groupBy("doc_id").agg(F.count("*").alias("signals"))
    return I.entity_match(m, s).select("company", "entity_mentions", "signal_count", q(F.col("relevance")).alias("relevance"))


@query("select company, floor(least(ln(1.0 + signal_count) * 22.0 + case when rank_in_theme % 3 = 0 then 20.0 when rank_in_theme % 3 = 1 then 10.0 else 0.0 end + least(signal_count * 5.0, 20.0), 100.0) * 1e4 + 0.5) / 1e4 as relevance from {beneficiaries}")
def beneficiary_relevance(spark, d):
    role = F.when(F.col("rank_in_theme") % 3 == 0, "bottleneck_player").when(F.col("rank_in_theme") % 3 == 1, "supplier").otherwise("beneficiary")
    return bind(spark, d, "beneficiaries").select("company", q(I.signal_relevance(F.col("signal_count"), role, F.col("signal_count"))).alias("relevance"))


@query("""select theme, company, kind, rank from (select theme, company, kind, row_number() over (partition by theme, kind order by relevance desc, company) as rank from (
          select theme, company, ticker, 'direct' as kind, relevance_c / 100.0 as relevance from {beneficiaries} where rank_in_theme <= 30 and relevance_c >= 800
          union all select theme, company, ticker, 'indirect', relevance_c / 100.0 from {beneficiaries} b where rank_in_theme between 20 and 60 and not exists (select 1 from {beneficiaries} c where c.theme = b.theme and upper(c.ticker) = upper(b.ticker) and c.rank_in_theme <= 30 and c.relevance_c >= 800)) x) y
          where rank <= case kind when 'direct' then 60 else 10 end""")
def beneficiaries_combined(spark, d):
    b = bind(spark, d, "beneficiaries").select("theme", "company", "ticker", "rank_in_theme", (F.col("relevance_c") / 100.0).alias("relevance"))
    return I.combine_beneficiaries(b.filter("rank_in_theme <= 30").drop("rank_in_theme"), b.filter("rank_in_theme between 20 and 60").drop("rank_in_theme")).select("theme", "company", "kind", "rank")


_RULES = "select * from (values ('click', 'above', 0.0, 'SURGE', 'high'), ('view', 'below', 1.0, 'SLUMP', 'low'), ('error', 'above', 100.0, 'FAULTS', 'medium'), ('purchase', 'below', 100000000.0, 'WEAK', 'high')) t(series_id, direction, threshold, event_type, severity)"


@query(f"""select r.series_id, r.event_type, r.severity, l.cents from (select series_id, arg_max(cents, obs_date) as cents from {{series}} group by 1) l join ({_RULES}) r on r.series_id = l.series_id
           where (direction = 'above' and cents / 100.0 > threshold) or (direction = 'below' and cents / 100.0 < threshold)""")
def threshold_events(spark, d):
    latest = bind(spark, d, "series").groupBy("series_id").agg(F.max_by("cents", "obs_date").alias("cents")).withColumn("value", F.col("cents") / 100.0)
    return I.threshold_events(latest, spark.sql(_RULES)).select("series_id", "event_type", "severity", "cents")


_ML = "select * from (values ('SURGE', 'machinery', 'amplifies', 0.5), ('SURGE', 'nation_1', 'constrains', 0.25), ('WEAK', 'furniture', 'constrains', 0.75), ('NONE', 'building', 'amplifies', 1.0)) t(event_type, keyword, link_type, strength)"


@query(f"""select t.theme, cast(coalesce(sum(case when l.link_type = 'constrains' then -l.strength else l.strength end), 0) as double) as macro_score from (select distinct theme from {{snapshots}}) t
           left join (select * from ({_ML}) m where event_type in ('SURGE', 'WEAK')) l on t.theme like '%' || l.keyword || '%' group by 1""")
def macro_enrichment(spark, d):
    themes = bind(spark, d, "snapshots").select("theme").distinct()
    events = spark.sql("select * from (values ('SURGE'), ('WEAK'), ('WEAK')) t(event_type)")
    return I.macro_scores(themes, events, spark.sql(_ML).withColumn("strength", F.col("strength").cast("double"))).select("theme", "macro_score")


@query("""select c_mktsegment as theme, qi, floor((p - n) / (p + n) * 1e4 + 0.5) / 1e4 as net, events from (select c_mktsegment, cast(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 as bigint) as qi, cast(sum(case when o_orderstatus = 'F' then w else 0 end) as double) as p, cast(sum(case when o_orderstatus = 'O' then w else 0 end) as double) as n, cast(count(*) as bigint) as events
          from (select *, case when o_totalprice < 50000 then 0.25 when o_totalprice < 200000 then 0.5 when o_totalprice < 400000 then 0.75 else 1.0 end as w from {orders} join {customer} on c_custkey = o_custkey) x group by 1, 2) y""")
def macro_pressure(spark, d):
    o = bind(spark, d, "orders").join(bind(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("theme")), F.col("o_custkey") == F.col("c_custkey"))
    p = F.col("o_totalprice")
    rows = o.select(
        "theme", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("bigint").alias("qi"),
        F.when(F.col("o_orderstatus") == "F", "positive").when(F.col("o_orderstatus") == "O", "negative").alias("direction"),
        F.when(p < 50000, "low").when(p < 200000, "medium").when(p < 400000, "high").otherwise("game_changer").alias("magnitude"),
    )
    return I.macro_pressure(rows, ["theme", "qi"]).select("theme", "qi", q(F.col("net")).alias("net"), "events")


_TARGETS = "select * from (values ('solar', 500.0), ('battery', 60.0), ('rail', 9.0)) t(sector, value)"
_RATIOS = "select * from (values ('solar', 'polysilicon', 2.2), ('solar', 'glass', 0.1), ('battery', 'lithium', 1.5), ('rail', 'steel', 3.0)) t(sector, component, ratio)"
_HAVE = "select * from (values ('polysilicon', 40.0), ('glass', 80.0), ('lithium', 50.0), ('steel', 20.0)) t(component, capacity)"


@query(f"""select t.sector, c.component, floor((t.value * c.ratio - h.capacity) * 1e4 + 0.5) / 1e4 as gap, case when p >= 80 then 'critical' when p >= 60 then 'high' when p >= 35 then 'moderate' else 'low' end as severity from (select t.*, c.component, c.ratio, h.capacity, (t.value * c.ratio - h.capacity) / (t.value * c.ratio) * 100.0 as p
           from ({_TARGETS}) t join ({_RATIOS}) c on c.sector = t.sector join ({_HAVE}) h on h.component = c.component where t.value * c.ratio > h.capacity) x join ({_TARGETS}) t on t.sector = x.sector join ({_RATIOS}) c on c.component = x.component join ({_HAVE}) h on h.component = x.component""")
def capacity_gap(spark, d):
    cast = lambda t, *cs: t.withColumns({c: F.col(c).cast("double") for c in cs})
    rows = I.capacity_gaps(cast(spark.sql(_TARGETS), "value"), cast(spark.sql(_RATIOS), "ratio"), cast(spark.sql(_HAVE), "capacity"))
    return rows.select("sector", "component", q(F.col("gap")).alias("gap"), "severity")


def _values(rows, names: str) -> str:
    def word(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "select * from (values " + ", ".join("(" + ", ".join(word(v) for v in r) + ")" for r in rows) + f") t({names})"


_POLICY_GOALS = _values([(t[1], t[2], t[3]) for t in ST.POLICY_TARGETS], "sector, metric, value")
_NEEDS, _MADE = _values(ST.CAPACITY_RATIOS, "sector, component, ratio"), _values(ST.DOMESTIC_CAPACITY, "component, capacity")


@query(f"""select sector, metric, component, floor((cast(value as double) * cast(ratio as double) - cast(capacity as double)) * 1e4 + 0.5) / 1e4 as gap from ({_POLICY_GOALS}) t join ({_NEEDS}) c using (sector) join ({_MADE}) h using (component) where cast(value as double) * cast(ratio as double) > capacity""")
def policy_capacity_gap(spark, d):
    rows = I.capacity_gaps(ST.policy_targets(spark), ST.capacity_ratios(spark), ST.domestic_capacity(spark))
    return rows.select("sector", "metric", "component", q(F.col("gap")).alias("gap"))


_IMPORTS = _values(ST.IMPORT_DEPENDENCIES, "sector, component, share, value_bn, substitutable, horizon_years")
_SCHEMES = _values([(sector, scheme) for sector, many in ST.INCENTIVE_SCHEMES for scheme in many], "sector, scheme")


@query(f"""select sector, component, cast(n as bigint) as schemes, case when share >= 0.85 then 'critical' when share >= 0.65 then 'high' else 'moderate' end as risk,
           floor((0.35 * cast(share as double) + 0.25 * least(n / 4.0, 1.0) + 0.20 * greatest(0.0, 1.0 - horizon_years / 10.0) + 0.20 * least(cast(value_bn as double) / 5.0, 1.0)) * 1e4 + 0.5) / 1e4 as score
           from ({_IMPORTS}) i join (select sector, count(*) as n from ({_SCHEMES}) s group by 1) k using (sector) where share >= 0.60 and substitutable""")
def import_replacement(spark, d):
    rows = I.localization(ST.import_dependencies(spark), ST.incentive_schemes(spark))
    return rows.select("sector", "component", "schemes", I.import_risk(F.col("share")).alias("risk"), q(F.col("score")).alias("score"))


@query("""select s_suppkey, share, case when share >= 0.85 then 'critical' when share >= 0.65 then 'high' else 'moderate' end as risk, floor((0.35 * share + 0.25 * least(n / 4.0, 1.0) + 0.20 * greatest(0.0, 1.0 - h / 10.0) + 0.20 * least(v / 5.0, 1.0)) * 1e4 + 0.5) / 1e4 as score
          from (select s_suppkey, s_nationkey, cast((s_suppkey * 37) % 100 as double) / 100.0 as share, s_suppkey % 12 as h, s_suppkey % 9 as v from {supplier}) s join (select n_regionkey, n_nationkey, count(*) over (partition by n_regionkey) as n from {nation}) x on x.n_nationkey = s.s_nationkey where share >= 0.60""")
def localization_score(spark, d):
    n = bind(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("sector"))
    s = bind(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    deps = s.select("s_suppkey", "sector", ((k * 37) % 100).cast("double").alias("h")).withColumn("share", F.col("h") / 100.0).withColumns({"horizon_years": k % 12, "value_bn": k % 9, "substitutable": F.lit(True)})
    return I.localization(deps, n).select("s_suppkey", "share", I.import_risk(F.col("share")).alias("risk"), q(F.col("score")).alias("score"))


@query("""select o_orderkey, sector, floor(least(1.0, case sector when 'solar' then 0.75 when 'power_transmission' then 0.85 else 0.40 end + least(o_totalprice / 100.0 / 5000.0, 0.20)) * 1e4 + 0.5) / 1e4 as strength
          from (select *, case when o_orderpriority like '1%' then 'solar' when o_orderpriority like '2%' then 'power_transmission' else 'infrastructure' end as sector from {orders}) x""")
def tender_classification(spark, d):
    rows = bind(spark, d, "orders")
    title = F.when(F.col("o_orderpriority").startswith("1"), "Tender: Solar park").when(F.col("o_orderpriority").startswith("2"), "400 kV Substation works").otherwise("Road works")
    rows = rows.withColumn("sector", I.tender_sector(title))
    return rows.select("o_orderkey", "sector", q(I.tender_strength(F.col("sector"), F.col("o_totalprice") / 100.0)).alias("strength"))


@query("""select o_orderkey, round(o_totalprice / 1000.0) * 1e6 as value, 'USD_million' as unit from {orders}""")
def amount_extract(spark, d):
    rows = bind(spark, d, "orders")
    text = F.concat(F.lit("a total of $"), F.format_number(F.round(F.col("o_totalprice") / 1000.0), 0), F.lit(" million was booked"))
    return rows.withColumn("a", amount(text)).select("o_orderkey", "a.value", "a.unit")


_DISC = "select f.company, count(*) as n, count(*) filter (where signal_type = 'capex_increase') as c, count(*) filter (where signal_type in ('supply_bottleneck', 'demand_surge', 'inventory_drawdown')) as s, bool_or(signal_type in ('demand_surge', 'supply_bottleneck', 'capex_increase')) as o from {signals} x join {filings} f on f.doc_id = x.doc_id where f.country = 'ASIA' group by 1 having count(*) >= 2"


@query(f"select company, has_orders, floor(v * 1e4 + 0.5) / 1e4 as conviction from (select company, o as has_orders, 0.4 * least(n / 20.0, 1.0) + 0.4 * least(c / 5.0, 1.0) + 0.1 * case when o then 1.0 else 0.0 end + 0.1 * least(s / 5.0, 1.0) as v from ({_DISC}) a) b where v >= 0.2")
def india_beneficiaries(spark, d):
    kind = F.col("signal_type")
    rows = bind(spark, d, "signals").join(bind(spark, d, "filings").filter("country = 'ASIA'").select("doc_id", "company"), "doc_id")
    rows = rows.groupBy("company").agg(
        F.count("*").alias("n"), F.count(F.when(kind == "capex_increase", 1)).alias("c"), F.count(F.when(kind.isin("supply_bottleneck", "demand_surge", "inventory_drawdown"), 1)).alias("s"),
        F.bool_or(kind.isin("demand_surge", "supply_bottleneck", "capex_increase")).alias("has_orders"),
    ).filter("n >= 2")
    v = I.discovery_conviction(F.col("n"), F.col("c"), F.col("s"), F.col("has_orders"))
    return rows.withColumn("v", v).filter("v >= 0.2").select("company", "has_orders", q(F.col("v")).alias("conviction"))


_YOY = """select f.sector, f.company, f.doc_id, f.filed_at, s.inv from {filings} f join (select doc_id, count(*) filter (where signal_type in ('demand_surge', 'capex_increase')) as inv from {signals} group by 1) s on s.doc_id = f.doc_id
          where f.filed_at between date '1998-12-31' - 730 and date '1998-12-31'"""


@query(f"""select sector, cast(n as bigint) as companies, cast(r as bigint) as recent, cast(p as bigint) as prior, velocity_pct, floor((0.40 * greatest(0.0, least(1.0, (velocity_pct + 100.0) / 200.0)) + 0.30 * least(ln(1.0 + n) / ln(31.0), 1.0) + 0.15 * cast(docs as double) / alldocs + 0.15 * least(r / 200.0, 1.0)) * 1e4 + 0.5) / 1e4 as score
           from (select *, case when p = 0 then 200.0 else floor((r / cast(p as double) - 1.0) * 100.0 + 0.5) end as velocity_pct from (select sector, count(distinct company) as n, count(distinct doc_id) as docs, sum(case when filed_at >= date '1998-12-31' - 180 then inv else 0 end) as r, sum(case when filed_at between date '1998-12-31' - 545 and date '1998-12-31' - 365 then inv else 0 end) as p
                 from ({_YOY}) x where company in (select company from ({_YOY}) y group by 1 having sum(inv) >= 3 and sum(case when filed_at >= date '1998-12-31' - 180 then inv else 0 end) >= 1) group by 1) z, (select count(distinct doc_id) as alldocs from ({_YOY}) w) g) v where n >= 3 and r >= 5""")
def exploding_yoy(spark, d):
    day = as_of_day()
    inv = bind(spark, d, "signals").groupBy("doc_id").agg(F.count(F.when(F.col("signal_type").isin("demand_surge", "capex_increase"), 1)).alias("inv"))
    f = window(bind(spark, d, "filings"), "1996-12-31", AS_OF).select("doc_id", "sector", "company", "filed_at").join(inv, "doc_id")
    recent = F.sum(F.when(F.col("filed_at") >= F.date_sub(day, 180), F.col("inv")).otherwise(0))
    active = f.groupBy("company").agg(F.sum("inv").alias("a"), recent.alias("b")).filter("a >= 3 and b >= 1")
    prior = F.sum(F.when(F.col("filed_at").between(F.date_sub(day, 545), F.date_sub(day, 365)), F.col("inv")).otherwise(0))
    rows = f.join(active, "company", "left_semi").groupBy("sector").agg(F.countDistinct("company").alias("companies"), F.countDistinct("doc_id").alias("docs"), recent.alias("recent"), prior.alias("prior"))
    rows = rows.crossJoin(F.broadcast(f.agg(F.countDistinct("doc_id").alias("all_docs")))).filter("companies >= 3 and recent >= 5")  # one row
    rows = rows.withColumn("velocity_pct", I.velocity_pct(F.col("recent"), F.col("prior")))
    score = I.explosion_score(F.col("velocity_pct"), F.col("companies"), F.col("docs") / F.col("all_docs"), F.col("recent"))
    return rows.select("sector", "companies", "recent", "prior", "velocity_pct", q(score).alias("score"))
