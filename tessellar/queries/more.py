"""Tracking, injection, narratives and macro matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.bindings import bind, sql, window
from tessellar.functions.scalars import q
from tessellar.operators import intelligence as I
from tessellar.operators import tracking as K
from tessellar.queries import as_of_day, query

_W = r"(^|[^\p{L}\p{N}_])"


@query(r"""select doc_id, cast(len(regexp_extract_all(lower(text), '\b(idiot|trash|clown)\b')) as integer) as mentions from {documents} where len(regexp_extract_all(lower(text), '\b(idiot|trash|clown)\b')) > 0""")
def theme_tracker(spark, d):
    return K.track_theme(bind(spark, d, "documents"), ("idiot", "trash", "clown"), ("the",), ("of",)).select("doc_id", "mentions")


@query("""select o_orderkey, floor((0.40 * least(ln(1.0 + o_orderkey % 200) / ln(101.0), 1.0) + 0.35 * (o_orderkey % 10) / 10.0 + 0.25 * least(ln(1.0 + o_orderkey % 14) / ln(11.0), 1.0)) * case when o_orderstatus = 'F' then 0.70 else 1.0 end * 1e4 + 0.5) / 1e4 as strength from {orders}""")
def document_strength(spark, d):
    k = F.col("o_orderkey")
    s = K.document_strength(k % 200, (k % 10) / 10.0, k % 14, F.col("o_orderstatus") == "F")
    return bind(spark, d, "orders").select("o_orderkey", q(s).alias("strength"))


_E = "select m.doc_id, case when m.doc_id % 2 = 0 then upper(e.canonical_name) else e.canonical_name end as canonical_name, e.entity_type, cast(e.size as double) as confidence from {mentions} m join {entities} e on e.entity_id = m.entity_id"


@query(f"""select doc_id, canonical_name, entity_type, confidence from (select *, row_number() over (partition by doc_id order by confidence desc, canonical_name, entity_type) as r2 from (
           select *, row_number() over (partition by doc_id, lower(canonical_name), entity_type order by confidence desc, canonical_name) as r from ({_E}) x) y where r = 1) z where r2 <= 3""")
def entity_dedup_capped(spark, d):
    return K.dedupe_entities(sql(spark, d, _E), 2, 3)


@query(f"""select count(*)::bigint as entities, count(*) filter (where entity_type = 'COMPANY')::bigint as companies from (select distinct doc_id, lower(canonical_name) as n, entity_type from ({_E}) x
           union select doc_id, lower(company), 'COMPANY' from {{filings}}) y""")
def filer_injection(spark, d):
    rows = K.inject_filers(sql(spark, d, _E), bind(spark, d, "filings"))
    return rows.agg(F.count("*").alias("entities"), F.count(F.when(F.col("entity_type") == "COMPANY", 1)).alias("companies"))


@query("""select distinct doc_id, case when lower(text) like '%licensed%' then 'licence' when lower(text) like '%eau%' then 'water' else 'article' end as canonical_name from {documents} where lower(text) like '%licensed%' or lower(text) like '%eau%' or lower(text) like '%the %'""")
def context_injection(spark, d):
    rules = (("licence", "LEGAL", "licensed"), ("water", "X", "eau"), ("article", "X", "the "))
    rows = bind(spark, d, "documents").select("doc_id", F.col("text").alias("context"))
    return K.inject_from_contexts(rows, rules, 1).select("doc_id", "canonical_name")


@query("""select theme, 'via ' || split_part(theme, '-', 1) as driver from (select distinct theme from {snapshots}) x""")
def theme_keywords(spark, d):
    t = bind(spark, d, "snapshots").select("theme").distinct()
    words = K.theme_keywords(F.concat(F.lit("downstream-x-via-"), F.split("theme", "-")[0]), F.col("theme"))
    return t.select("theme", F.concat(F.lit("via "), words[0]).alias("driver"))


_RULES = "select * from (values ('water', 'eau'), ('article', '(^| )the '), ('license', 'licensed')) t(theme, pattern)"


@query(f"""select doc_id as event_id, theme, case doc_id % 4 when 0 then 0.25 when 1 then 0.5 when 2 then 0.75 else 1.0 end::double as relevance from {{documents}}, ({_RULES}) r where regexp_matches(lower(text), pattern)""")
def macro_event_match(spark, d):
    k = F.col("doc_id") % 4
    level = F.when(k == 0, "low").when(k == 1, "medium").when(k == 2, "high").otherwise("game_changer")
    e = bind(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.lit("").alias("title"), F.col("text").alias("description"), level.alias("magnitude"), F.array().cast("array<string>").alias("themes"))
    return K.match_events(e.withColumn("title", F.lit(None).cast("string")), spark.sql(_RULES))


@query("""select n as narrative, arg_min(company, day::varchar || company) as origin, min(day) as first_day, string_agg(distinct sector, ',' order by sector) as sectors, cast(count(distinct company) as bigint) as companies,
          floor(count(*) / greatest(ceil((max(day) - min(day) + 1) / 30.0), 1) * 1e4 + 0.5) / 1e4 as velocity, count(distinct sector) >= 3 as confirmed
          from (select filing_type as n, company, sector, filed_at as day from {filings} where filed_at between date '1998-01-01' and date '1998-02-28') x group by 1""")
def narrative_spread(spark, d):
    f = window(bind(spark, d, "filings"), "1998-01-01", "1998-02-28")
    out = K.narrative_spread(f.select(F.col("filing_type").alias("narrative"), "company", "sector", F.col("filed_at").alias("day")))
    return out.select("narrative", "origin", "first_day", F.array_join("sectors", ",").alias("sectors"), "companies", q(F.col("velocity")).alias("velocity"), "confirmed")


@query("select theme, company, case when date '1998-12-31' - first_seen <= 90 then 'Fresh' when date '1998-12-31' - first_seen <= 365 then 'Active' else 'Mature' end as freshness from {beneficiaries} where first_seen <= date '1998-12-31'")
def company_freshness(spark, d):
    b = bind(spark, d, "beneficiaries").filter("first_seen <= date '1998-12-31'")
    return b.select("theme", "company", K.freshness(F.col("first_seen"), as_of_day()).alias("freshness"))


@query("""select f.company as src, case s.signal_type when 'capex_increase' then 'INVESTS_IN' when 'technology_adoption' then 'USES' else 'REGULATED_BY' end as rel, e.canonical_name as dst, cast(sum(s.confidence_pm) as bigint) as weight
          from {signals} s join {filings} f on f.doc_id = s.doc_id join {entities} e on e.entity_id = s.entity_id where s.signal_type in ('capex_increase', 'technology_adoption', 'regulatory_tailwind') group by 1, 2, 3""")
def signal_relation_edges(spark, d):
    s = bind(spark, d, "signals").join(bind(spark, d, "filings").select("doc_id", "company"), "doc_id").join(bind(spark, d, "entities").select("entity_id", F.col("canonical_name").alias("entity")), "entity_id")
    return K.signal_edges(s.withColumn("confidence", F.col("confidence_pm")))


@query("select n_name as src, 'SUB_THEME_OF' as rel, (select min(n_name) from {nation} m where m.n_regionkey = n.n_regionkey) as dst from {nation} n where n_name <> (select min(n_name) from {nation} m where m.n_regionkey = n.n_regionkey)")
def theme_hierarchy(spark, d):
    n = bind(spark, d, "nation")
    top = n.groupBy("n_regionkey").agg(F.min("n_name").alias("canonical_slug"))
    return K.hierarchy_edges(n.join(top, "n_regionkey").select(F.col("n_name").alias("slug"), "canonical_slug")).select("src", "rel", "dst")


@query("""select rel, cast(count(*) as bigint) as n, floor(sum(weight) * 100 + 0.5) / 100 as weight from (select 'AMPLIFIES' as rel, 0.5 as weight from {nation} union all select 'INPUT_TO', 0.25 from {supplier} union all select 'EXPORTS', 1.0 from {region}) x group by 1""")
def macro_graph(spark, d):
    a = bind(spark, d, "nation").select(F.col("n_name").alias("series_id"), F.lit("amplifies").alias("link_type"), F.col("n_name").alias("theme"), F.lit(0.5).alias("strength"))
    b = bind(spark, d, "supplier").select(F.col("s_name").alias("commodity"), F.lit("s").alias("sector"), F.lit(0.25).alias("share"))
    c = bind(spark, d, "region").select(F.col("r_name").alias("country"), F.lit("c").alias("commodity"), F.lit(1.0).alias("share"))
    return K.macro_edges(a, b, c).groupBy("rel").agg(F.count("*").alias("n"), q(F.sum("weight"), 2).alias("weight"))


@query("""select o_custkey, o_orderkey, o_orderstatus as status, p as previous from (select *, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as p from {orders}) x where p is not null and p <> o_orderstatus""")
def fact_changes(spark, d):
    o = bind(spark, d, "orders").withColumn("valid_from", F.struct("o_orderdate", "o_orderkey"))
    return K.fact_changes(o, ["o_custkey"], "o_orderstatus").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), "previous")


@query("select src, dst, weight from {edges} where src in ('NATION_1', 'NATION_2') or dst in ('NATION_1', 'NATION_2') order by weight desc, src, dst limit 20")
def graph_context_neighbours(spark, d):
    return K.graph_context(bind(spark, d, "edges"), ["NATION_1", "NATION_2"])["neighbours"].select("src", "dst", "weight")


@query("""select doc_id, cast(v as double) as value, 'GW' as unit, 2030 as year from (select o_orderkey as doc_id, o_orderkey % 500 as v from {orders} where o_orderkey % 3 = 0) x""")
def policy_target_extract(spark, d):
    o = bind(spark, d, "orders")
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("India plans Solar capacity of "), (k % 500).cast("string"), F.lit(" GW to be met by 2030."))).otherwise("No plan")
    return I.policy_targets(o.select(k.alias("doc_id"), text.alias("text")), "solar")


@query("""select doc_id, kind, cast(strength as double) as strength from (select doc_id, unnest([{'kind': 'the', 'strength': 0.9, 'ok': contains(lower(text), 'the ')}, {'kind': 'eau', 'strength': 0.5, 'ok': contains(lower(text), 'eau')}], recursive := true) from {documents}) x where ok""")
def order_book_pressure(spark, d):
    return I.order_pressure(bind(spark, d, "documents"), (("the", "the ", 0.9), ("eau", "eau", 0.5))).select("doc_id", "kind", "strength")


@query("select c_custkey, c_mktsegment from {customer} where list_has_any([c_mktsegment, c_name], ['MACHINERY', 'BUILDING'])")
def sector_overlap(spark, d):
    both = F.arrays_overlap(F.array("c_mktsegment", "c_name"), F.array(F.lit("MACHINERY"), F.lit("BUILDING")))
    return bind(spark, d, "customer").filter(both).select("c_custkey", "c_mktsegment")


@query("""select distinct p.p_partkey, t.theme from (select distinct theme from {snapshots}) t join (select p_partkey, unnest(string_split(lower(p_type) || ' ' || 'nation_' || p_size % 5, ' ')) as w from {part}) p on contains(t.theme, p.w)""")
def policy_theme_tokens(spark, d):
    from tessellar.operators.relational import contains_join

    p = bind(spark, d, "part")
    words = p.select("p_partkey", F.explode(F.split(F.concat_ws(" ", F.lower("p_type"), F.concat(F.lit("nation_"), (F.col("p_size") % 5).cast("string"))), " ")).alias("w"))
    themes = bind(spark, d, "snapshots").select("theme").distinct()
    met = contains_join(themes, "theme", words.select("w").distinct(), "w")
    return words.join(met, "w").select("p_partkey", "theme").distinct()
