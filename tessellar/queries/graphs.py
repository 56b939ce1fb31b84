"""Graph queries over edge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.bindings import bind, window
from tessellar.functions.scalars import q
from tessellar.operators import graph as G
from tessellar.queries import query

_BIG = "select src, dst, weight from {edges} where weight >= 5"


def _big(spark, d):
    return bind(spark, d, "edges").filter("weight >= 5")


@query("""select node, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, cast(sum(i + o) as bigint) as degree
          from (select src as node, 0 as i, 1 as o from {edges} union all select dst, 1, 0 from {edges}) x group by 1 having sum(i + o) >= 3""")
def degree_centrality(spark, d):
    return G.degree(bind(spark, d, "edges"))


@query(f"""with recursive walk as (select src as root, dst as node, 1 as hops from ({_BIG}) b where src = 'NATION_3' union all select w.root, e.dst, w.hops + 1 from walk w join ({_BIG}) e on e.src = w.node where w.hops < 3)
           select node, hops, cast(count(*) as bigint) as paths from walk group by 1, 2""")
def supply_paths_depth3(spark, d):
    return G.paths(_big(spark, d), F.col("src") == "NATION_3", 3).groupBy("node", "hops").agg(F.count("*").alias("paths"))


@query(f"""with recursive walk as (select src as root, dst as node, 1 as hops from ({_BIG}) b where src = 'NATION_3' union all select w.root, e.dst, w.hops + 1 from walk w join ({_BIG}) e on e.src = w.node where w.hops < 4)
           select node, cast(min(hops) as integer) as hops from (select node, hops from walk union all select 'NATION_3', 0) x group by 1""")
def reach_levels(spark, d):
    return G.reach(_big(spark, d), "NATION_3", 4)


@query("""select a.entity_id as a, b.entity_id as b, floor(count(*) * 0.3 * 100 + 0.5) / 100 as weight from {mentions} a join {mentions} b on a.doc_id = b.doc_id and a.entity_id < b.entity_id
          join {entities} x on x.entity_id = a.entity_id and x.entity_type = 'ECONOMY' join {entities} y on y.entity_id = b.entity_id and y.entity_type = 'ECONOMY' group by 1, 2""")
def tech_pairs_enable(spark, d):
    e = bind(spark, d, "entities").filter("entity_type = 'ECONOMY'").select("entity_id")
    m = bind(spark, d, "mentions").join(e, "entity_id").select("doc_id", F.col("entity_id").alias("entity"), F.lit("TECHNOLOGY").alias("entity_type"))
    return G.technology_pairs(m).select(F.col("src").alias("a"), F.col("dst").alias("b"), q(F.col("weight"), 2).alias("weight"))


@query("""select e.src, e.dst, e.weight from {edges} e where e.src in (select n_name from {nation} where n_regionkey <= 1) and e.dst in (select n_name from {nation} where n_regionkey <= 1)""")
def subgraph_export(spark, d):
    members = bind(spark, d, "nation").filter("n_regionkey <= 1").select(F.col("n_name").alias("node"))
    return G.subgraph(bind(spark, d, "edges"), members).select("src", "dst", "weight")


@query("""select e.canonical_name, cast(count(distinct f.sector) as bigint) as sectors, cast(count(distinct f.company) as bigint) as companies from {mentions} m join {entities} e on e.entity_id = m.entity_id
          join {filings} f on f.doc_id = m.doc_id group by 1 having count(distinct f.sector) >= 3""")
def cross_sector_tech_paths(spark, d):
    rows = bind(spark, d, "mentions").join(bind(spark, d, "entities").select("entity_id", "canonical_name"), "entity_id").join(bind(spark, d, "filings").select("doc_id", "sector", "company"), "doc_id")
    return rows.groupBy("canonical_name").agg(F.countDistinct("sector").alias("sectors"), F.countDistinct("company").alias("companies")).filter("sectors >= 3")


@query("""select dst, cast(count(distinct src) as bigint) as suppliers, least(8.0 * count(distinct src) + 10.0 * count(distinct n_regionkey), 100.0)::double as strength from {edges} join {nation} on n_name = src where weight >= 20 group by 1 having count(distinct src) >= 3""")
def supply_clusters(spark, d):
    rows = bind(spark, d, "edges").filter("weight >= 20").join(bind(spark, d, "nation"), F.col("src") == F.col("n_name"))
    rows = rows.groupBy("dst").agg(F.countDistinct("src").alias("suppliers"), F.countDistinct("n_regionkey").alias("r")).filter("suppliers >= 3")
    return rows.select("dst", "suppliers", F.least(8.0 * F.col("suppliers") + 10.0 * F.col("r"), F.lit(100.0)).alias("strength"))


@query("""select n_name, cast(count(distinct l_suppkey) as bigint) as suppliers, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents from {lineitem} join {supplier} on s_suppkey = l_suppkey join {nation} on n_nationkey = s_nationkey where l_returnflag = 'R' group by 1 having count(distinct l_suppkey) >= 3""")
def capex_concentration(spark, d):
    rows = bind(spark, d, "lineitem").filter("l_returnflag = 'R'").join(bind(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(bind(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents")).filter("suppliers >= 3")


@query("""select doc_id, entity_id, signal_date from {signals} where signal_type = 'technology_adoption' and signal_date >= (select max(signal_date) from {signals}) - 90""")
def emerging_relationships(spark, d):
    s = bind(spark, d, "signals")
    last = F.broadcast(s.agg(F.max("signal_date").alias("last")))  # one row
    return s.filter("signal_type = 'technology_adoption'").crossJoin(last).filter("signal_date >= date_sub(last, 90)").select("doc_id", "entity_id", "signal_date")


@query("""select supplier_id, entity_id, cast(count(*) as bigint) as n from {signals} where signal_type in ('technology_adoption', 'capex_increase') group by 1, 2 order by n desc, supplier_id, entity_id limit 50""")
def companies_by_technology(spark, d):
    rows = bind(spark, d, "signals").filter(F.col("signal_type").isin("technology_adoption", "capex_increase")).groupBy("supplier_id", "entity_id").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "supplier_id", "entity_id").limit(50)


@query("""select dst as node, cast(count(*) as bigint) as suppliers, least(count(*) * 25.0 + case when dst in (select n_name from {nation} where n_regionkey = 2) then 50.0 else 0.0 end, 100.0)::double as score from {edges} where weight >= 25 group by 1""")
def bottleneck_nodes(spark, d):
    listed = bind(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_name").alias("node"))
    return G.bottleneck_scores(bind(spark, d, "edges").filter("weight >= 25"), listed)


@query("""select company, sector, first_day from (select company, sector, min(filed_at) as first_day, max(filed_at) as last_day from {filings} group by 1, 2) x where first_day <= date '1997-06-30' and (last_day is null or last_day > date '1997-06-30')""")
def facts_valid_at(spark, d):
    facts = bind(spark, d, "filings").groupBy("company", "sector").agg(F.min("filed_at").alias("valid_from"), F.max("filed_at").alias("valid_to"))
    return G.valid_at(facts, F.lit("1997-06-30").cast("date")).select("company", "sector", F.col("valid_from").alias("first_day"))


@query("""select f.company, f.sector as theme, cast(count(*) as bigint) as mentions from {filings} f where f.filed_at between date '1998-04-01' and date '1998-06-30' group by 1, 2""")
def quarter_graph_snapshot(spark, d):
    rows = window(bind(spark, d, "filings"), "1998-04-01", "1998-06-30")
    return rows.groupBy("company", F.col("sector").alias("theme")).agg(F.count("*").alias("mentions"))


@query("""select company, case when word_count % 3 = 0 then 'DEVELOPS' when word_count % 3 = 1 then 'INVESTS_IN' else 'USES' end as rel, cast(count(*) as bigint) as n from {filings} group by 1, 2""")
def relation_from_context(spark, d):
    k = F.col("word_count") % 3
    text = F.when(k == 0, "they designed a chip").when(k == 1, "funded by capex").otherwise("uses the platform")
    rows = bind(spark, d, "filings").withColumn("rel", G.relation(text))
    return rows.groupBy("company", "rel").agg(F.count("*").alias("n"))


@query("""select doc_id, n from (select m.doc_id, cast(count(*) as bigint) as n from {mentions} m join {mentions} k on k.doc_id = m.doc_id where k.entity_id = 7 and m.entity_id <> 7 group by 1) x order by n desc, doc_id limit 20""")
def graph_context_evidence(spark, d):
    m = bind(spark, d, "mentions")
    docs = m.filter("entity_id = 7").select("doc_id")
    return m.filter("entity_id <> 7").join(docs, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(20)
