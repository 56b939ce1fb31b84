"""Upserts and derived writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.bindings import bind
from tessellar.operators import graph as G
from tessellar.operators import upsert as U
from tessellar.queries import query

_OLD, _NEW = "filed_at < date '1998-07-01'", "filed_at >= date '1998-07-01'"
_ENT = """select e.canonical_name, e.entity_type, cast(count(*) as bigint) as mention_count, max(f.filed_at) as last_seen, max(m.doc_id % 100) as confidence, nullif(min(e.brand), 'Brand#1') as ticker
          from {mentions} m join {entities} e on e.entity_id = m.entity_id join {filings} f on f.doc_id = m.doc_id where """


def _entities(spark, d, when):
    f = bind(spark, d, "filings").filter(when).select("doc_id", "filed_at")
    rows = bind(spark, d, "mentions").join(f, "doc_id").join(bind(spark, d, "entities"), "entity_id")
    return rows.groupBy("canonical_name", "entity_type").agg(
        F.count("*").alias("mention_count"), F.max("filed_at").alias("last_seen"), F.max(F.col("doc_id") % 100).alias("confidence"), F.nullif(F.min("brand"), F.lit("Brand#1")).alias("ticker")
    )


@query(f"""select coalesce(o.canonical_name, n.canonical_name) as canonical_name, coalesce(o.entity_type, n.entity_type) as entity_type, coalesce(o.mention_count, 0) + coalesce(n.mention_count, 0) as mention_count,
           greatest(o.last_seen, n.last_seen) as last_seen, greatest(o.confidence, n.confidence) as confidence, coalesce(o.ticker, n.ticker) as ticker
           from ({_ENT} {_OLD} group by 1, 2) o full join ({_ENT} {_NEW} group by 1, 2) n on n.canonical_name = o.canonical_name and n.entity_type = o.entity_type""")
def upsert_entities(spark, d):
    return U.upsert_table("entities", _entities(spark, d, _OLD), _entities(spark, d, _NEW))


_SIG = "select doc_id as document_id, supplier_id % 3 as entity_id, signal_type, direction, max(confidence_pm) as confidence, max(cents) as value from {signals} where doc_id % 4 %s 0 group by 1, 2, 3, 4"


@query(f"""select coalesce(o.document_id, n.document_id) as document_id, coalesce(o.entity_id, n.entity_id) as entity_id, coalesce(o.signal_type, n.signal_type) as signal_type, coalesce(o.direction, n.direction) as direction,
           greatest(o.confidence, n.confidence) as confidence, coalesce(n.value, o.value) as value
           from ({_SIG.replace('% 4 %s 0', '% 4 <> 0')}) o full join ({_SIG.replace('% 4 %s 0', '% 2 = 0')}) n
           on n.document_id = o.document_id and n.entity_id = o.entity_id and n.signal_type = o.signal_type and n.direction = o.direction""")
def upsert_signals_best(spark, d):
    s = bind(spark, d, "signals").withColumn("entity_id", F.col("supplier_id") % 3).withColumnRenamed("doc_id", "document_id")
    by = ["document_id", "entity_id", "signal_type", "direction"]
    made = lambda df: df.groupBy(*by).agg(F.max("confidence_pm").alias("confidence"), F.max("cents").alias("value"))
    return U.upsert_table("signals", made(s.filter("document_id % 4 <> 0")), made(s.filter("document_id % 2 = 0")))


_TH = """select sector as slug, country, min(filed_at) as first_detected, max(filing_type) as hypothesis, max(status) = 'P' as is_active, max(word_count) as strength from {filings} where """


@query(f"""select coalesce(o.slug, n.slug) as slug, coalesce(o.country, n.country) as country, coalesce(o.first_detected, n.first_detected) as first_detected, coalesce(n.hypothesis, o.hypothesis) as hypothesis,
           case when o.slug is null then n.is_active else o.is_active end as is_active, case when n.slug is null then o.strength else n.strength end as strength
           from ({_TH} filed_at between date '1996-01-01' and date '1996-01-12' group by 1, 2) o full join ({_TH} filed_at between date '1997-03-01' and date '1997-03-12' group by 1, 2) n on n.slug = o.slug and n.country = o.country""")
def upsert_theme_keep_first(spark, d):
    def made(low, high):
        f = bind(spark, d, "filings").filter(f"filed_at between date '{low}' and date '{high}'")
        return f.groupBy(F.col("sector").alias("slug"), "country").agg(
            F.min("filed_at").alias("first_detected"), F.max("filing_type").alias("hypothesis"), (F.max("status") == "P").alias("is_active"), F.max("word_count").alias("strength")
        )

    return U.upsert_table("themes", made("1996-01-01", "1996-01-12"), made("1997-03-01", "1997-03-12"))


@query("""select n.n_name as theme, cast(count(distinct c.c_custkey) filter (where c.c_acctbal > 8000) as bigint) as company_count from {nation} n left join {customer} c on c.c_nationkey = n.n_nationkey group by 1""")
def sync_company_counts(spark, d):
    themes = bind(spark, d, "nation").select(F.col("n_name").alias("theme"), "n_nationkey", F.lit(0).alias("company_count"))
    members = bind(spark, d, "customer").filter("c_acctbal > 8000").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return U.sync_counts(themes, members, "n_nationkey", "c_custkey", "company_count").select("theme", "company_count")


@query("""select src, rel, dst, cast(sum(weight) as bigint) as weight from (select src, 'SUPPLIES' as rel, dst, weight from {edges} union all select dst, 'SUPPLIES', src, weight * 2 from {edges}) x group by 1, 2, 3""")
def edge_weight_merge(spark, d):
    e = bind(spark, d, "edges").select("src", F.lit("SUPPLIES").alias("rel"), "dst", "weight")
    back = e.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"), (F.col("weight") * 2).alias("weight"))
    return G.merge_edges(e, back)


@query("""select o.doc_id from {filings} o where o.status = 'O' and o.doc_id not in (select doc_id from {mentions})""")
def pending_documents(spark, d):
    """Status as an anti-join on what a stage has written, instead of a mutable column."""
    return bind(spark, d, "filings").filter("status = 'O'").select("doc_id").join(bind(spark, d, "mentions").select("doc_id"), "doc_id", "left_anti")
