"""Scans, filters, joins and list views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.bindings import bind, window
from tessellar.functions.scalars import q
from tessellar.operators import relational as R
from tessellar.queries import AS_OF, as_of_day, query


@query("select doc_id, company, filed_at from {filings} where status = 'F' and country = 'ASIA' order by filed_at desc, doc_id limit 100")
def documents_by_status(spark, d):
    rows = R.optional(bind(spark, d, "filings"), status="F", country="ASIA", filing_type=None)
    return rows.orderBy(F.desc("filed_at"), "doc_id").limit(100).select("doc_id", "company", "filed_at")


@query("select doc_id, filed_at from {filings} where status = 'F' and filed_at between date '1997-01-01' and date '1997-06-30' order by filed_at, doc_id limit 500")
def documents_for_replay(spark, d):
    rows = R.optional(window(bind(spark, d, "filings"), "1997-01-01", "1997-06-30"), status="F")
    return rows.orderBy("filed_at", "doc_id").limit(500).select("doc_id", "filed_at")


@query(f"select doc_id, status, filed_at from {{filings}} where status in ('F', 'P') and filed_at <= date '{AS_OF}'")
def documents_as_of(spark, d):
    return window(bind(spark, d, "filings"), None, AS_OF).filter(F.col("status").isin("F", "P")).select("doc_id", "status", "filed_at")


@query("""select cast(m as date) as month_start, cast(m + interval 1 month - interval 1 day as date) as month_end
          from generate_series(timestamp '1996-01-01', timestamp '1997-12-01', interval 1 month) t(m)""")
def month_windows(spark, d):
    months = spark.sql("select explode(sequence(date '1996-01-01', date '1997-12-01', interval 1 month)) as month_start")
    return months.withColumn("month_end", F.last_day("month_start"))


_FANOUT = """select f.doc_id, f.company, f.filed_at, coalesce(s.n, 0) as signals, coalesce(m.n, 0) as entities, s.avg_conf
    from {filings} f
    left join (select doc_id, cast(count(*) as bigint) as n, floor(avg(confidence_pm) * 1e4 + 0.5) / 1e4 as avg_conf from {signals} group by 1) s on s.doc_id = f.doc_id
    left join (select doc_id, cast(count(*) as bigint) as n from {mentions} group by 1) m on m.doc_id = f.doc_id"""


@query(_FANOUT)
def left_double_fanout(spark, d):
    s = bind(spark, d, "signals").groupBy("doc_id").agg(F.count("*").alias("signals"), q(F.avg("confidence_pm")).alias("avg_conf"))
    m = bind(spark, d, "mentions").groupBy("doc_id").agg(F.count("*").alias("entities"))
    rows = bind(spark, d, "filings").select("doc_id", "company", "filed_at").join(s, "doc_id", "left").join(m, "doc_id", "left")
    return rows.fillna(0, ["signals", "entities"]).select("doc_id", "company", "filed_at", "signals", "entities", "avg_conf")


@query(f"select * from ({_FANOUT}) x where filed_at >= date '1998-01-01' order by filed_at desc, doc_id limit 500")
def filings_list(spark, d):
    return left_double_fanout(spark, d).filter("filed_at >= date '1998-01-01'").orderBy(F.desc("filed_at"), "doc_id").limit(500)


@query("""select doc_id, entity_id, signal_type, confidence_pm from {signals} where doc_id in (1, 7, 42, 100, 999) """)
def document_signals(spark, d):
    rows = bind(spark, d, "signals").filter(F.col("doc_id").isin(1, 7, 42, 100, 999))
    return rows.orderBy(F.desc("confidence_pm"), "entity_id").select("doc_id", "entity_id", "signal_type", "confidence_pm")


@query("select distinct f.doc_id, b.theme from {filings} f join {beneficiaries} b on lower(b.ticker) = lower(f.ticker)")
def document_themes(spark, d):
    b = bind(spark, d, "beneficiaries").select(F.lower("ticker").alias("k"), "theme")
    return bind(spark, d, "filings").join(b, F.lower("ticker") == F.col("k")).select("doc_id", "theme").distinct()


@query("""select f.company, max(f.ticker) as ticker, cast(count(*) as bigint) as filings, min(filed_at) as first_filed, max(filed_at) as last_filed,
                 cast(count(distinct year(filed_at)) as bigint) as active_years, cast(sum(coalesce(s.n, 0)) as bigint) as signals
          from {filings} f left join (select doc_id, count(*) as n from {signals} group by 1) s on s.doc_id = f.doc_id group by 1""")
def company_profile(spark, d):
    s = bind(spark, d, "signals").groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = bind(spark, d, "filings").join(s, "doc_id", "left")
    return rows.groupBy("company").agg(
        F.max("ticker").alias("ticker"), F.count("*").alias("filings"), F.min("filed_at").alias("first_filed"), F.max("filed_at").alias("last_filed"),
        F.countDistinct(F.year("filed_at")).alias("active_years"), F.coalesce(F.sum("n"), F.lit(0)).alias("signals"),
    )


@query("select company, cast(date_trunc('month', filed_at) as date) as month, cast(count(*) as bigint) as filings from {filings} group by 1, 2")
def company_timeline_monthly(spark, d):
    month = F.trunc("filed_at", "month")
    return bind(spark, d, "filings").groupBy("company", month.alias("month")).agg(F.count("*").alias("filings"))


@query("select company, ticker, theme, relevance_c from {beneficiaries} where rank_in_theme <= 3")
def company_themes(spark, d):
    return bind(spark, d, "beneficiaries").filter("rank_in_theme <= 3").select("company", "ticker", "theme", "relevance_c")


@query("select company, cast(count(*) as bigint) as filings from {filings} where lower(company) like '%0001%' group by 1 order by filings desc, company limit 20")
def company_search(spark, d):
    rows = bind(spark, d, "filings").filter(F.contains(F.lower("company"), F.lit("0001"))).groupBy("company").agg(F.count("*").alias("filings"))
    return rows.orderBy(F.desc("filings"), "company").limit(20)


@query("""select t.theme, n.n_name as entity from (select distinct theme from {snapshots}) t join {nation} n on lower(t.theme) like '%' || lower(n.n_name) || '%'""")
def theme_contains_entity(spark, d):
    themes = bind(spark, d, "snapshots").select("theme").distinct()
    return R.contains_join(themes, "theme", bind(spark, d, "nation"), "n_name").select("theme", F.col("n_name").alias("entity"))


@query("""select t.theme, f.company, cast(count(*) as bigint) as docs, min(f.filed_at) as first_mention, max(f.filed_at) as last_mention,
                 cast(count(distinct f.filing_type) as bigint) as filing_types
          from (select distinct theme from {snapshots} where theme like 'machinery%') t join {filings} f on t.theme like '%' || lower(f.sector) || '%'
          group by 1, 2""")
def source_companies(spark, d):
    f = bind(spark, d, "filings")
    themes = bind(spark, d, "snapshots").filter("theme like 'machinery%'").select("theme").distinct()
    names = R.contains_join(themes, "theme", f.select("sector").distinct(), "sector")
    return f.join(names, "sector").groupBy("theme", "company").agg(
        F.count("*").alias("docs"), F.min("filed_at").alias("first_mention"), F.max("filed_at").alias("last_mention"), F.countDistinct("filing_type").alias("filing_types")
    )


@query("""select e.canonical_name, s.doc_id, s.confidence_pm, s.signal_date, s.cents from {signals} s join {entities} e on e.entity_id = s.entity_id
          where lower(e.canonical_name) like '%ring%' and s.signal_type = 'supply_bottleneck'
          order by s.confidence_pm desc, s.signal_date desc, s.doc_id, s.cents, e.entity_id limit 50""")
def signal_evidence_contains(spark, d):
    e = bind(spark, d, "entities").filter(F.contains(F.lower("canonical_name"), F.lit("ring"))).select("entity_id", "canonical_name")
    rows = bind(spark, d, "signals").filter("signal_type = 'supply_bottleneck'").join(e, "entity_id")
    top = rows.orderBy(F.desc("confidence_pm"), F.desc("signal_date"), "doc_id", "cents", "entity_id").limit(50)
    return top.select("canonical_name", "doc_id", "confidence_pm", "signal_date", "cents")


@query("select theme, company, first_seen, last_seen from {beneficiaries} where first_seen <= date '1997-12-31' and last_seen >= date '1997-01-01'")
def beneficiaries_overlap(spark, d):
    rows = R.overlapping(bind(spark, d, "beneficiaries"), "first_seen", "last_seen", F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
    return rows.select("theme", "company", "first_seen", "last_seen")


@query(f"select theme, company, rank_in_theme from {{beneficiaries}} where first_seen is null or first_seen <= date '{AS_OF}'")
def beneficiaries_as_of(spark, d):
    rows = bind(spark, d, "beneficiaries").filter(F.col("first_seen").isNull() | (F.col("first_seen") <= as_of_day()))
    return rows.orderBy(F.asc_nulls_last("rank_in_theme")).select("theme", "company", "rank_in_theme")


@query("""select s.theme, s.snapshot_date, s.strength_c from {snapshots} s
          where s.theme in (select theme from {snapshots} group by 1 having count(distinct date_trunc('quarter', snapshot_date)) >= 20)""")
def multi_quarter_semi(spark, d):
    rows = bind(spark, d, "snapshots").withColumn("quarter", F.date_trunc("quarter", "snapshot_date"))
    return R.in_at_least(rows, ["theme"], "quarter", 20).select("theme", "snapshot_date", "strength_c")


@query("select c_name as company from {customer} where c_name not in (select company from {filings} where filed_at >= date '2000-06-01')")
def anti_without_filings(spark, d):
    seen = window(bind(spark, d, "filings"), "2000-06-01", "9999-12-30").select("company")
    return bind(spark, d, "customer").select(F.col("c_name").alias("company")).join(seen, "company", "left_anti")


@query("""select distinct upper(b.ticker) as ticker from {beneficiaries} b where b.rank_in_theme > 20
          and upper(b.ticker) not in (select upper(ticker) from {beneficiaries} where rank_in_theme <= 2)""")
def indirect_minus_direct(spark, d):
    b = bind(spark, d, "beneficiaries").withColumn("ticker", F.upper("ticker"))
    return b.filter("rank_in_theme > 20").select("ticker").distinct().join(b.filter("rank_in_theme <= 2").select("ticker"), "ticker", "left_anti")


@query("""select * from (select theme, company, relevance_c, row_number() over (partition by theme order by relevance_c desc, company) as rank from {beneficiaries}) x where rank <= 3""")
def topk_per_group(spark, d):
    return R.top_k(bind(spark, d, "beneficiaries"), ["theme"], 3, F.desc("relevance_c"), F.col("company")).select("theme", "company", "relevance_c", "rank")


@query("""select doc_id, signal_type, confidence_pm, cents from (select *, row_number() over (partition by doc_id order by confidence_pm desc, cents desc, signal_type, entity_id, signal_date, supplier_id) r from {signals}) x where r = 1""")
def distinct_on_signal(spark, d):
    order = (F.desc("confidence_pm"), F.desc("cents"), F.col("signal_type"), F.col("entity_id"), F.col("signal_date"), F.col("supplier_id"))
    return R.latest(bind(spark, d, "signals"), ["doc_id"], *order).select("doc_id", "signal_type", "confidence_pm", "cents")


@query("""select f.company, s.signal_type, s.signal_date, s.confidence_pm, s.cents from {signals} s left join {filings} f on f.doc_id = s.doc_id
          where s.signal_type = 'capex_increase' and s.signal_date between (select max(signal_date) from {signals}) - interval 30 day and (select max(signal_date) from {signals})""")
def signals_by_type_recent(spark, d):
    s = bind(spark, d, "signals")
    last = F.broadcast(s.agg(F.max("signal_date").alias("as_of")))  # one row
    rows = s.filter("signal_type = 'capex_increase'").crossJoin(last).filter("signal_date between date_sub(as_of, 30) and as_of")
    return rows.join(bind(spark, d, "filings").select("doc_id", "company"), "doc_id", "left").select("company", "signal_type", "signal_date", "confidence_pm", "cents")


@query("""select a.filing_type as type_a, b.filing_type as type_b, cast(count(*) as bigint) as shared from (select distinct company, filing_type from {filings}) a
          join (select distinct company, filing_type from {filings}) b on a.company = b.company and a.filing_type < b.filing_type group by 1, 2""")
def types_sharing_companies(spark, d):
    b = bind(spark, d, "filings").select("company", "filing_type").distinct()
    return R.pairs_within(b, "company", "filing_type").select(F.col("a").alias("type_a"), F.col("b").alias("type_b"), F.col("n").alias("shared"))
