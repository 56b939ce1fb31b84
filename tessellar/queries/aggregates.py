"""Aggregations, pivots, views and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.bindings import bind
from tessellar.functions.scalars import q, quarter_label
from tessellar.operators import relational as R
from tessellar.operators import windows as W
from tessellar.queries import AS_OF, as_of_day, query


@query("""select (select cast(count(*) as bigint) from {filings}) as documents, (select cast(count(*) as bigint) from {entities}) as entities,
                 (select cast(count(*) as bigint) from {signals}) as signals, (select cast(count(distinct theme) as bigint) from {snapshots}) as themes,
                 (select cast(count(distinct company) as bigint) from {filings}) as companies, (select cast(count(*) as bigint) from {edges}) as edges,
                 (select cast(count(*) as bigint) from {beneficiaries}) as beneficiaries""")
def kpi_row(spark, d):
    counts = {"documents": ("filings", "*"), "entities": ("entities", "*"), "signals": ("signals", "*"), "themes": ("snapshots", "theme"), "companies": ("filings", "company"), "edges": ("edges", "*"), "beneficiaries": ("beneficiaries", "*")}
    out = None
    for name, (table, col) in counts.items():
        one = bind(spark, d, table).agg((F.count("*") if col == "*" else F.countDistinct(col)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one-row sides
    return out


@query("""select sector, cast(count(*) as bigint) as filings, cast(count(distinct company) as bigint) as companies, cast(sum(word_count) as bigint) as words,
                 min(filed_at) as first_filed, max(filed_at) as last_filed, floor(avg(word_count) * 100 + 0.5) / 100 as avg_words from {filings} group by 1""")
def sector_stats(spark, d):
    return bind(spark, d, "filings").groupBy("sector").agg(
        F.count("*").alias("filings"), F.countDistinct("company").alias("companies"), F.sum("word_count").alias("words"),
        F.min("filed_at").alias("first_filed"), F.max("filed_at").alias("last_filed"), q(F.avg("word_count"), 2).alias("avg_words"),
    )


@query("""select f.sector, cast(count(*) filter (where s.signal_type = 'demand_surge') as bigint) as demand, cast(count(*) filter (where s.signal_type = 'supply_bottleneck') as bigint) as supply,
                 cast(count(distinct f.company) filter (where s.signal_type = 'capex_increase') as bigint) as capex_companies, bool_or(s.confidence_pm >= 100) as has_sure
          from {signals} s join {filings} f on f.doc_id = s.doc_id group by 1""")
def sector_signal_filters(spark, d):
    rows = bind(spark, d, "signals").join(bind(spark, d, "filings").select("doc_id", "sector", "company"), "doc_id")
    kind = F.col("signal_type")
    return rows.groupBy("sector").agg(
        R.count_if(kind == "demand_surge").alias("demand"), R.count_if(kind == "supply_bottleneck").alias("supply"),
        R.count_distinct_if(kind == "capex_increase", "company").alias("capex_companies"), F.bool_or(F.col("confidence_pm") >= 100).alias("has_sure"),
    )


@query("""select signal_type, direction, cast(count(*) as bigint) as n from {signals} group by cube (signal_type, direction)""")
def signal_summary_cube(spark, d):
    return bind(spark, d, "signals").cube("signal_type", "direction").agg(F.count("*").alias("n"))


@query("""select signal_type, cast(sum(case when direction = 'positive' then 1 else 0 end) as bigint) as positive, cast(sum(case when direction = 'negative' then 1 else 0 end) as bigint) as negative from {signals} group by 1""")
def signal_direction_pivot(spark, d):
    return bind(spark, d, "signals").groupBy("signal_type").pivot("direction", ["positive", "negative"]).agg(F.count("doc_id"))


@query("""select f.company, string_agg(s.signal_type, ' ' order by s.confidence_pm desc, s.signal_type) as kinds from
          (select distinct doc_id, signal_type, confidence_pm from {signals} where confidence_pm >= 90) s join {filings} f on f.doc_id = s.doc_id where f.country = 'EUROPE' group by 1""")
def string_agg_snippets(spark, d):
    s = bind(spark, d, "signals").filter("confidence_pm >= 90").select("doc_id", "signal_type", "confidence_pm").distinct()
    rows = s.join(bind(spark, d, "filings").filter("country = 'EUROPE'").select("doc_id", "company"), "doc_id")
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence_pm")).alias("o"), "signal_type")))
    return rows.groupBy("company").agg(F.array_join(F.transform(order, lambda x: x["signal_type"]), " ").alias("kinds"))


@query("""select doc_id, string_agg(signal_type || '=' || n, ',' order by signal_type) as counts, cast(sum(n) as bigint) as total
          from (select doc_id, signal_type, count(*) as n from {signals} group by 1, 2) x group by 1""")
def type_count_map(spark, d):
    rows = R.map_counts(bind(spark, d, "signals"), ["doc_id"], "signal_type")
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rows.select("doc_id", text.alias("counts"), "total")


@query("""select canonical_name, string_agg(x, ',' order by x) as sectors from (select distinct e.canonical_name, f.sector as x from {mentions} m join {entities} e on e.entity_id = m.entity_id
          join {filings} f on f.doc_id = m.doc_id where e.size <= 2) y group by 1""")
def entity_sectors_array(spark, d):
    e = bind(spark, d, "entities").filter("size <= 2").select("entity_id", "canonical_name")
    rows = bind(spark, d, "mentions").join(e, "entity_id").join(bind(spark, d, "filings").select("doc_id", "sector"), "doc_id")
    return rows.groupBy("canonical_name").agg(F.array_join(F.array_sort(F.collect_set("sector")), ",").alias("sectors"))


_QUARTERS = """select theme, cast(year(snapshot_date) as bigint) as yr, cast(quarter(snapshot_date) as bigint) as qtr, max(strength_c) as strength_c, cast(sum(doc_count) as bigint) as docs,
               cast(sum(momentum_c) as bigint) as momentum_sum, cast(count(*) as bigint) as n from {snapshots} where strength_c >= 2000 group by 1, 2, 3"""


def _quarters(spark, d):
    rows = bind(spark, d, "snapshots").filter("strength_c >= 2000")
    return rows.groupBy("theme", F.year("snapshot_date").cast("bigint").alias("yr"), F.quarter("snapshot_date").cast("bigint").alias("qtr")).agg(
        F.max("strength_c").alias("strength_c"), F.sum("doc_count").alias("docs"), F.sum("momentum_c").alias("momentum_sum"), F.count("*").alias("n")
    )


@query(f"""select theme, cast(count(*) as bigint) as quarters, floor(avg(strength_c) * 100 + 0.5) / 100 as avg_strength, max(strength_c) as peak, min(strength_c) as trough,
           arg_max(strength_c, yr * 4 + qtr) - arg_min(strength_c, yr * 4 + qtr) as trend, string_agg(yr || 'Q' || qtr || ':' || strength_c, ' ' order by yr, qtr) as series
           from ({_QUARTERS}) x group by 1 having count(*) >= 8""")
def quarter_shortlist(spark, d):
    rows = _quarters(spark, d).withColumn("at", F.col("yr") * 4 + F.col("qtr"))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("yr", "qtr", "strength_c"))), lambda x: F.concat(x["yr"].cast("string"), F.lit("Q"), x["qtr"].cast("string"), F.lit(":"), x["strength_c"].cast("string")))
    both = W.first_last(rows, ["theme"], "at", "strength_c").select("theme", "trend", F.col("high").alias("peak"), F.col("low").alias("trough"))
    out = rows.groupBy("theme").agg(F.count("*").alias("quarters"), q(F.avg("strength_c"), 2).alias("avg_strength"), F.array_join(labels, " ").alias("series"))
    return out.filter("quarters >= 8").join(both, "theme").select("theme", "quarters", "avg_strength", "peak", "trough", "trend", "series")


@query(f"select theme, yr, qtr, strength_c, docs, floor(momentum_sum / n + 0.5) as avg_momentum, strength_c >= 3000 as confirmed from ({_QUARTERS}) x where yr <= 1998")
def quarter_persistence(spark, d):
    rows = _quarters(spark, d).filter("yr <= 1998")
    return rows.select("theme", "yr", "qtr", "strength_c", "docs", F.floor(F.col("momentum_sum") / F.col("n") + 0.5).cast("double").alias("avg_momentum"), (F.col("strength_c") >= 3000).alias("confirmed"))


@query(f"select theme, cast(count(*) as bigint) as confirmed from ({_QUARTERS}) x where strength_c >= 3000 group by 1")
def confirmed_quarters(spark, d):
    return _quarters(spark, d).filter("strength_c >= 3000").groupBy("theme").agg(F.count("*").alias("confirmed"))


@query(f"""select theme, string_agg(snapshot_date || ':' || doc_count, ' ' order by snapshot_date) as spark from {{snapshots}} where snapshot_date > date '{AS_OF}' - interval 365 day and snapshot_date <= date '{AS_OF}' group by 1""")
def sparkline(spark, d):
    rows = bind(spark, d, "snapshots").filter((F.col("snapshot_date") > F.date_sub(as_of_day(), 365)) & (F.col("snapshot_date") <= as_of_day()))
    points = F.transform(F.array_sort(F.collect_list(F.struct("snapshot_date", "doc_count"))), lambda x: F.concat_ws(":", x["snapshot_date"].cast("string"), x["doc_count"].cast("string")))
    return rows.groupBy("theme").agg(F.array_join(points, " ").alias("spark"))


@query("""select f.sector, s.signal_type, cast(count(*) as bigint) as n, floor(avg(s.confidence_pm) * 100 + 0.5) / 100 as avg_confidence, max(s.confidence_pm) as max_confidence
          from {signals} s join {filings} f on f.doc_id = s.doc_id group by 1, 2""")
def heatmap(spark, d):
    rows = bind(spark, d, "signals").join(bind(spark, d, "filings").select("doc_id", "sector"), "doc_id")
    return rows.groupBy("sector", "signal_type").agg(F.count("*").alias("n"), q(F.avg("confidence_pm"), 2).alias("avg_confidence"), F.max("confidence_pm").alias("max_confidence"))


@query("""select theme, snapshot_date, strength_c from {snapshots} s where snapshot_date = (select max(snapshot_date) from {snapshots} t where t.theme = s.theme)""")
def narrative_latest(spark, d):
    rows = bind(spark, d, "snapshots")
    return rows.groupBy("theme").agg(F.max_by(F.struct("snapshot_date", "strength_c"), "snapshot_date").alias("s")).select("theme", "s.snapshot_date", "s.strength_c")


@query("""select signal_type, cast(count(*) as bigint) as n, floor(100.0 * sum(case when cents > 3000000 then 1 else 0 end) / nullif(count(*), 0) * 1e4 + 0.5) / 1e4 as win_rate,
                 cast(max(cents) as bigint) as best, cast(min(cents) as bigint) as worst from {signals} group by 1""")
def prediction_accuracy(spark, d):
    wins = F.sum(F.when(F.col("cents") > 3000000, 1).otherwise(0))
    return bind(spark, d, "signals").groupBy("signal_type").agg(
        F.count("*").alias("n"), q(F.lit(100.0) * wins / F.nullif(F.count("*"), F.lit(0))).alias("win_rate"), F.max("cents").alias("best"), F.min("cents").alias("worst")
    )


@query(f"""select theme, first_detected, cast(date '{AS_OF}' - first_detected as bigint) as age_days, case when date '{AS_OF}' - first_detected <= 90 then 'Fresh'
           when date '{AS_OF}' - first_detected <= 365 then 'Active' else 'Mature' end as freshness, strength_c
           from (select theme, min(snapshot_date) as first_detected, arg_max(strength_c, snapshot_date) as strength_c from {{snapshots}} where snapshot_date <= date '{AS_OF}' and strength_c >= 9000 group by 1) x""")
def theme_freshness(spark, d):
    rows = bind(spark, d, "snapshots").filter((F.col("snapshot_date") <= as_of_day()) & (F.col("strength_c") >= 9000))
    rows = rows.groupBy("theme").agg(F.min("snapshot_date").alias("first_detected"), F.max_by("strength_c", "snapshot_date").alias("strength_c"))
    age = F.datediff(as_of_day(), "first_detected")
    label = F.when(age <= 90, "Fresh").when(age <= 365, "Active").otherwise("Mature")
    return rows.select("theme", "first_detected", age.cast("bigint").alias("age_days"), label.alias("freshness"), "strength_c")


@query("""select ticker, company, max(relevance_c * case when theme like 'machinery%' or theme like 'building%' then 2 else 1 end) as best, string_agg(distinct theme, ',' order by theme) as themes from {beneficiaries} group by 1, 2""")
def company_stats_boost(spark, d):
    boost = F.when(F.col("theme").rlike("(?i)^(?:machinery|building)"), 2).otherwise(1)
    return bind(spark, d, "beneficiaries").groupBy("ticker", "company").agg(F.max(F.col("relevance_c") * boost).alias("best"), F.array_join(F.array_sort(F.collect_set("theme")), ",").alias("themes"))


@query("""select 'Q' || quarter(filed_at) || '-' || year(filed_at) as quarter, cast(count(*) as bigint) as filings from {filings} group by 1""")
def filings_by_quarter(spark, d):
    return bind(spark, d, "filings").groupBy(quarter_label(F.col("filed_at")).alias("quarter")).agg(F.count("*").alias("filings"))


@query("""select src, cast(count(*) as bigint) as targets, cast(sum(weight) as bigint) as weight, floor(cast(max(weight) as double) / sum(weight) * 1e4 + 0.5) / 1e4 as top_share from {edges} group by 1""")
def edge_concentration(spark, d):
    return bind(spark, d, "edges").groupBy("src").agg(F.count("*").alias("targets"), F.sum("weight").alias("weight"), q(F.max("weight").cast("double") / F.sum("weight")).alias("top_share"))


@query("""select event_type, cast(json_extract_string(props, '$.k') as bigint) % 10 as k, cast(count(*) as bigint) as n from {events} group by 1, 2""")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint") % 10
    return bind(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("""select l_returnflag, l_linestatus, cast(count(*) as bigint) as n, cast(sum(cast(round(l_quantity) as bigint)) as bigint) as qty, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents
          from {lineitem} where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark, d):
    rows = bind(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(F.round("l_quantity").cast("bigint")).alias("qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents")
    )
