"""Abstract relations of the engine bound to the driver's tables.

Each binding is one SQL text that both Spark and the oracle understand; ``{name}`` stands
for a base table or another binding. Operators never see these names: they take
DataFrames with the abstract columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

BINDINGS = {
    # filing = order, company = customer, sector = nation, country = region
    "filings": """
        select o_orderkey as doc_id, c_name as company, concat('T', cast(c_custkey as varchar(20))) as ticker, n_name as sector,
               r_name as country, cast(o_orderdate as date) as filed_at, o_orderdate as filed_ts, o_orderpriority as filing_type, o_orderstatus as status,
               cast(floor(o_totalprice) as bigint) as word_count, c_mktsegment as segment
        from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
             join {region} on n_regionkey = r_regionkey""",
    # entity = part
    "entities": "select p_partkey as entity_id, concat(p_name, ' ', p_brand) as canonical_name, p_type as entity_type, p_brand as brand, p_size as size from {part}",
    # the m:n fan-out between filings and entities
    "mentions": "select distinct l_orderkey as doc_id, l_partkey as entity_id from {lineitem}",
    # signal = line; six types from the two flags
    "signals": """
        select l_orderkey as doc_id, l_partkey as entity_id,
               case concat(l_returnflag, l_linestatus) when 'AF' then 'demand_surge' when 'AO' then 'technology_adoption'
                    when 'NF' then 'supply_bottleneck' when 'NO' then 'inventory_drawdown' when 'RF' then 'capex_increase'
                    else 'regulatory_tailwind' end as signal_type,
               case when l_discount >= 0.05 then 'positive' else 'negative' end as direction,
               cast(round(l_discount * 1000) as bigint) as confidence_pm, cast(round(l_extendedprice * 100) as bigint) as cents,
               cast(l_shipdate as date) as signal_date, l_shipdate as signal_ts, l_suppkey as supplier_id
        from {lineitem}""",
    # theme = (segment, nation); a snapshot a month
    "snapshots": """
        select concat(lower(segment), '-', lower(sector)) as theme, cast(date_trunc('month', filed_at) as date) as snapshot_date,
               cast(sum(word_count) % 10000 as bigint) as strength_c, cast(sum(word_count * 7) % 10000 as bigint) as momentum_c,
               cast(count(*) as bigint) as doc_count, cast(count(distinct company) as bigint) as company_count
        from {filings} group by 1, 2""",
    "beneficiaries": """
        select theme, company, ticker, country, signal_count, relevance_c, first_seen, last_seen,
               cast(row_number() over (partition by theme order by relevance_c desc, company) as bigint) as rank_in_theme
        from (select concat(lower(segment), '-', lower(sector)) as theme, company, ticker, country, cast(count(*) as bigint) as signal_count,
                     cast(sum(word_count) % 10001 as bigint) as relevance_c, min(filed_at) as first_seen, max(filed_at) as last_seen
              from {filings} group by 1, 2, 3, 4) b""",
    # series = event type a day, in whole cents
    "series": """
        select event_type as series_id, cast(ts as date) as obs_date, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents,
               cast(count(*) as bigint) as n
        from {events} group by 1, 2""",
    # supplier nation -> customer nation
    "edges": """
        select s.n_name as src, c.n_name as dst, cast(count(*) as bigint) as weight
        from {lineitem} join {supplier} on l_suppkey = s_suppkey join {nation} s on s_nationkey = s.n_nationkey
             join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {nation} c on c_nationkey = c.n_nationkey
        group by 1, 2""",
}


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or binding as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return sql(spark, sf_dir, BINDINGS[name])


def window(df: DataFrame, low: str | None, high: str, ts: str = "filed_ts") -> DataFrame:
    """Rows of the days [low, high], tested on the stored timestamp so that the scan skips row groups."""
    keep = F.col(ts) < F.date_add(F.lit(high).cast("date"), 1).cast("timestamp_ntz")
    return df.filter(keep if low is None else keep & (F.col(ts) >= F.lit(low).cast("date").cast("timestamp_ntz")))


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL whose ``{name}`` are bindings."""
    return spark.sql(text, **{n: bind(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def oracle(text: str) -> str:
    """The same SQL for DuckDB: bindings become common table expressions."""
    chain: list[str] = []

    def need(t: str) -> None:
        for n in re.findall(r"\{(\w+)\}", t):
            if n in BINDINGS and n not in chain:
                need(BINDINGS[n])
                chain.append(n)

    need(text)
    plain = re.compile(r"\{(\w+)\}")
    ctes = ", ".join(f"{n} as ({plain.sub(r'\1', BINDINGS[n])})" for n in chain)
    body = plain.sub(r"\1", text)
    if not ctes:
        return body
    lead = re.match(r"\s*with\s+(recursive\s+)?", body, re.I)
    if lead:
        return f"with {lead[1] or ''}{ctes}, {body[lead.end() :]}"
    return f"with {ctes} {body}"
