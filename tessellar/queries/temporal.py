"""As-of joins, windows, momentum, trends and replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellar.bindings import bind, window
from tessellar.functions.scalars import q, quarter_index
from tessellar.operators import intelligence as I
from tessellar.operators import relational as R
from tessellar.operators import windows as W
from tessellar.queries import AS_OF, as_of_day, query


@query(f"""select theme, snapshot_date, strength_c, momentum_c from (select *, row_number() over (partition by theme order by snapshot_date desc) r from {{snapshots}}
           where snapshot_date <= date '{AS_OF}') x where r = 1 and strength_c >= 1000""")
def theme_asof_latest(spark, d):
    return R.as_of(bind(spark, d, "snapshots"), ["theme"], "snapshot_date", as_of_day()).filter("strength_c >= 1000").select("theme", "snapshot_date", "strength_c", "momentum_c")


@query("select theme, snapshot_date, strength_c from {snapshots} where snapshot_date between date '1997-01-01' and date '1997-12-31'")
def snapshots_in_window(spark, d):
    return bind(spark, d, "snapshots").filter("snapshot_date between date '1997-01-01' and date '1997-12-31'").select("theme", "snapshot_date", "strength_c")


@query("""select series_id, max(obs_date) as obs_date, arg_max(cents, obs_date) as cents from {series} where obs_date <= date '2024-01-20' group by 1""")
def series_latest_asof(spark, d):
    rows = R.as_of(bind(spark, d, "series"), ["series_id"], "obs_date", F.lit("2024-01-20").cast("date"))
    return rows.select("series_id", "obs_date", "cents")


_VINTAGE = """select event_type as series_id, cast(ts as date) as obs_date, nullif(user_id % 7, 0) as vintage, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from {events} group by 1, 2, 3"""


@query(f"select series_id, obs_date, vintage, cents from (select *, row_number() over (partition by series_id, obs_date order by vintage desc nulls first) r from ({_VINTAGE}) v) x where r = 1")
def series_vintage_asof(spark, d):
    from tessellar.bindings import sql

    return R.as_of_vintage(sql(spark, d, _VINTAGE), ["series_id"], "obs_date", "vintage")


@query("""select a.series_id, a.obs_date, a.cents as now_cents, arg_min(b.cents, b.obs_date) as next_cents from {series} a
          left join {series} b on b.series_id = a.series_id and b.obs_date between a.obs_date + 7 and a.obs_date + 11 group by 1, 2, 3""")
def forward_return_asof(spark, d):
    s = bind(spark, d, "series")
    base = s.select("series_id", "obs_date", F.col("cents").alias("now_cents"))
    return R.forward_as_of(base, s.withColumnRenamed("cents", "next_cents"), "series_id", "obs_date", "obs_date", "next_cents", 7).select("series_id", "obs_date", "now_cents", "next_cents")


@query("""select series_id, obs_date, cents, lag(cents) over w as previous, floor((cents - lag(cents) over w) * 100.0 / nullif(abs(lag(cents) over w), 0) * 1e4 + 0.5) / 1e4 as pct_change
          from {series} window w as (partition by series_id order by obs_date)""")
def macro_lag_pct(spark, d):
    rows = W.lag_change(bind(spark, d, "series").withColumn("x", F.col("cents").cast("double")), ["series_id"], "obs_date", "x")
    return rows.select("series_id", "obs_date", "cents", F.col("previous").cast("bigint").alias("previous"), q(F.col("pct_change")).alias("pct_change"))


_VELOCITY = """select series_id, obs_date, n, case when p is null then 0.0 else cast(n - p as double) / case when p = 0 then 1 else p end end as velocity
               from (select series_id, obs_date, n, lag(n) over (partition by series_id order by obs_date) as p from {series}) x"""


@query(f"""select series_id, obs_date, floor(velocity * 1e6 + 0.5) / 1e6 as velocity, floor(coalesce(velocity - lag(velocity) over (partition by series_id order by obs_date), 0.0) * 1e6 + 0.5) / 1e6 as acceleration from ({_VELOCITY}) y""")
def topic_velocity_acceleration(spark, d):
    rows = W.velocity(bind(spark, d, "series"), ["series_id"], "obs_date", "n")
    return rows.select("series_id", "obs_date", q(F.col("velocity"), 6).alias("velocity"), q(F.col("acceleration"), 6).alias("acceleration"))


@query("select series_id, obs_date, cast(sum(n) over (partition by series_id order by obs_date rows between 1 preceding and current row) as double) / 2 as moving_average from {series}")
def moving_average_2(spark, d):
    return W.moving_average(bind(spark, d, "series"), ["series_id"], "obs_date", "n").select("series_id", "obs_date", "moving_average")


@query("""select theme, cast(count(*) as bigint) as n, floor((avg(case when r > h then strength_c end) - avg(case when r <= h then strength_c end)) * 1e4 + 0.5) / 1e4 as slope
          from (select theme, strength_c, row_number() over (partition by theme order by snapshot_date) as r, floor(count(*) over (partition by theme) / 2) as h
                from {snapshots} where snapshot_date > date '1998-03-31' and snapshot_date <= date '1998-12-31') x group by 1""")
def half_window_slope(spark, d):
    rows = bind(spark, d, "snapshots").filter("snapshot_date > date '1998-03-31' and snapshot_date <= date '1998-12-31'")
    return W.half_window_slope(rows, ["theme"], "snapshot_date", "strength_c").select("theme", "n", q(F.col("slope")).alias("slope"))


_CQ = "select distinct company, cast(year(filed_at) * 4 + quarter(filed_at) - 1 as bigint) as qi from {filings}"


@query(f"""select company, qi, least(row_number() over (partition by company, g order by qi), 12) as streak
           from (select company, qi, qi - row_number() over (partition by company order by qi) as g from ({_CQ}) x) y""")
def quarter_streak(spark, d):
    rows = bind(spark, d, "filings").select("company", quarter_index(F.col("filed_at")).alias("qi")).distinct()
    return W.streaks(rows, ["company"], "qi")


_SQ = "select sector, cast(year(filed_at) * 4 + quarter(filed_at) - 1 as bigint) as qi, cast(count(*) as bigint) as mentions, cast(count(distinct company) as bigint) as companies from {filings} where segment = 'MACHINERY' group by 1, 2"


@query(f"select a.sector, a.qi, a.mentions, b.mentions as previous from ({_SQ}) a left join ({_SQ}) b on b.sector = a.sector and b.qi = a.qi - 1")
def previous_calendar_quarter(spark, d):
    rows = _sector_quarters(spark, d)
    return W.previous_period(rows, ["sector"], "qi", "mentions").select("sector", "qi", "mentions", "previous")


def _sector_quarters(spark, d):
    rows = bind(spark, d, "filings").filter("segment = 'MACHINERY'")
    return rows.groupBy("sector", quarter_index(F.col("filed_at")).alias("qi")).agg(F.count("*").alias("mentions"), F.countDistinct("company").alias("companies"))


@query(f"""select sector, qi, floor((0.25 * least(ln(1.0 + mentions) / ln(101.0), 1.0) + 0.20 * (0.5 + 0.5 * tanh(1.5 * g)) + 0.15 * least(ln(1.0 + companies) / ln(21.0), 1.0) + 0.20 * 0.5
           + 0.10 * least(ln(1.0 + 2) / ln(11.0), 1.0) + 0.10 * least(sqrt(cast(streak as double)) / 4.0, 1.0)) * case when g < -0.30 then greatest(0.60, 1.0 + g * 0.5) else 1.0 end * 1e4 + 0.5) / 1e4 as composite
           from (select y.sector, y.qi, mentions, companies, coalesce(cast(mentions - pm as double) / pm, 0.0) as g, least(row_number() over (partition by y.sector, grp order by y.qi), 12) as streak
                 from (select a.*, b.mentions as pm, a.qi - row_number() over (partition by a.sector order by a.qi) as grp from ({_SQ}) a left join ({_SQ}) b on b.sector = a.sector and b.qi = a.qi - 1) y) z""")
def quarterly_composite(spark, d):
    rows = W.streaks(W.previous_period(_sector_quarters(spark, d), ["sector"], "qi", "mentions"), ["sector"], "qi")
    g = F.coalesce((F.col("mentions") - F.col("previous")).cast("double") / F.col("previous"), F.lit(0.0))
    score = I.quarterly_composite(F.col("mentions"), F.col("g"), F.col("companies"), F.lit(0.5), F.lit(2), F.col("streak"))
    return rows.withColumn("g", g).select("sector", "qi", q(score).alias("composite"))


@query("""select n.theme, n.rank, p.rank as previous_rank, case when p.rank is null then 'NEW' when p.rank > n.rank then '↑' || (p.rank - n.rank) when p.rank < n.rank then '↓' || (n.rank - p.rank) else '→' end as move
          from (select theme, row_number() over (order by strength_c desc, theme) as rank from {snapshots} where snapshot_date = date '1998-06-01') n
          left join (select theme, row_number() over (order by strength_c desc, theme) as rank from {snapshots} where snapshot_date = date '1998-05-01') p on p.theme = n.theme""")
def rank_change(spark, d):
    s = bind(spark, d, "snapshots")
    return W.rank_change(s.filter("snapshot_date = date '1998-06-01'"), s.filter("snapshot_date = date '1998-05-01'"), "theme", "strength_c").select("theme", "rank", "previous_rank", "move")


_MOMENTUM = f"""select {{key}}, recent, prior, floor(case when prior = 0 then least(recent * 10.0, 100.0) else greatest(0.0, least((cast(recent as double) / greatest(prior, 1) - 1.0) * 50.0 + 50.0, 100.0)) end * 1e4 + 0.5) / 1e4 as momentum
    from (select {{key}}, cast(count(*) filter (where date '{AS_OF}' - signal_date between 0 and 30) as bigint) as recent,
                 cast(count(*) filter (where date '{AS_OF}' - signal_date between 31 and 90) as bigint) as prior from {{src}} group by 1) x"""


def _momentum_sql(key, src):
    return _MOMENTUM.replace("{key}", key).replace("{src}", src)


@query(_momentum_sql("entity_id", "{signals}"))
def entity_momentum_30_90(spark, d):
    rows = W.momentum(bind(spark, d, "signals"), ["entity_id"], "signal_date", as_of_day())
    return rows.select("entity_id", "recent", "prior", q(F.col("momentum")).alias("momentum"))


@query(f"""select entity_id, momentum, case when momentum >= 65 then 'accelerating' when momentum >= 45 then 'stable' when momentum >= 20 then 'decelerating' else 'declining' end as direction
           from ({_momentum_sql("entity_id", "(select s.* from {signals} s join {entities} e on e.entity_id = s.entity_id where e.entity_type = 'ECONOMY')")}) y order by momentum desc, entity_id limit 20""")
def accelerating_entities(spark, d):
    e = bind(spark, d, "entities").filter("entity_type = 'ECONOMY'").select("entity_id")
    rows = W.momentum(bind(spark, d, "signals").join(e, "entity_id"), ["entity_id"], "signal_date", as_of_day()).withColumn("momentum", q(F.col("momentum")))
    return rows.orderBy(F.desc("momentum"), "entity_id").limit(20).select("entity_id", "momentum", "direction")


@query(f"""select theme, floor(avg(momentum) * 100 + 0.5) / 100 as mean_momentum, max(momentum) as max_momentum from (select b.theme, m.momentum from {{beneficiaries}} b join (
           {_momentum_sql("company", "(select f.company, s.signal_date from {signals} s join {filings} f on f.doc_id = s.doc_id)")}) m on m.company = b.company) z group by 1""")
def theme_avg_momentum(spark, d):
    rows = bind(spark, d, "signals").join(bind(spark, d, "filings").select("doc_id", "company"), "doc_id")
    m = W.momentum(rows, ["company"], "signal_date", as_of_day()).select("company", q(F.col("momentum")).alias("momentum"))
    return bind(spark, d, "beneficiaries").select("theme", "company").join(m, "company").groupBy("theme").agg(q(F.avg("momentum"), 2).alias("mean_momentum"), F.max("momentum").alias("max_momentum"))


_TREND = f"""select series_id, obs_date, n, velocity, coalesce(velocity - lag(velocity) over (partition by series_id order by obs_date), 0.0) as acceleration from ({_VELOCITY}) y"""


@query(f"""select series_id, k as kind, floor(least(least(n * 5.0, 40.0) + greatest(0.0, least(velocity * 100.0, 30.0)) + greatest(0.0, least(acceleration * 100.0, 20.0))
           + case k when 'EMERGING' then 10.0 when 'SURGING' then 8.0 when 'STABLE' then 4.0 when 'PEAKING' then 2.0 else 0.0 end, 100.0) * 1e4 + 0.5) / 1e4 as score
           from (select *, case when velocity >= 0.15 and acceleration >= 0.10 then 'EMERGING' when velocity >= 0.15 and acceleration >= 0 then 'SURGING' when velocity >= 0 and acceleration < 0 then 'PEAKING'
                 when velocity < 0 and acceleration < 0 then 'DECLINING' when velocity < -0.15 then 'DORMANT' else 'STABLE' end as k, row_number() over (partition by series_id order by obs_date desc) as r from ({_TREND}) t) z where r = 1""")
def topic_trend(spark, d):
    rows = W.velocity(bind(spark, d, "series"), ["series_id"], "obs_date", "n")
    last = R.latest(rows, ["series_id"], F.desc("obs_date")).withColumn("kind", I.trend_class(F.col("velocity"), F.col("acceleration")))
    return last.select("series_id", "kind", q(I.trend_score(F.col("n"), F.col("velocity"), F.col("acceleration"), F.col("kind"))).alias("score"))


@query("""select series_id, obs_date, case when coalesce(p, 0) = 0 then n >= 3 else cast(n - p as double) / p >= 0.5 end as is_emerging
          from (select series_id, obs_date, n, lag(n) over (partition by series_id order by obs_date) as p from {series}) x""")
def emerging_topics(spark, d):
    last = F.lag("n").over(Window.partitionBy("series_id").orderBy("obs_date"))
    return bind(spark, d, "series").withColumn("p", last).select("series_id", "obs_date", I.emerging(F.col("n"), F.col("p").cast("double")).alias("is_emerging"))


@query("""select event_type, least(cast(floor((epoch(ts) - lo) / nullif(hi - lo, 0) * 10) as bigint), 9) as bin, cast(count(*) as bigint) as n
          from (select event_type, date_trunc('second', ts) as ts from {events}) e, (select epoch(date_trunc('second', min(ts))) as lo, epoch(date_trunc('second', max(ts))) as hi from {events}) x group by 1, 2""")
def topics_over_time(spark, d):
    e = bind(spark, d, "events").select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    ends = F.broadcast(e.agg(F.min("s").alias("lo"), F.max("s").alias("hi")))  # one row
    at = F.floor((F.col("s") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) * 10)
    return e.crossJoin(ends).groupBy("event_type", F.least(at, F.lit(9)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query("""select cast(m as date) as as_of, f.sector, cast(count(*) as bigint) as docs, cast(count(distinct f.company) as bigint) as companies
          from generate_series(timestamp '1997-01-31', timestamp '1997-12-31', interval 1 month) t(m) join {filings} f
            on f.filed_at <= cast(last_day(m) as date) and f.filed_at > cast(last_day(m) as date) - 180 group by 1, 2""".replace("cast(m as date)", "cast(last_day(m) as date)"))
def monthly_replay(spark, d):
    """All as-of dates in one job. A filing belongs to at most seven of them, so dates are exploded from it: an equi-aggregation, no range join."""
    f = window(bind(spark, d, "filings"), "1996-07-02", "1997-12-31")
    months = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.last_day(F.add_months(F.trunc("filed_at", "month"), k)))
    rows = f.withColumn("as_of", F.explode(months)).filter("as_of between date '1997-01-31' and date '1997-12-31' and filed_at > date_sub(as_of, 180) and filed_at <= as_of")
    return rows.groupBy("as_of", "sector").agg(F.count("*").alias("docs"), F.countDistinct("company").alias("companies"))


@query("""select cast(year(filed_at) as bigint) as yr, sector, cast(count(*) as bigint) as docs, max(filed_at) as last_filed from {filings} where filed_at <= date '1999-06-30' group by 1, 2""")
def yearly_replay(spark, d):
    rows = window(bind(spark, d, "filings"), None, "1999-06-30")
    return rows.groupBy(F.year("filed_at").cast("bigint").alias("yr"), "sector").agg(F.count("*").alias("docs"), F.max("filed_at").alias("last_filed"))


@query("""select conv_id, turn, role, p_role from (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as p_role from {conversations}) x where p_role is not null and p_role < role""")
def consecutive_pairs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return bind(spark, d, "conversations").withColumn("p_role", F.lag("role").over(w)).filter("p_role < role").select("conv_id", "turn", "role", "p_role")


@query("""select company, string_agg(filing_type, ',' order by filed_at, doc_id) as history from (select *, row_number() over (partition by company order by filed_at desc, doc_id desc) r from {filings}) x where r <= 8 group by 1""")
def last_stage_history(spark, d):
    rows = bind(spark, d, "filings").groupBy("company").agg(F.array_sort(F.collect_list(F.struct("filed_at", "doc_id", "filing_type"))).alias("h"))
    kept = W.last_items(F.slice("h", 1, 0), F.col("h"), 8)
    return rows.select("company", F.array_join(F.transform(kept, lambda x: x["filing_type"]), ",").alias("history"))


@query("""select user_id, cast(count(*) as bigint) as sessions, cast(max(n) as bigint) as longest from (select user_id, s, count(*) as n from (select user_id, sum(case when p is null or t - p > 1800 then 1 else 0 end) over (partition by user_id order by t, event_id) as s
          from (select user_id, event_id, floor(epoch(ts)) as t, lag(floor(epoch(ts))) over (partition by user_id order by floor(epoch(ts)), event_id) as p from {events}) x) y group by 1, 2) z group by 1""")
def sessions(spark, d):
    e = bind(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    gap = F.col("t") - F.lag("t").over(w)
    marked = e.withColumn("new", F.when(gap.isNull() | (gap > 1800), 1).otherwise(0)).withColumn("s", F.sum("new").over(w))
    return marked.groupBy("user_id", "s").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
