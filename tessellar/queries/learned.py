"""Queries that SQL cannot express: spans, clustering, topics, hashing, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.bindings import bind
from tessellar.operators import intelligence as I
from tessellar.operators import text as T
from tessellar.operators import vectors as V
from tessellar.queries import query
from tessellar.streaming import windows as S

#: A pattern table for the corpus of invented words.
CORPUS_PATTERNS = (("demand_surge", "positive", 0.9, r"\bthe\s+\w+tion\b"), ("supply_bottleneck", "negative", 0.8, r"\b\w*eau\s+\w+\b"), ("capex_increase", "positive", 0.7, r"\b\w+keit\b"))


@query()
def signal_extract(spark, d):
    return T.extract_signals(bind(spark, d, "documents"), CORPUS_PATTERNS)


@query()
def event_extract(spark, d):
    return T.extract_events(bind(spark, d, "documents"), CORPUS_PATTERNS)


@query()
def canonical_components(spark, d):
    p = bind(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.sum("p_size").alias("strength"), F.collect_set("p_brand").alias("companies"))
    themes = p.select(
        F.lower(F.replace("name", F.lit(" "), F.lit("-"))).alias("slug"), "name", F.lit("").alias("description"), F.col("strength").cast("double").alias("strength"),
        F.lit("1998-01-01").cast("date").alias("first_day"), F.lit("1998-12-31").cast("date").alias("last_day"), "companies",
    )
    return I.canonical_themes(themes, 0.45)


@query()
def lsh_neighbors(spark, d):
    return V.lsh_neighbours(bind(spark, d, "embeddings"), "vec_id", "embedding", k=10)


@query()
def kmeans_embeddings(spark, d):
    return V.kmeans(bind(spark, d, "embeddings"), "vec_id", "embedding", 10)


@query()
def topic_model(spark, d):
    return V.topics(bind(spark, d, "documents"), "doc_id", "text", 8)


@query()
def hashed_embeddings(spark, d):
    return V.embed(bind(spark, d, "documents"), "doc_id", "text")


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) as n from {events} group by 1, 2")
def stream_hourly_counts(spark, d):
    return S.hourly_counts(spark, d).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query("select event_type, count(*) as n from (select distinct user_id, event_type from {events}) x group by 1")
def stream_deduplicated(spark, d):
    return S.deduplicated(spark, d)
