"""Graphs as edge tables (src, rel, dst, weight): building, matching, paths, centrality, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.operators.settle import checkpointed

#: Relation of a company to a technology by stems in the text, first match wins.
RELATION_STEMS = (("DEVELOPS", r"develop|design|build|manufactur"), ("INVESTS_IN", r"invest|capex|fund|acquir"), ("USES", r"\buse|deploy|adopt|integrat"))
PAIR_WEIGHT = 0.3


def relation(context: Column) -> Column:
    """DEVELOPS, INVESTS_IN or USES by the stems of a context, else null."""
    out = F.lit(None).cast("string")
    for name, stems in reversed(RELATION_STEMS):
        out = F.when(context.rlike(f"(?iu){stems}"), name).otherwise(out)
    return out


def company_edges(mentions: DataFrame) -> DataFrame:
    """Edges from (doc_id, company, entity, entity_type, context) rows.

    A technology's relation follows its context; a concept is invested in.
    """
    rel = F.when(F.col("entity_type") == "CONCEPT", "INVESTS_IN").otherwise(relation(F.col("context")))
    return mentions.select(F.col("company").alias("src"), rel.alias("rel"), F.col("entity").alias("dst"), F.lit(1.0).alias("weight")).filter("rel is not null")


def technology_pairs(mentions: DataFrame) -> DataFrame:
    """ENABLES edges between technologies (a < b) of a document, 0.3 a document."""
    tech = mentions.filter("entity_type = 'TECHNOLOGY'").select("doc_id", "entity").distinct()
    a, b = tech.withColumnRenamed("entity", "src"), tech.withColumnRenamed("entity", "dst")
    pairs = a.join(b, "doc_id").filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs.select("src", F.lit("ENABLES").alias("rel"), "dst", (F.col("n") * PAIR_WEIGHT).alias("weight"))


def merge_edges(*edges: DataFrame) -> DataFrame:
    """Accumulate the weights of equal edges."""
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out.groupBy("src", "rel", "dst").agg(F.sum("weight").alias("weight"))


def paths(edges: DataFrame, roots: Column, depth: int, simple: bool = False) -> DataFrame:
    """Directed paths of 1 to ``depth`` edges from the roots: root, node, hops, path.

    Unrolled joins bounded by ``depth``; ``simple`` drops paths that meet a node twice.
    """
    e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    front = edges.filter(roots).select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("hops"), F.array("src", "dst").alias("path"))
    if simple:
        front = front.filter("root <> node")
    out = front
    for hop in range(2, depth + 1):
        front = front.join(e, F.col("node") == F.col("__s"))
        if simple:
            front = front.filter(~F.array_contains("path", F.col("__d")))
        front = front.select("root", F.col("__d").alias("node"), F.lit(hop).alias("hops"), F.concat("path", F.array("__d")).alias("path"))
        out = out.unionByName(front)
    return out


def reach(edges: DataFrame, root: str, depth: int = 20) -> DataFrame:
    """Breadth-first distances from a root: node, hops. Stops when nothing new is met."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(root, 0)], "node string, hops int")
    e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("node")).distinct()
    front = seen
    for hop in range(1, depth + 1):
        front = checkpointed(front.select(F.col("node").alias("__s")).join(e, "__s").select("node").distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
    return seen


def degree(edges: DataFrame, least: int = 3) -> DataFrame:
    """In-, out- and total degree of nodes with at least ``least`` edges: one pass over both ends."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    out = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree")).filter(F.col("degree") >= least)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (its least node) by min-label propagation with pointer jumping."""
    both = checkpointed(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct())
    label = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    changed = None
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        stepped = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", "m").alias("component"))
        up = stepped.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        label = checkpointed(stepped.join(up, F.col("component") == F.col("__n")).select("node", F.least("component", "__c").alias("component")))
        mark = label.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]
        if mark == changed:
            return label
        changed = mark
    raise RuntimeError("components did not settle")


def subgraph(edges: DataFrame, members: DataFrame, node: str = "node") -> DataFrame:
    """Edges both of whose ends are members."""
    m = members.select(F.col(node).alias("__m"))
    return edges.join(m, F.col("src") == F.col("__m"), "left_semi").join(m, F.col("dst") == F.col("__m"), "left_semi")


def bottleneck_scores(edges: DataFrame, listed: DataFrame) -> DataFrame:
    """In-degree times 25, and 50 for listed bottlenecks, at most 100."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("suppliers"))
    mark = listed.select(F.col("node").alias("__l"))
    out = into.join(mark, F.col("node") == F.col("__l"), "left")
    return out.select("node", "suppliers", F.least(F.col("suppliers") * 25.0 + F.when(F.col("__l").isNotNull(), 50.0).otherwise(0.0), F.lit(100.0)).alias("score"))


def valid_at(facts: DataFrame, day: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Facts whose valid time holds the day; an open end holds on."""
    return facts.filter((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) > day)))
