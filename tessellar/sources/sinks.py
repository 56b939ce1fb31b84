"""Sinks: exports, audit log and upserts into Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.operators.upsert import upsert_table


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write as JSON lines, CSV with a header, or Parquet; arrays and maps become JSON text in CSV."""
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)
    elif kind in ("json", "parquet"):
        getattr(df.write.mode("overwrite"), kind)(path)
    else:
        raise ValueError(f"no such export: {kind}")


def cypher(edges: DataFrame) -> DataFrame:
    """One MERGE statement a row of (src, rel, dst, weight), names escaped."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    text = F.concat(
        F.lit("MERGE (a {name: "), quote("src"), F.lit("}) MERGE (b {name: "), quote("dst"), F.lit("}) MERGE (a)-[r:"), F.regexp_replace("rel", "[^A-Z_]", "_"),
        F.lit("]->(b) SET r.weight = coalesce(r.weight, 0) + "), F.col("weight").cast("string"), F.lit(";"),
    )
    return edges.select(text.alias("statement"))


def append_log(spark: SparkSession, path: str, run_id: str, stage: str, status: str, counts: dict[str, int]) -> None:
    """Append one audit row."""
    row = spark.createDataFrame([(run_id, stage, status, {k: int(v) for k, v in counts.items()})], "run_id string, stage string, status string, counts map<string,bigint>")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def merge_into(spark: SparkSession, name: str, path: str, updates: DataFrame) -> None:
    """Upsert into a versioned Parquet table: a new version is written beside the old one, then named current.

    Readers keep the version they planned with; a lost executor only repeats its tasks.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v")) if fs.exists(folder) else []
    done = [v for v in versions if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}/_SUCCESS"))]
    if done:
        old = spark.read.parquet(f"{path}/v{done[-1]}")
        out = upsert_table(name, old, updates.select(*old.columns))
    else:
        out = upsert_table(name, updates.limit(0), updates)
    out.write.parquet(f"{path}/v{(versions[-1] if versions else 0) + 1}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest complete version of a table written by :func:`merge_into`."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/v{max(done)}")
