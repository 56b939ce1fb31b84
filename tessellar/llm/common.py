"""Small shared pieces: reading tables, settling intermediates, shipping code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(4)
def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as an archive that the driver serves."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.join(root, __name__.partition(".")[0])
    folder = tempfile.mkdtemp(prefix="tessellar-ship-")  # read by the driver alone
    path = os.path.join(folder, "tessellar_workers.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for at, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                archive.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), root))
    spark.sparkContext.addPyFile(path)


#: Rows of an Arrow batch where the session keeps Spark's default: whole texts make batches large.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of Arrow batches from the default, so that few texts are in flight at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The session's folder under ``spark.checkpoint.dir``; one is made only in local mode, where none is named, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessellar-ck-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small or narrow table with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame) -> DataFrame:
    """Cut the lineage of a wide table: written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of fewer partitions than cores (one small file) as many; all else stays as it is."""
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df  # it shuffles anyway, and counting its partitions would run it
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that few texts exist as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def unused(columns: list[str], name: str) -> str:
    """A column name that ``columns`` do not hold, whatever their case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Pick the operator's inputs under its own names, so clashing extras do not matter."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])
