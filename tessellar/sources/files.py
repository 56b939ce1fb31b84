"""Sources: local or remote files, static dimensions, and an incremental file connector.

Network connectors are adapters outside this engine: anything that lists documents with an
address and a date can be wrapped as a :class:`Connector`; only the file connector ships.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessellar.operators.text import html_text

DOCUMENT = "source_name string, doc_type string, url string, title string, company string, ticker string, filed_at date, country string, text string"


def directory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modified, length and content of the files of a folder that match a pattern."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row a text file: path and text."""
    return spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def pages(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """One row a page: path, html and its text."""
    rows = texts(spark, path, pattern).withColumnRenamed("text", "html")
    return rows.withColumn("text", html_text(F.col("html")))


def pdf_pages(spark: SparkSession, path: str, most_pages: int | None = 500) -> DataFrame:
    """path and text of PDF files, of the first ``most_pages`` pages (None: all); needs a PDF library on the executors (an optional adapter).

    A missing library, an unreadable file or a missing path part gives null text, never an error.
    """

    def run(batches):
        import io

        try:
            import pdfplumber
        except ImportError:
            pdfplumber = None
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                text = None
                if pdfplumber is not None:
                    try:
                        with pdfplumber.open(io.BytesIO(content)) as f:
                            text = "\n\n".join(p.extract_text() or "" for p in f.pages[:most_pages])
                    except Exception:
                        text = None
                out.append(text)
            yield pdf[["path"]].assign(text=out)

    return directory(spark, path, "*.pdf").select("path", "content").mapInPandas(run, "path string, text string")


def with_fallback(df: DataFrame, text: str = "text", title: str = "title") -> DataFrame:
    """Text, or the title where there is none."""
    return df.withColumn(text, F.coalesce(F.when(F.trim(text) != "", F.col(text)), F.col(title)))


class Connector(DataSource):
    """Batch data source ``tessellar_documents``: JSON-lines files of documents, one partition a file.

    Options: ``path`` (a file or folder), ``since`` and ``until`` (dates, inclusive).
    """

    @classmethod
    def name(cls) -> str:
        return "tessellar_documents"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        path = self.options["path"]
        found = sorted(glob.glob(os.path.join(path, "*.jsonl"))) if os.path.isdir(path) else [path]
        return [InputPartition(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime

        names = [c.split()[0] for c in DOCUMENT.split(", ")]
        since, until = self.options.get("since", ""), self.options.get("until", "9999")
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                row = json.loads(line)
                day = str(row.get("filed_at") or "")
                if since <= day <= until or (not day and not since):
                    row["filed_at"] = datetime.date.fromisoformat(day) if day else None
                    yield tuple(row.get(n) for n in names)


def register(spark: SparkSession) -> None:
    """Make the connector known to ``spark.read.format``."""
    spark.dataSource.register(Connector)


def month_chunks(spark: SparkSession, first: str, last: str) -> DataFrame:
    """start and end of each calendar month that meets [first, last], clipped to it."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(a, "month"), b, F.expr("interval 1 month"))).alias("m"))
    return months.select(F.greatest("m", a).alias("start"), F.least(F.last_day("m"), b).alias("end"))


# Keyword rules of policy impact: sector, direction, pattern.
POLICY_RULES = (
    ("energy", "positive", r"clean energy|renewable|solar|wind power"), ("semiconductor", "positive", r"chips? act|semiconductor"), ("defense", "positive", r"defen[cs]e authori[sz]ation|military procurement"),
    ("trade", "negative", r"tariff|export control|sanction"), ("health", "positive", r"medicare|drug approval"),
)


def policy_impact(df: DataFrame, text: str = "title") -> DataFrame:
    """Add sectors (array) and direction by keyword; neutral without any."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(f"(?iu){p}"), F.struct(F.lit(s).alias("sector"), F.lit(d).alias("direction"))) for s, d, p in POLICY_RULES]))
    rows = df.withColumn("__h", hits)
    return rows.withColumn("sectors", F.transform("__h", lambda h: h["sector"])).withColumn("direction", F.coalesce(F.try_element_at("__h", F.lit(1))["direction"], F.lit("neutral"))).drop("__h")


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A static dimension table from values in code."""
    return spark.createDataFrame(rows, schema)
