"""Landed filing files: scan, filing-date extraction and the filing index."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FILING_DATE_MARKER, FILING_DATE_SCAN_LINES, FILING_TYPES, SAMPLE_TICKERS
from ..functions.text import py_strip

# Folder layout of landed filings: <root>/sec-edgar-filings/<ticker>/<type>/<submission>/<file>.
EDGAR_LAYOUT = r"sec-edgar-filings/([^/]+)/([^/]+)/([^/]+)/[^/]+$"
EDGAR_NAME_GLOB = "*full-submission*.txt"
#: bytes that are read of a file at once for its head
HEAD_BYTES = 8192


#: setting of the most tasks that list the folders of a level; Spark starts one per folder up to 10,000
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While files are listed, tasks take many folders each: with a folder per filing, starting a task costs more than its listing."""
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, before)


def filing_scan(spark: SparkSession, root: str, *, layout: str = EDGAR_LAYOUT,
                name_glob: str = EDGAR_NAME_GLOB) -> DataFrame:
    """One row per landed filing file: ticker, filing_type, submission, file_path, content.

    Files are read whole (``wholetext``) through the file source, so listing and
    reading are distributed; ticker and type come from the folder names.  A
    missing root gives an empty table.
    """
    schema = "ticker string, filing_type string, submission string, file_path string, content string"
    try:
        # Options as keywords: text()'s own defaults would override .option() calls.
        with listing_tasks(spark):
            raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name_glob)
    except Exception as e:  # noqa: BLE001 - missing folder -> empty, as the reference returns []
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise
    path = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_extract(path, layout, 1).alias("ticker"),
        F.regexp_extract(path, layout, 2).alias("filing_type"),
        F.regexp_extract(path, layout, 3).alias("submission"),
        path.alias("file_path"),
        F.col("value").alias("content"),
    ).where(F.col("ticker") != "")


def read_head(path: str, lines: int = FILING_DATE_SCAN_LINES, marker: str = FILING_DATE_MARKER, size: int = HEAD_BYTES) -> tuple[str, int]:
    """The first ``lines`` lines of a file, or those up to the first with the marker, and the bytes read for them."""
    system, name = pa.fs.FileSystem.from_uri(path)
    held, wanted = b"", marker.encode()
    with system.open_input_stream(name) as f:
        while data := f.read(size):
            held += data
            at = held.find(wanted)
            if held.count(b"\n") >= lines or (at >= 0 and held.find(b"\n", at) >= 0):
                break
    return "\n".join(held.decode("utf-8", "replace").split("\n")[:lines]), len(held)


def filing_heads(spark: SparkSession, root: str, *, layout: str = EDGAR_LAYOUT, name_glob: str = EDGAR_NAME_GLOB,
                 lines: int = FILING_DATE_SCAN_LINES) -> DataFrame:
    """As ``filing_scan``, with only the lines of a file that its filing date needs as ``content``.

    The file source lists the files; a task reads the beginning of each in pieces of HEAD_BYTES and stops
    where the date marker's line or the last line wanted ends.  A missing root gives an empty table.
    """
    schema = "ticker string, filing_type string, submission string, file_path string, content string"
    try:
        with listing_tasks(spark):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name_glob).load(root).select("path")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
    listed = files.select(*[F.regexp_extract("path", layout, i).alias(n) for i, n in enumerate(("ticker", "filing_type", "submission"), 1)],
                          F.col("path").alias("file_path")).where(F.col("ticker") != "")

    def run(batches):
        for b in batches:
            heads = [read_head(p, lines)[0] for p in b.column("file_path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.string())], names=[*b.schema.names, "content"])

    return listed.mapInArrow(run, schema)


def filing_date_text(content: Column, marker: str = FILING_DATE_MARKER,
                     lines: int = FILING_DATE_SCAN_LINES) -> Column:
    """First of the first ``lines`` lines holding the marker: text after it, stripped, first 8 characters."""
    head = F.slice(F.split(content, "\n", lines + 1), 1, lines)  # the split stops after that many lines
    hit = F.element_at(F.concat(F.filter(head, lambda l: F.contains(l, F.lit(marker))),
                                F.array(F.lit(None).cast("string"))), 1)
    after = F.element_at(F.split(hit, "\\Q" + marker + "\\E", -1), 2)
    return F.substring(py_strip(after), 1, 8)


def filing_date(content: Column) -> Column:
    """The filing date as DATE (``yyyyMMdd``); unparsable or missing -> NULL."""
    return F.try_to_timestamp(filing_date_text(content), F.lit("yyyyMMdd")).cast("date")


def filing_index(files: DataFrame, *, tickers: list[str] | None = None,
                 filing_types: list[str] | None = None) -> DataFrame:
    """ticker, filing_type, filing_date (DATE, nullable), file_path; ordered by ticker, date (NULL last)."""
    f = files.where(F.col("filing_type").isin(*(filing_types or FILING_TYPES)))
    if tickers:
        f = f.where(F.col("ticker").isin(*tickers))
    idx = f.select("ticker", "filing_type", filing_date(F.col("content")).alias("filing_date"), "file_path")
    return idx.orderBy(F.col("ticker"), F.col("filing_date").asc_nulls_last(), F.col("file_path"))


def ticker_normalize(c: Column) -> Column:
    """Class-share dots become dashes (``BRK.B`` -> ``BRK-B``)."""
    return F.translate(c, ".", "-")


def sample_tickers(spark: SparkSession) -> DataFrame:
    """The fixed sample ticker list as a small dimension table."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLE_TICKERS)], "ordinal int, ticker string")


def count_by_ticker_type(index: DataFrame) -> DataFrame:
    """Filings per ticker and type."""
    return index.groupBy("ticker", "filing_type").agg(F.count(F.lit(1)).alias("n_filings"))


def distinct_tickers(index: DataFrame) -> DataFrame:
    """Distinct tickers (order not promised)."""
    return index.select("ticker").distinct()
