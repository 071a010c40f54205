"""Table sinks and sources: Parquet, CSV, the vector table and the metric report."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import REPORT_RULE_WIDTH, VECTOR_COLLECTION_NAME
from ..operators.documents import chunk_id_key
from ..operators.retrieval import date_text
from ..session import materialize


def parquet_sink(df: DataFrame, path: str, *, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    """Write a table as Parquet (overwrite by default), optionally partitioned (e.g. by ticker)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def parquet_source(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a table written by ``parquet_sink``; a declared schema keeps columns even when empty.

    A missing path raises ``FileNotFoundError`` with a message (the reference stops with one).
    """
    try:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for a missing path
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise FileNotFoundError(f"table not found at {path}; build it first") from e
        raise


def csv_sink(df: DataFrame, path: str, *, mode: str = "overwrite") -> str:
    """CSV with a header; quoting and escaping set so multi-line text round-trips."""
    (df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"')
     .option("lineSep", "\n").csv(path))
    return path


def csv_source(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
            .csv(path))


def vector_records(chunks: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Chunk rows -> vector records: id, embedding, document text and the 5-key metadata."""
    return chunks.select(
        chunk_id_key(F.col("ticker"), F.col("filing_type"), F.col("filing_date"), F.col("section"),
                     F.col("chunk_id")).alias("id"),
        F.col(embedding).alias("embedding"),
        F.col("text").alias("document"),
        F.col("ticker").cast("string").alias("ticker"),
        F.col("filing_type").cast("string").alias("filing_type"),
        date_text(F.col("filing_date")).alias("filing_date"),
        F.col("section").cast("string").alias("section"),
        F.col("chunk_id").cast("int").alias("chunk_id"),
    )


def _one_per_id(records: DataFrame) -> DataFrame:
    """The least record of every id (by all columns but the vector, then the vector), whatever the partitioning."""
    order = sorted(c for c in records.columns if c != "embedding") + ["embedding"] * ("embedding" in records.columns)
    least = records.groupBy("id").agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_r"))
    return least.select(*[F.col(f"_r.{c}").alias(c) for c in records.columns])


def vector_id_collisions(records: DataFrame) -> DataFrame:
    """``id, n_records`` of ids that more than one record claims; a write keeps the least record of each."""
    return records.groupBy("id").agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


#: buckets of a new vector table, and most ids that a write broadcasts (16 MB of 16-byte ids; beyond, they are shuffled)
BUCKETS, MAX_BROADCAST_IDS = 64, 1_000_000
_BUCKET = "bucket_of_"


def _held(spark: SparkSession, path: str) -> tuple[DataFrame | None, int | None, str | None]:
    """The table at ``path`` if there is one, its number of buckets and its bucket column."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, None, None
    column = next((c for c in table.columns if c.startswith(_BUCKET)), None)
    return table, int(column[len(_BUCKET):]) if column else None, column


def _ids_join(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on ``id``: the ids are broadcast if they are few, so that the rows stay where they are."""
    return rows.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "id", how)


def vector_table_rows(records: DataFrame, path: str | None, buckets: int = BUCKETS) -> DataFrame:
    """The rows that a write of ``records`` adds to the table at ``path`` (None: to an empty one), with their bucket.

    Ids are counted without their vectors; the ids that several records claim, and those that the table has in
    the buckets concerned, are few as a rule, and only records of the former are compared whole.
    """
    spark = records.sparkSession
    table, count, column = _held(spark, path) if path else (None, None, None)
    if table is not None and not column:
        raise ValueError(f"{path} holds a table without buckets: write it anew with reset")
    count = count or buckets
    name, bucket = f"{_BUCKET}{count}", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    ids = materialize(records.select("id").groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    claimed = ids.where("n > 1").select("id")
    plain = _ids_join(records, claimed, "left_anti")
    rows = plain.unionByName(_one_per_id(_ids_join(records, claimed, "left_semi")))
    if table is not None:
        touched = [r[0] for r in ids.select(bucket.alias("b")).distinct().collect()]  # at most one per bucket
        known = materialize(table.where(F.col(column).isin(touched)).select("id").join(ids, "id", "left_semi"))
        rows = _ids_join(rows, known, "left_anti")
    return rows.select(*records.columns, bucket.alias(name))


def vector_table_write(records: DataFrame, path: str, *, reset: bool = False, buckets: int = BUCKETS) -> str:
    """Write vector records: ``reset`` replaces the table, otherwise rows of new ids are appended.

    One record per id: the least one of a write (see ``vector_id_collisions`` for the others), and an id that
    the table has keeps its record.  Files lie in buckets of the ids' hash; an append adds files to the buckets of
    new ids, reads the ids of the same buckets, and touches no others.
    """
    rows = vector_table_rows(records, None if reset else path, buckets)
    name = rows.columns[-1]
    rows.repartitionByRange(name, F.xxhash64("id")).write.mode("overwrite" if reset else "append").partitionBy(name).parquet(path)
    return path


def vector_table_read(spark: SparkSession, path: str) -> DataFrame:
    """The vector table: a plain scan, as a write keeps ids unique."""
    table, _, column = _held(spark, path)
    if table is None:
        raise FileNotFoundError(f"table not found at {path}; build it first")
    return table.drop(column) if column else table


def vector_table_stats(records: DataFrame, name: str = VECTOR_COLLECTION_NAME) -> DataFrame:
    """One row: collection name and number of records."""
    return records.agg(F.count(F.lit(1)).alias("total_documents")).select(
        F.lit(name).alias("collection_name"), "total_documents")


def vector_table_drop(spark: SparkSession, name: str) -> bool:
    """``DROP TABLE IF EXISTS``; a table that Spark refuses to drop is reported (False), not raised."""
    try:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        return True
    except AnalysisException:  # a view of that name, a catalog that cannot drop it
        return False


def metric_report(results: DataFrame) -> DataFrame:
    """Report lines for a metric table (metric_name, score, baseline_score, improvement, details map).

    One row per line with ``line_no``; each metric contributes a title, its score,
    baseline and improvement when a baseline is set, and its details in key order.
    Output: (line_no, line); write with ``write.text`` after ordering by line_no.
    """
    fmt = lambda c: F.format_string("%.4f", c)
    # The ordering windows below run over the metric table and its report lines:
    # a handful of rows per metric, never over the data the metrics summarise.
    ordered = results.withColumn("_m", F.row_number().over(
        Window.orderBy("metric_order")))
    lines = ordered.select(
        "_m",
        F.flatten(F.array(
            F.array(F.concat(F.lit("\n"), F.col("metric_name"), F.lit(":")), F.concat(F.lit("  Score: "), fmt(F.col("score")))),
            F.when(F.col("baseline_score").isNotNull() & (F.col("baseline_score") != 0), F.array(
                F.concat(F.lit("  Baseline: "), fmt(F.col("baseline_score"))),
                F.concat(F.lit("  Improvement: "), fmt(F.col("improvement"))))).otherwise(F.array().cast("array<string>")),
            F.when(F.size(F.col("details")) > 0, F.concat(F.array(F.lit("  Details:")), F.transform(
                F.map_entries("details"),
                lambda e: F.concat(F.lit("    "), e["key"], F.lit(": "), fmt(e["value"])))))
            .otherwise(F.array().cast("array<string>")),
        )).alias("_lines"),
    )
    body = lines.select("_m", F.posexplode("_lines").alias("_i", "line"))
    head = results.sparkSession.createDataFrame(
        [(0, 0, "Evaluation Report"), (0, 1, "=" * REPORT_RULE_WIDTH)], "_m int, _i int, line string")
    allr = head.unionByName(body.select(F.col("_m").cast("int"), F.col("_i").cast("int"), "line"))
    return allr.select(F.row_number().over(
        Window.orderBy("_m", "_i")).alias("line_no"), "line")
