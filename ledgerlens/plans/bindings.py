"""Bindings of the driver tables to the operators' inputs.

The driver's tables are generic (TPC-H-like tables, an event stream, invented
prose).  Each function below derives the input shape an operator expects from
them, with Spark expressions only, so the work grows with the tables.  The SQL
oracles beside each query derive the same inputs independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import WS_RUN
from ..session import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# FIXED VALUES of the fixture bindings (chosen for the driver tables, see FIXTURES.md).
FIXTURE_POSITIVE = ["ering", "ention", "inan", "esin", "whth", "onre", "erth"]
FIXTURE_NEGATIVE = ["nthe", "shst", "heha", "atin", "ndle", "edat", "ouer"]
QUESTION_WORDS = ["guidance", "risk", "revenue", "tone", "stock", "outlook", "weather", "challenge"]
SECTION_NAMES = ["MD&A", "RISK_FACTORS", "BUSINESS", "FINANCIAL_STATEMENTS"]
FILING_HEADINGS = ["ITEM 1.", "ITEM 1A.", "ITEM 7.", "ITEM 8."]
FILING_BLOCK_IDS = 400          # doc_id block that forms one synthetic filing per source
EVENT_FILING_TYPE = "signup"    # events of this type are the filings; the rest are prices
EVENT_BUCKET_SECONDS = 86400    # as-of bucket width for the events binding
TIME_SYSTEM = "click"           # method bound to the system under test
TIME_BASELINE = "view"          # method bound to the baseline
YEAR_FILTER = 2020


# Tables whose rows carry long texts: their row-local work is spread over the cores.
TEXT_TABLES = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


# ----------------------------------------------------------------- event study
def event_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.where(F.col("event_type") == EVENT_FILING_TYPE).select(
        F.col("user_id").alias("ticker"),
        F.col("ts").alias("filing_date"),
        F.col("event_type").alias("filing_type"),
    )


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.where(F.col("event_type") != EVENT_FILING_TYPE).select(
        F.col("user_id").alias("ticker"),
        F.col("ts"),
        F.col("event_id"),
        F.col("value").alias("close"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


# ----------------------------------------------------------------- documents
def document_chunks_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as section rows: ticker = source, section = lang, one filing per document."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("ticker"),
        F.lit("10-K").alias("filing_type"),
        F.date_add(F.lit("2019-01-01").cast("date"), F.col("doc_id").cast("int")).alias("filing_date"),
        F.col("lang").alias("section"),
        F.col("doc_id"),
        F.col("text"),
    )


def synthetic_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic filing per (source, block of FILING_BLOCK_IDS doc ids).

    Documents in doc_id order, each preceded by a heading chosen by doc_id % 4.
    Even source numbers file a 10-K, odd ones a 10-Q.  A filing holds a bounded
    number of documents, so the per-filing collect stays bounded at any scale.
    """
    d = table(spark, sf_dir, "documents")
    heading = F.element_at(F.array(*[F.lit(h) for h in FILING_HEADINGS]), (F.col("doc_id") % 4 + 1).cast("int"))
    src_no = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    parts = d.select(
        F.col("source").alias("ticker"),
        (F.col("doc_id") / FILING_BLOCK_IDS).cast("long").alias("block"),
        F.when(src_no % 2 == 0, F.lit("10-K")).otherwise(F.lit("10-Q")).alias("filing_type"),
        F.col("doc_id"),
        F.concat_ws(" ", heading, F.col("text")).alias("piece"),
    )
    # dealt by number: tasks of few large partitions would leave cores idle over whole texts
    dealt = parts.repartition(8 * spark.sparkContext.defaultParallelism, "ticker", "block", "filing_type")
    filings = dealt.groupBy("ticker", "block", "filing_type").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "piece"))), lambda x: x["piece"]), " "
        ).alias("raw_text")
    )
    return filings.select(
        "ticker",
        "filing_type",
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("block") * 91).cast("int")).alias("filing_date"),
        F.concat(F.lit("filings/"), F.col("ticker"), F.lit("/"), F.col("filing_type"), F.lit("/"),
                 F.col("block").cast("string")).alias("file_path"),
        F.trim(F.regexp_replace("raw_text", WS_RUN, " ")).alias("text"),
    )


# ----------------------------------------------------------------- vectors
def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunk vectors with filing metadata derived from vec_id and label."""
    e = table(spark, sf_dir, "embeddings")
    section = F.element_at(F.array(*[F.lit(s) for s in SECTION_NAMES]), (F.col("label") % 4 + 1).cast("int"))
    return e.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("T"), (F.col("vec_id") % 5).cast("string")).alias("ticker"),
        F.when(F.col("vec_id") % 2 == 0, F.lit("10-K")).otherwise(F.lit("10-Q")).alias("filing_type"),
        F.date_add(F.lit("2019-01-01").cast("date"), (F.col("vec_id") * 5).cast("int")).alias("filing_date"),
        section.alias("section"),
        (F.col("vec_id") % 7).cast("int").alias("chunk_id"),
        F.concat(F.lit("chunk text "), F.col("vec_id").cast("string")).alias("text"),
        F.col("embedding"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of vector searches: every embedding whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question vector per label: the centroid (element-wise mean) of the label's embeddings.

    Derived from the whole table; the element-wise mean is a grouped average per
    (label, position), and each label's array is reassembled from at most ``dim``
    values.
    """
    e = table(spark, sf_dir, "embeddings")
    comps = e.select("label", F.posexplode("embedding").alias("pos", "x")) \
        .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("v"))
    vecs = comps.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_c"))
    return vecs.select(F.col("label").cast("long").alias("query_id"),
                       F.transform("_c", lambda c: c["v"]).alias("embedding"))


def part_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from part: a topic word chosen by p_partkey % 8 and the part name."""
    p = table(spark, sf_dir, "part")
    word = F.element_at(F.array(*[F.lit(w) for w in QUESTION_WORDS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("query_id"),
        F.concat(F.lit("What is the "), word, F.lit(" for "), F.col("p_name"), F.lit("?")).alias("question"),
        F.concat(F.lit("T"), (F.col("p_partkey") % 5).cast("string")).alias("ticker"),
        (F.col("p_partkey") % 1500).alias("company_key"),
    )


def customer_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer rows as fundamentals: P/E = c_acctbal, sector = c_mktsegment, keyed by c_custkey."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("company_key"), F.col("c_acctbal").alias("pe_ratio"),
                    F.col("c_mktsegment").alias("sector"))


# ----------------------------------------------------------------- conversations
def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn as reference, the next assistant turn of the conversation as prediction."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction")
    )
    return u.join(a, ["conv_id", "turn"], "inner")
