"""Compositions of the operators: question answering, multi-analyst queries, evaluation, index build.

All of them take tables (of questions, filings, pairs) and return tables; a
model is only called through the hooks in ``operators.hooks``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ANALYST_TOP_K, ENGINE_OVERFETCH, ENGINE_TOP_K
from ..operators import evaluation as ev
from ..operators import hooks, prompts as pr, retrieval as rt, stats
from ..functions.lexicon import sentiment_score
from ..session import materialize


def rag_prompts(questions: DataFrame, corpus: DataFrame, *, top_k: int = ENGINE_TOP_K, year: int | None = None,
                overfetch: int = ENGINE_OVERFETCH, generate_fn: Callable[[str], str] | None = None,
                route: bool = True) -> DataFrame:
    """Questions (query_id, embedding, question, ticker?, section?, year?) -> query_type, context, sources, prompt [, answer].

    Route (risk / financial set the section; ``route=False`` keeps the given
    section, as the analysts do), retrieve with the per-question
    ticker and section as filters (NULL: no filter) and its own ``year``, if the
    questions have that column (else ``year`` for all), build the numbered context
    and fill the template.  ``sources`` holds the hits in rank order (id, text, their
    metadata and distance).  Questions without hits get an empty context and no sources.
    """
    qs = questions if "section" in questions.columns else questions.withColumn("section", F.lit(None).cast("string"))
    if "ticker" not in qs.columns:
        qs = qs.withColumn("ticker", F.lit(None).cast("string"))
    if route:
        routed = pr.route_queries(qs, section="section")
    else:
        routed = qs.withColumn("query_type", F.lit(None).cast("string"))
    keep = ["ticker", "filing_type", "filing_date", "section", "text"]
    own_year = "year" if "year" in routed.columns else None
    asked = routed.select("query_id", "embedding", "ticker", "section", *([own_year] if own_year else []))
    # at most top_k rows a question, read by the context and by the sources: written once
    hits = materialize(rt.vector_topk_overfetch_year(asked, corpus, top_k, year=None if own_year else year, year_col=own_year,
                                                     overfetch=overfetch, match_cols=["ticker", "section"], keep_cols=keep))
    source = F.struct("rank", "id", *keep, "distance")
    # at most top_k sources per question
    ctx = rt.format_context(hits).join(hits.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources")), "query_id")
    out = routed.select("query_id", "question", "query_type").join(ctx, "query_id", "left") \
        .withColumn("sources", F.coalesce(F.col("sources"), F.array().cast(ctx.schema["sources"].dataType))) \
        .withColumn("context", F.coalesce(F.col("context"), F.lit(""))) \
        .withColumn("prompt", rt.qa_prompt(F.col("context"), F.col("question")))
    if generate_fn is not None:
        out = hooks.batch_generate(out, generate_fn)
    return out


def rag_from_text(questions: DataFrame, corpus: DataFrame, embed: Callable[[Column], Column], **options) -> DataFrame:
    """``rag_prompts`` for questions (query_id, question, ...) and a corpus (id, text, ...) that have no vectors yet.

    ``embed`` (such as ``hooks.embed_once`` with the caller's model) turns both kinds of text into vectors, so a
    question's vector always comes from the model of the corpus.
    """
    # a written corpus: its vectors are read once for the pivots and once to be dealt, and the model is costly
    texts = materialize(corpus.withColumn("embedding", embed(F.col("text"))))
    asked = materialize(questions.withColumn("embedding", embed(F.col("question"))))
    return rag_prompts(asked, texts, **options)


def multi_agent_query(questions: DataFrame, corpus: DataFrame, fundamentals: DataFrame, *,
                      generate_fn: Callable[[str], str], year: int | None = None, k: int = ANALYST_TOP_K,
                      company_key: str = "company_key") -> DataFrame:
    """Decompose each question, run every analyst task as one join over all tasks, synthesize.

    Financial / risk tasks are retrieval questions with their section (MD&A when
    the task has none) and k = 5; price tasks read the company's fundamentals
    (the synthesis shows only P/E and sector, so the price series is not needed).
    Output: query_id, synthesis.
    """
    tasks = pr.decompose(questions)
    rag_tasks = tasks.where(F.col("role") != "price_analyst").select(
        F.concat_ws(":", F.col("query_id").cast("string"), F.col("ordinal").cast("string")).alias("task_key"),
        "query_id", "ordinal", "role", "embedding", "question", "ticker", *(["year"] if "year" in tasks.columns else []),
        pr.analyst_section(F.col("section")).alias("section"))
    answered = rag_prompts(rag_tasks.select(F.col("task_key").alias("query_id"), "embedding", "question", "ticker",
                                            "section", *(["year"] if "year" in tasks.columns else [])), corpus, top_k=k, year=year, generate_fn=generate_fn,
                                route=False)
    rag_resp = rag_tasks.select("task_key", "query_id", "ordinal", "role").join(
        answered.select(F.col("query_id").alias("task_key"), "answer", "error"), "task_key") \
        .select("query_id", "ordinal", "role", "answer", F.col("error").isNull().alias("success"),
                F.lit(None).cast("double").alias("pe_ratio"), F.lit(None).cast("string").alias("sector"))
    price_resp = tasks.where(F.col("role") == "price_analyst").join(fundamentals, company_key, "left").select(
        "query_id", "ordinal", "role", F.lit(None).cast("string").alias("answer"), F.lit(True).alias("success"),
        F.col("pe_ratio").cast("double"), F.col("sector").cast("string"))
    return pr.synthesize(rag_resp.unionByName(price_resp))


def run_full_evaluation(pairs: DataFrame, *, key: list[str], lexicon: list[str] | None = None,
                        price_changes: str | None = None, positive: list[str] | None = None,
                        negative: list[str] | None = None, stem: bool = True) -> DataFrame:
    """One long metric table: ROUGE-1/2/L means (stemmed by default), entity P/R/F means and, with price changes, correlations."""
    r = ev.rouge_scores(pairs, key=key, stem=stem)
    e = ev.entity_prf(pairs, key=key, lexicon=lexicon)
    rm = ev.long_metrics(r.agg(F.avg("rouge1").alias("rouge1"), F.avg("rouge2").alias("rouge2"),
                               F.avg("rougeL").alias("rougeL")), ["rouge1", "rouge2", "rougeL"])
    em = ev.long_metrics(e.agg(F.avg("precision").alias("entity_precision"), F.avg("recall").alias("entity_recall"),
                               F.avg("f1").alias("entity_f1")), ["entity_precision", "entity_recall", "entity_f1"])
    out = rm.unionByName(em)
    if price_changes:
        s = pairs.select(sentiment_score(F.col("prediction"), positive, negative).alias("_s"), F.col(price_changes))
        p = stats.with_p_value(stats.pearson(s, "_s", price_changes))
        out = out.unionByName(ev.long_metrics(p.select(F.col("r").alias("pearson_correlation"),
                                                       F.col("p_value").alias("pearson_p_value")),
                                              ["pearson_correlation", "pearson_p_value"]))
        q = stats.with_p_value(stats.spearman(s, "_s", price_changes))
        out = out.unionByName(ev.long_metrics(q.select(F.col("r").alias("spearman_correlation"),
                                                       F.col("p_value").alias("spearman_p_value")),
                                              ["spearman_correlation", "spearman_p_value"]))
    return out


def build_index(files: DataFrame, *, dim: int = 384, filing_types: list[str] | None = None) -> DataFrame:
    """Landed filing files -> chunks -> vector records (hashed TF-IDF embeddings).

    The filing date is an expression of a file's own content, so the files are read once and not joined.
    """
    from ..constants import FILING_TYPES
    from ..operators.documents import process_filings
    from ..sources.filings import filing_date
    from ..sources.tables import vector_records

    files = files.where(F.col("filing_type").isin(*(filing_types or FILING_TYPES)))
    filings = files.select("ticker", "filing_type", filing_date(F.col("content")).alias("filing_date"), "file_path",
                           F.col("content").alias("html"))
    # The IDF fit is its own job: write the chunk table once so parsing and
    # chunking do not run again for the transform.
    chunks = materialize(process_filings(filings).where("error IS NULL").drop("error"))
    emb = hooks.hashed_tfidf_embedding(chunks, dim=dim)
    return vector_records(emb)


def build_pipeline(files: DataFrame, prices: DataFrame, folder: str, *, dim: int = 384, filing_types: list[str] | None = None,
                   price_time: str = "ts", **reaction) -> tuple[str, str]:
    """Landed filing files and price rows -> paths of the written vector table and of the written price reactions.

    The reactions are those of the indexed filings (``reaction``: options of ``price_reaction``).
    """
    from ..constants import FILING_TYPES
    from ..operators.events import price_reaction
    from ..sources.filings import filing_date
    from ..sources.tables import parquet_sink, vector_table_write

    vectors = vector_table_write(build_index(files, dim=dim, filing_types=filing_types), f"{folder}/vectors", reset=True)
    index = files.where(F.col("filing_type").isin(*(filing_types or FILING_TYPES))).select(
        "ticker", "filing_type", filing_date(F.col("content")).cast(prices.schema[price_time].dataType).alias("filing_date"))
    reactions = price_reaction(index.distinct(), prices, price_time=price_time, **reaction)
    return vectors, parquet_sink(reactions, f"{folder}/reactions")
