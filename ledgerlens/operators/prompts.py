"""Prompt building, question routing, decomposition and synthesis over tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    ANSWER_MARKER,
    CHAIN_TEMPLATES,
    DEFAULT_ANALYST_SECTION,
    INSTRUCTION_ANSWER_FIELDS,
    INSTRUCTION_CONTEXT_FIELDS,
    INSTRUCTION_QUESTION_FIELDS,
    QA_CONTEXT_DOCS,
)
from ..functions.lexicon import classify_query, decompose_tasks, route_section
from ..functions.text import py_strip
from .retrieval import fill_template


def _first_non_empty(df: DataFrame, fields: list[str]) -> Column:
    present = [F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields if f in df.columns]
    return F.coalesce(*present, F.lit("")) if present else F.lit("")


def instruction_text(context: Column, question: Column, answer: Column) -> Column:
    return F.concat(F.lit("### Context:\n"), context, F.lit("\n\n### Question:\n"), question,
                    F.lit("\n\n### Answer:\n"), answer)


def instruction_format(examples: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """QA rows -> one ``text`` column; each field is the first non-empty of its fallbacks."""
    ctx = _first_non_empty(examples, INSTRUCTION_CONTEXT_FIELDS)
    q = _first_non_empty(examples, INSTRUCTION_QUESTION_FIELDS)
    a = _first_non_empty(examples, INSTRUCTION_ANSWER_FIELDS)
    return examples.select(*(keep or []), instruction_text(ctx, q, a).alias("text"))


def _split_marker(c: Column, marker: str) -> Column:
    return F.split(c, "\\Q" + marker + "\\E", -1)


def split_answer(text: Column, generated: Column | None = None, marker: str = ANSWER_MARKER) -> dict[str, Column]:
    """prompt = text before the marker + marker; reference = the second part stripped;
    prediction = last part of the generated text stripped, else the text after the prompt length."""
    parts = _split_marker(text, marker)
    has = F.contains(text, F.lit(marker))
    prompt = F.when(has, F.concat(F.element_at(parts, 1), F.lit(marker))).otherwise(text)
    reference = F.when(has, py_strip(F.element_at(parts, 2))).otherwise(F.lit(""))
    out = {"prompt": prompt, "reference": reference}
    if generated is not None:
        gparts = _split_marker(generated, marker)
        out["prediction"] = F.when(F.contains(generated, F.lit(marker)), py_strip(F.element_at(gparts, -1))) \
            .otherwise(py_strip(F.substring(generated, F.length(prompt) + 1, 1 << 30)))
    return out


def strip_prompt_echo(generated: Column, prompt: Column) -> Column:
    """Drop an echoed prompt: cut ``len(prompt)`` characters when the prompt is contained, then strip."""
    return F.when(F.contains(generated, prompt), py_strip(F.substring(generated, F.length(prompt) + 1, 1 << 30))) \
        .otherwise(py_strip(generated))


def route_queries(questions: DataFrame, question: str = "question", section: str | None = None) -> DataFrame:
    """Add ``query_type`` and the routed ``section`` (risk / financial override the caller's section)."""
    qt = classify_query(F.col(question))
    caller = F.col(section) if section else None
    return questions.withColumn("query_type", qt).withColumn("section", route_section(F.col("query_type"), caller))


def decompose(questions: DataFrame, *, query_id: str = "query_id", question: str = "question") -> DataFrame:
    """One row per subtask: (query_id, ordinal, task_id, description, role, section); row-local posexplode."""
    keep = [c for c in questions.columns if c != question]
    return questions.select(*keep, F.col(question), F.posexplode(decompose_tasks(F.col(question)))
                            .alias("ordinal", "_t")).select(*keep, question, "ordinal", "_t.*")


def agent_registry(spark) -> DataFrame:
    """The registered agents as a small dimension table (role, agent_name)."""
    from ..constants import AGENT_REGISTRY

    return spark.createDataFrame(AGENT_REGISTRY, "role string, agent_name string")


def dispatch_tasks(tasks: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Tasks joined to the agent that handles their role; a role without an agent is skipped.

    The registry is a fixed handful of rows, broadcast to the tasks.
    """
    reg = agents if agents is not None else agent_registry(tasks.sparkSession)
    return tasks.join(F.broadcast(reg), "role", "inner")


def analyst_section(section: Column) -> Column:
    """The analyst's section: the task's section, MD&A when the task carries none."""
    return F.coalesce(section, F.lit(DEFAULT_ANALYST_SECTION))


def chain_prompts(filings: DataFrame, *, ticker: str = "ticker", filing_date: str = "filing_date",
                  compare_date: str | None = None) -> DataFrame:
    """Question chains per (ticker, filing date): guidance 3, risk 3, sentiment 1, compare 1.

    The templates are a fixed array literal exploded per row (no join).  The date
    is carried; it is not used as a retrieval filter.  ``compare_date`` gives the
    second date of the comparison question (the filing date itself when absent).
    """
    d1 = F.col(filing_date).cast("string")
    d2 = F.col(compare_date).cast("string") if compare_date else d1
    entries = []
    for i, (chain, tmpl, section, k) in enumerate(CHAIN_TEMPLATES):
        q = fill_template(tmpl, ticker=F.col(ticker).cast("string"), date1=d1, date2=d2)
        entries.append(F.struct(F.lit(i).alias("ordinal"), F.lit(chain).alias("chain"), q.alias("question"),
                                F.lit(section).cast("string").alias("section"), F.lit(k).alias("top_k")))
    return filings.select(F.col(ticker), F.col(filing_date), F.explode(F.array(*entries)).alias("_c")) \
        .select(ticker, filing_date, "_c.*")


def synthesize(responses: DataFrame, *, query_id: str = "query_id", ordinal: str = "ordinal") -> DataFrame:
    """Per query: a heading and the answer per role, in task order, joined by a blank line.

    Rows that failed (``success`` false) or have no answer (NULL) are skipped; an empty answer keeps its
    heading; the price role shows ``P/E`` and ``Sector`` from its fundamentals.  Each query's list is
    bounded by its (at most three) subtasks.
    """
    role = F.col("role")
    answer = F.coalesce(F.col("answer"), F.lit(""))
    pe = F.coalesce(F.col("pe_ratio").cast("string"), F.lit("None"))
    sector = F.coalesce(F.col("sector").cast("string"), F.lit("None"))
    part = (F.when(role == "financial_analyst", F.concat(F.lit("Financial Analysis:\n"), answer))
            .when(role == "risk_analyst", F.concat(F.lit("Risk Analysis:\n"), answer))
            .when(role == "price_analyst", F.concat(F.lit("Price & Fundamentals:\nP/E: "), pe, F.lit(", Sector: "),
                                                     sector)))
    has_result = F.when(role == "price_analyst", F.lit(True)).otherwise(F.col("answer").isNotNull())
    ok = F.coalesce(F.col("success"), F.lit(True)) & has_result & part.isNotNull()
    rows = responses.select(query_id, ordinal, F.when(ok, part).alias("_part"))
    g = rows.groupBy(query_id).agg(F.array_sort(F.collect_list(
        F.when(F.col("_part").isNotNull(), F.struct(F.col(ordinal).alias("o"), F.col("_part").alias("p"))))).alias("_l"))
    return g.select(query_id, F.array_join(F.transform("_l", lambda x: x["p"]), "\n\n").alias("synthesis"))


def first_n_per_key(df: DataFrame, key: str, order: list[str], n: int = QA_CONTEXT_DOCS) -> DataFrame:
    """First n rows per key by ``order`` (row_number <= n, planned as a WindowGroupLimit)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def qa_context_join(qa: DataFrame, docs: DataFrame, *, key: str = "ticker", doc_order: list[str] | None = None,
                    n: int = QA_CONTEXT_DOCS) -> DataFrame:
    """Per QA pair: the first n documents of its key joined by a blank line (no match: empty context)."""
    order = doc_order or ["doc_id"]
    firsts = first_n_per_key(docs, key, order, n)
    ctx = firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order],
                                                                       F.col("text").alias("_t")))).alias("_l"))
    ctx = ctx.select(key, F.array_join(F.transform("_l", lambda x: x["_t"]), "\n\n").alias("context"))
    return qa.join(ctx, key, "left").withColumn("context", F.coalesce(F.col("context"), F.lit("")))


def range_slice(df: DataFrame, order: list[str], n_train: int, n_test: int) -> DataFrame:
    """Train = first ``n_train`` rows; test = ``n_test`` rows from ``min(n_train + 100, total - n_test)``.

    Positions come from buckets of the key with per-bucket offsets (no single-partition
    window); ``split`` says which slice.
    """
    from .stats import row_positions

    pos = row_positions(df, order)
    start = F.least(F.lit(n_train + 100), F.col("_n") - F.lit(n_test))
    split = F.when(F.col("_pos") < n_train, F.lit("train")) \
        .when((F.col("_pos") >= start) & (F.col("_pos") < start + n_test), F.lit("test"))
    return pos.withColumn("split", split).where(F.col("split").isNotNull()).drop("_n")


def head_n(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """First n rows of an explicitly ordered table (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def sort_index(index: DataFrame, *, ticker: str = "ticker", filing_date: str = "filing_date") -> DataFrame:
    """Filing index order: ticker, then date with missing dates last."""
    return index.orderBy(F.col(ticker).asc(), F.col(filing_date).asc_nulls_last())
