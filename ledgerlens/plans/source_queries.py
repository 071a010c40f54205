"""Driver queries for sources, sinks and hooks.

Queries that write first write under the shared checkpoint folder of the
session (``spark.checkpoint.dir``) and read the table back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import VECTOR_COLLECTION_NAME
from ..operators import hooks
from ..session import scratch_path
from ..sources import filings as fl
from ..sources import prices as px
from ..sources import tables as tb
from . import bindings as b
from .eval_queries import _CBA_SQL, _ENT, _LCS_SQL, _NEG_SQL, _PAIRS, _POS_SQL, KEY, _avg_rank, _p_value_sql, _rouge_sql
from .events_queries import _px, q_price_reaction
from .registry import register
from . import section_sql
from .prompt_queries import _PQ, _RAG, _decompose_sql
from .retrieval_queries import _CENTROIDS, _CORPUS
from .retrieval_queries import _sql_template
from .text_queries import _STRIP, _WORDS, STEP

_FILES_SQL = """fx AS (SELECT DISTINCT source AS ticker, CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 2 = 0
  THEN '10-K' ELSE '10-Q' END AS filing_type, DATE '2020-01-01' + CAST((doc_id // 400) * 91 AS INTEGER) AS filing_date
  FROM documents)"""


def land_filings(spark, sf_dir) -> str:
    """Write one file per synthetic filing in a ticker / type / submission folder layout.

    A filing is one row, so its task writes its file: the texts are not shuffled again.
    """
    f = b.synthetic_filings(spark, sf_dir)
    content = F.concat(F.lit("ACCESSION NUMBER: 0\nCONFORMED SUBMISSION TYPE: "), F.col("filing_type"),
                       F.lit("\nFILED AS OF DATE:\t\t"), F.date_format("filing_date", "yyyyMMdd"),
                       F.lit("\n<html><body><p>"), F.col("text"), F.lit("</p></body></html>"))
    root = scratch_path(spark, "landed")
    (f.select("ticker", "filing_type", F.date_format("filing_date", "yyyyMMdd").alias("submission"),
              content.alias("value"))
     .write.partitionBy("ticker", "filing_type", "submission").text(root))
    return root


HIVE_LAYOUT = r"ticker=([^/]+)/filing_type=([^/]+)/submission=([^/]+)/[^/]+$"


def _scan(spark, sf_dir):
    return fl.filing_scan(spark, land_filings(spark, sf_dir), layout=HIVE_LAYOUT, name_glob="part-*")


@register("filing_scan", f"WITH {_FILES_SQL} SELECT ticker, filing_type, strftime(filing_date, '%Y%m%d') AS submission FROM fx")
def q_filing_scan(spark, sf_dir):
    """#1: landed files listed and read whole by the file source; ticker and type from folder names."""
    return _scan(spark, sf_dir).select("ticker", "filing_type", "submission")


@register("filing_date_extract", f"WITH {_FILES_SQL} SELECT ticker, filing_type, filing_date FROM fx")
def q_filing_date_extract(spark, sf_dir):
    """#2: first marker line among the first 50, 8 characters after it, parsed as yyyyMMdd."""
    s = _scan(spark, sf_dir)
    return s.select("ticker", "filing_type", fl.filing_date(F.col("content")).alias("filing_date"))


@register("filing_index", f"WITH {_FILES_SQL} SELECT ticker, filing_type, filing_date FROM fx")
def q_filing_index(spark, sf_dir):
    """#3: index of landed filings of the indexed types, ordered by ticker and date."""
    heads = fl.filing_heads(spark, land_filings(spark, sf_dir), layout=HIVE_LAYOUT, name_glob="part-*")
    return fl.filing_index(heads).select("ticker", "filing_type", "filing_date")


@register("count_by_ticker_type", f"WITH {_FILES_SQL} SELECT ticker, filing_type, count(*) AS n_filings FROM fx GROUP BY ALL")
def q_count_by_ticker_type(spark, sf_dir):
    """#52: filings per ticker and type."""
    return fl.count_by_ticker_type(b.synthetic_filings(spark, sf_dir))


@register("distinct_tickers", "SELECT DISTINCT user_id AS ticker FROM events WHERE event_type = 'signup'")
def q_distinct_tickers(spark, sf_dir):
    """#53: distinct tickers of the filing index."""
    return fl.distinct_tickers(b.event_filings(spark, sf_dir))


@register("ticker_normalize", "SELECT c_custkey, replace(printf('%.2f', c_acctbal), '.', '-') AS ticker FROM customer")
def q_ticker_normalize(spark, sf_dir):
    """#4: dots become dashes (on dotted strings derived from customer balances)."""
    c = b.table(spark, sf_dir, "customer")
    return c.select("c_custkey", fl.ticker_normalize(F.format_string("%.2f", "c_acctbal")).alias("ticker"))


@register("price_scan", f"""SELECT user_id AS ticker, ts, round(value, 6) AS close FROM events
WHERE event_type <> '{b.EVENT_FILING_TYPE}' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'""")
def q_price_scan(spark, sf_dir):
    """#5: price rows in [start, end) when both ends are given."""
    p = b.event_prices(spark, sf_dir)
    return px.price_scan(p, start="2024-01-05", end="2024-01-10").select("ticker", "ts", "close")


@register("price_scan_trailing", f"""WITH p AS (SELECT user_id AS ticker, ts, value FROM events
  WHERE event_type <> '{b.EVENT_FILING_TYPE}'), m AS (SELECT ticker, max(ts) AS last FROM p GROUP BY 1)
SELECT p.ticker, p.ts, round(p.value, 6) AS close FROM p JOIN m USING (ticker)
WHERE p.ts >= CAST(CAST(m.last AS DATE) - INTERVAL 1 MONTH AS TIMESTAMP)""")
def q_price_scan_trailing(spark, sf_dir):
    """#5: trailing period per series when no range is given (1 month back from each series' last row)."""
    p = b.event_prices(spark, sf_dir)
    return px.price_scan(p, trailing_months=1).select("ticker", "ts", "close")


@register("earnings_dates_scan", f"""SELECT user_id AS ticker, ts AS earnings_date FROM events
WHERE event_type = '{b.EVENT_FILING_TYPE}'""")
def q_earnings_dates_scan(spark, sf_dir):
    """#6: calendar rows with the date renamed earnings_date."""
    f = b.event_filings(spark, sf_dir).select("ticker", "filing_date")
    return px.earnings_dates_scan(f, date_col="filing_date")


@register("fundamentals_project", """WITH l AS (SELECT user_id AS ticker, max_by(props, ts) AS info FROM events GROUP BY 1)
SELECT ticker, CAST(json_extract_string(info, '$.k') AS DOUBLE) AS market_cap,
       CAST(json_extract_string(info, '$.trailingPE') AS DOUBLE) AS pe_ratio,
       json_extract_string(info, '$.sector') AS sector FROM l""")
def q_fundamentals_project(spark, sf_dir):
    """#7: provider fields picked from the latest JSON document per ticker (missing -> NULL)."""
    e = b.table(spark, sf_dir, "events")
    latest = e.groupBy(F.col("user_id").alias("ticker")).agg(F.max_by("props", "ts").alias("info"))
    return px.fundamentals_project(latest, fields=[("k", "market_cap"), ("trailingPE", "pe_ratio"),
                                                   ("sector", "sector")])


@register("parquet_sink", f"""WITH {_px()}
SELECT ticker, earnings_date, filing_type, round(pre_price, 6) AS pre_price, round(post_price, 6) AS post_price,
       round(price_change_pct, 6) AS price_change_pct, round(volume_change_pct, 6) AS volume_change_pct,
       CASE WHEN price_change_pct > 0 THEN 'up' ELSE 'down' END AS direction FROM rx""")
def q_parquet_sink(spark, sf_dir):
    """#9 / #10: reactions written as Parquet (partitioned by ticker) and read back with their schema."""
    r = q_price_reaction(spark, sf_dir)
    path = tb.parquet_sink(r, scratch_path(spark, "reactions"), partition_by=["filing_type"])
    back = tb.parquet_source(spark, path)
    return back.select(*r.columns)


@register("csv_sink", f"WITH {_PAIRS} SELECT conv_id, turn, reference, prediction FROM pairs")
def q_csv_sink(spark, sf_dir):
    """#11: evaluation rows with multi-line text written as CSV and read back intact."""
    p = b.conversation_pairs(spark, sf_dir).select(*KEY, "reference", "prediction")
    path = tb.csv_sink(p, scratch_path(spark, "eval-csv"))
    return tb.csv_source(spark, path, p.schema)


@register("vector_table_write", """SELECT 'T' || CAST(vec_id % 5 AS VARCHAR) || '_' || CASE WHEN vec_id % 2 = 0 THEN '10-K'
  ELSE '10-Q' END || '_' || strftime(CAST(DATE '2019-01-01' + CAST(vec_id * 5 AS INTEGER) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')
  || '_' || (['MD&A', 'RISK_FACTORS', 'BUSINESS', 'FINANCIAL_STATEMENTS'])[label % 4 + 1] || '_' || CAST(vec_id % 7 AS VARCHAR)
  AS id, len(embedding) AS dim, md5('chunk text ' || vec_id) AS document_md5, CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS DOUBLE) AS total
  FROM embeddings QUALIFY row_number() OVER (PARTITION BY id ORDER BY 'chunk text ' || vec_id) = 1""")
def q_vector_table_write(spark, sf_dir):
    """#12: vector records written (reset) and read back, one row per id."""
    recs = tb.vector_records(b.vector_corpus(spark, sf_dir))
    path = tb.vector_table_write(recs, scratch_path(spark, "vectors"), reset=True)
    back = tb.vector_table_read(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("id", F.size("embedding").alias("dim"), F.md5("document").alias("document_md5"), total.alias("total"))


@register("vector_table_drop", """SELECT count(*) AS rows_before, true AS dropped, CAST(0 AS BIGINT) AS tables_left
FROM embeddings""")
def q_vector_table_drop(spark, sf_dir):
    """#14: an external table over the vector records is dropped; the catalog no longer lists it."""
    recs = tb.vector_records(b.vector_corpus(spark, sf_dir))
    path = tb.vector_table_write(recs, scratch_path(spark, "vectors-drop"), reset=True)
    name = "ledgerlens_vectors_tmp"
    tb.vector_table_drop(spark, name)  # a table left by an interrupted run must not shadow this one
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")  # lists the buckets
    n = spark.table(name).count()
    ok = tb.vector_table_drop(spark, name)
    left = spark.sql(f"SHOW TABLES LIKE '{name}'").count()
    return spark.createDataFrame([(n, ok, left)], "rows_before long, dropped boolean, tables_left long")


@register("metric_report", f"""WITH {_CBA_SQL},
r AS (SELECT metric, before, after, delta, pct_change, dense_rank() OVER (ORDER BY metric) AS m FROM cba),
rl AS (SELECT 0 AS m, 0 AS i, 'Evaluation Report' AS line UNION ALL SELECT 0, 1, repeat('=', 50)
  UNION ALL SELECT m, 0, chr(10) || metric || ':' FROM r
  UNION ALL SELECT m, 1, '  Score: ' || printf('%.4f', after) FROM r
  UNION ALL SELECT m, 2, '  Baseline: ' || printf('%.4f', before) FROM r WHERE before IS NOT NULL AND before <> 0
  UNION ALL SELECT m, 3, '  Improvement: ' || printf('%.4f', delta) FROM r WHERE before IS NOT NULL AND before <> 0
  UNION ALL SELECT m, 4, '  Details:' FROM r
  UNION ALL SELECT m, 5, '    pct_change: ' || printf('%.4f', pct_change) FROM r)
SELECT row_number() OVER (ORDER BY m, i) AS line_no, line FROM rl""")
def q_metric_report(spark, sf_dir):
    """#15: report lines of a metric table (score %.4f, baseline / improvement when set, details)."""
    from .eval_queries import q_compare_before_after

    c = q_compare_before_after(spark, sf_dir)
    res = c.select(F.col("metric").alias("metric_order"), F.col("metric").alias("metric_name"),
                   F.col("after").alias("score"), F.col("before").alias("baseline_score"),
                   F.col("delta").alias("improvement"),
                   F.create_map(F.lit("pct_change"), F.col("pct_change")).alias("details"))
    return tb.metric_report(res)


# ------------------------------------------------------------------ hooks and compositions
@register("embed_text", f"""SELECT doc_id, 64 AS dim, CAST(CASE WHEN len({_WORDS}) = 0 THEN 0 ELSE 1 END AS DOUBLE) AS norm FROM documents""")
def q_embed_text(spark, sf_dir):
    """#87: built-in embedding (hashed TF -> IDF -> unit norm) of every document; the vectors are checked in pytest."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    e = hooks.hashed_tfidf_embedding(d, dim=64)
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0),
                              lambda a, v: a + v))
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


def _make_counting_model():
    """Deterministic stand-in for a caller's embedding model: four counts of the text."""
    return lambda texts: [[len(t), t.count("e"), t.count("the"), t.count(" ")] for t in texts]


@register("embed_with_model", """SELECT doc_id, CAST(length(text) AS DOUBLE) AS e0, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e1,
  CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS DOUBLE) AS e2, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS e3 FROM documents""")
def q_embed_with_model(spark, sf_dir):
    """#87: the caller's model, made once per worker, over batches of texts."""
    d = b.table(spark, sf_dir, "documents")
    e = d.select("doc_id", hooks.embed_once(_make_counting_model, F.coalesce("text", F.lit(""))).alias("e"))
    return e.select("doc_id", *[F.col("e")[i].cast("double").alias(f"e{i}") for i in range(4)])


def _first_line(prompt: str) -> str:
    """Deterministic stand-in generator: the first source line of the context, else the question line."""
    for line in prompt.splitlines():
        if line.startswith("[Source"):
            return line
    return prompt.strip().splitlines()[-1] if prompt.strip() else ""


@register("batch_generate", _RAG + """
SELECT qr.query_id, CASE WHEN ctx.context IS NOT NULL THEN split_part(ctx.context, chr(10), 1) ELSE 'Answer:' END
       AS answer, CAST(NULL AS VARCHAR) AS error
FROM qr LEFT JOIN ctx USING (query_id)""")
def q_batch_generate(spark, sf_dir):
    """#88: generation over Arrow batches with a caller function; errors become a column."""
    from .prompt_queries import q_rag_query

    prompts = q_rag_query(spark, sf_dir)
    return hooks.batch_generate(prompts, _first_line).select("query_id", "answer", "error")


@register("compare_models", _RAG + f"""
SELECT qr.query_id, CASE WHEN ctx.context IS NOT NULL THEN split_part(ctx.context, chr(10), 1) ELSE 'Answer:' END
       AS base_response, right({_sql_template("coalesce(ctx.context, '')", 'qr.question')}, 200) AS tuned_response
FROM qr LEFT JOIN ctx USING (query_id)""")
def q_compare_models(spark, sf_dir):
    """#89: two generators over the same prompts, side by side."""
    from .prompt_queries import q_rag_query

    prompts = q_rag_query(spark, sf_dir)
    return hooks.compare_models(prompts, _first_line, lambda p: p[-200:]).select(
        "query_id", "base_response", "tuned_response")


@register("apply_per_filing", f"""WITH {section_sql.filings_sql()}
SELECT ticker, filing_type, CASE WHEN contains(text, 'ITEM 7.') THEN CAST(len(regexp_extract_all(text, 'ITEM \\d')) AS BIGINT) END AS n_items,
       CASE WHEN NOT contains(text, 'ITEM 7.') THEN 'ValueError: no item 7' END AS error FROM fil""")
def q_apply_per_filing(spark, sf_dir):
    """#90: a caller function per filing; filings without an item 7 fail and keep a row with the error."""
    f = b.synthetic_filings(spark, sf_dir).select("ticker", "filing_type", "text")

    def count_items(pdf):
        import pandas as pd

        if not pdf["text"].str.contains("ITEM 7.", regex=False).all():
            raise ValueError("no item 7")
        return pd.DataFrame({"ticker": pdf["ticker"], "filing_type": pdf["filing_type"],
                             "n_items": pdf["text"].str.count(r"ITEM \d").astype("int64")})

    return hooks.apply_per_filing(f, count_items, "ticker string, filing_type string, n_items long")


_MA_SQL = f"""WITH {_CORPUS}, {_CENTROIDS}, {_PQ}, {_decompose_sql()},
qq AS (SELECT pq.query_id, lc.embedding, pq.question, pq.ticker, pq.company_key,
              CASE WHEN pq.query_id % 3 > 0 THEN 2019 + pq.query_id % 4 END AS year FROM lc JOIN pq ON pq.query_id % 10 = lc.label),
rt AS (SELECT tasks.query_id, tasks.ordinal, tasks.role, coalesce(tasks.section, 'MD&A') AS section, qq.embedding,
              qq.ticker, qq.year FROM tasks JOIN qq USING (query_id) WHERE tasks.role <> 'price_analyst'),
d AS (SELECT rt.query_id, rt.ordinal, rt.year, c.id, c.ticker, c.filing_type, c.filing_date, c.section, c.text,
        list_sum(list_transform(range(1, len(rt.embedding) + 1),
          lambda i: (CAST(rt.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE))
                  * (CAST(rt.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)))) AS distance
      FROM rt, corpus c WHERE c.ticker = rt.ticker AND c.section = rt.section),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ordinal ORDER BY distance, id) AS r0 FROM d) WHERE r0 <= 50),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ordinal ORDER BY distance, id) AS rank
      FROM w WHERE year IS NULL OR contains(CAST(filing_date AS VARCHAR), CAST(year AS VARCHAR))) WHERE rank <= 5),
ctx AS (SELECT query_id, ordinal, string_agg('[Source ' || rank || '] ' || ticker || ' - ' || filing_type || ' ('
          || strftime(CAST(filing_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') || ') - ' || section || ':' || chr(10)
          || text, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id, ordinal),
ans AS (SELECT rt.query_id, rt.ordinal, rt.role,
          CASE WHEN ctx.context IS NOT NULL THEN split_part(ctx.context, chr(10), 1) ELSE 'Answer:' END AS answer
        FROM rt LEFT JOIN ctx USING (query_id, ordinal)),
pa AS (SELECT tasks.query_id, tasks.ordinal, c.c_acctbal AS pe, c.c_mktsegment AS sector
       FROM tasks JOIN qq USING (query_id) LEFT JOIN customer c ON c.c_custkey = qq.company_key
       WHERE tasks.role = 'price_analyst'),
parts AS (SELECT query_id, ordinal, CASE WHEN role = 'financial_analyst' THEN 'Financial Analysis:' || chr(10) || answer
                 WHEN role = 'risk_analyst' THEN 'Risk Analysis:' || chr(10) || answer END AS part FROM ans
          UNION ALL SELECT query_id, ordinal, 'Price & Fundamentals:' || chr(10) || 'P/E: '
                 || coalesce(CAST(pe AS VARCHAR), 'None') || ', Sector: ' || coalesce(sector, 'None') FROM pa)
SELECT query_id, string_agg(part, chr(10) || chr(10) ORDER BY ordinal) AS synthesis FROM parts GROUP BY query_id"""


@register("multi_agent_query", _MA_SQL)
def q_multi_agent_query(spark, sf_dir):
    """#94: decompose -> analysts (retrieval per task, fundamentals for price) -> synthesis."""
    from .compositions import multi_agent_query
    from .prompt_queries import _vec_questions

    qs = _vec_questions(spark, sf_dir)
    return multi_agent_query(qs, b.vector_corpus(spark, sf_dir), b.customer_fundamentals(spark, sf_dir),
                             generate_fn=_first_line)


_COUNTS = "[length({0}), length({0}) - length(replace({0}, 'e', '')), (length({0}) - length(replace({0}, 'the', ''))) // 3, length({0}) - length(replace({0}, ' ', ''))]"


@register("rag_text_query", f"""WITH q AS (SELECT item_id AS query_id, text AS question, {_COUNTS.format('text')} AS e FROM benchmark),
cv AS (SELECT doc_id AS id, source AS ticker, lang AS section, DATE '2019-01-01' + CAST(doc_id AS INTEGER) AS filing_date, text, {_COUNTS.format('text')} AS e FROM documents),
d AS (SELECT query_id, id, ticker, section, filing_date, text, CAST(list_sum(list_transform(range(1, 5), lambda i: (q.e[i] - cv.e[i]) * (q.e[i] - cv.e[i]))) AS DOUBLE) AS distance FROM q, cv),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d QUALIFY rank <= 5),
ctx AS (SELECT query_id, string_agg('[Source ' || rank || '] ' || ticker || ' - 10-K (' || strftime(CAST(filing_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') || ') - '
          || section || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
        string_agg(id || ':' || rank, ',' ORDER BY rank) AS sources FROM h GROUP BY query_id)
SELECT q.query_id, {_sql_template("coalesce(ctx.context, '')", 'q.question')} AS prompt, coalesce(sources, '') AS sources FROM q LEFT JOIN ctx USING (query_id)""")
def q_rag_text_query(spark, sf_dir):
    """#93: questions and documents embedded from their texts by the same model, then retrieval, context and prompt."""
    from .compositions import rag_from_text

    questions = b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    corpus = b.document_chunks_input(spark, sf_dir).withColumnRenamed("doc_id", "id")
    out = rag_from_text(questions, corpus, lambda text: hooks.embed_once(_make_counting_model, text), top_k=5, route=False)
    sources = F.array_join(F.transform("sources", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["rank"].cast("string"))), ",")
    return out.select("query_id", "prompt", sources.alias("sources"))


def _evaluation(spark, sf_dir, stem):
    from .compositions import run_full_evaluation

    p = b.conversation_pairs(spark, sf_dir).withColumn("change", F.length("prediction").cast("double"))
    return run_full_evaluation(p, key=KEY, lexicon=b.FIXTURE_POSITIVE + b.FIXTURE_NEGATIVE, price_changes="change",
                               positive=b.FIXTURE_POSITIVE, negative=b.FIXTURE_NEGATIVE, stem=stem)


@register("run_full_evaluation")
def q_run_full_evaluation(spark, sf_dir):
    """#95: ROUGE-1/2/L (stemmed), entity P/R/F and sentiment correlation as one metric table."""
    return _evaluation(spark, sf_dir, True)


_SENT_PAIRS = f"""sn AS (SELECT CAST(length(prediction) AS DOUBLE) AS change, len(list_filter({_POS_SQL}, lambda w: contains(lower(prediction), w))) AS p,
  len(list_filter({_NEG_SQL}, lambda w: contains(lower(prediction), w))) AS n FROM pairs),
sp AS (SELECT change, CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / (p + n) END AS score FROM sn),
sk AS (SELECT {_avg_rank('score', 'sp')} AS rx, {_avg_rank('change', 'sp')} AS ry FROM sp)"""


@register("run_full_evaluation_unstemmed", f"""WITH RECURSIVE {_PAIRS}, {_LCS_SQL}, {_rouge_sql(1)}, {_rouge_sql(2)}, {_ENT}, {_SENT_PAIRS},
cp AS (WITH c AS (SELECT count(*) AS n, corr(score, change) AS r FROM sp), {_p_value_sql('c')}),
cs AS (WITH c AS (SELECT count(*) AS n, corr(rx, ry) AS r FROM sk), {_p_value_sql('c')})
SELECT 'rouge1' AS metric, round(avg(rouge1), 6) AS value FROM r1 UNION ALL SELECT 'rouge2', round(avg(rouge2), 6) FROM r2
UNION ALL SELECT 'rougeL', round(avg("rougeL"), 6) FROM rl
UNION ALL SELECT 'entity_precision', round(avg(precision), 6) FROM prf UNION ALL SELECT 'entity_recall', round(avg(recall), 6) FROM prf
UNION ALL SELECT 'entity_f1', round(avg(f1), 6) FROM prf
UNION ALL SELECT 'pearson_correlation', r FROM cp UNION ALL SELECT 'pearson_p_value', p_value FROM cp
UNION ALL SELECT 'spearman_correlation', r FROM cs UNION ALL SELECT 'spearman_p_value', p_value FROM cs""")
def q_run_full_evaluation_unstemmed(spark, sf_dir):
    """#95: the same metric table without stemming, which SQL can check."""
    return _evaluation(spark, sf_dir, False)


_INDEX_SQL = f"""{section_sql.filings_sql()},
landed AS (SELECT ticker, filing_type, filing_date, file_path, 'ACCESSION NUMBER: 0 CONFORMED SUBMISSION TYPE: ' || filing_type
             || ' FILED AS OF DATE: ' || strftime(filing_date, '%Y%m%d') || ' ' || text AS text FROM fil),
{section_sql.sections_sql("landed")},
w AS (SELECT ticker, filing_type, filing_date, section, {_WORDS.replace('(text,', '(stext,')} AS words FROM kept
      WHERE length(regexp_replace(stext, {_STRIP}, '', 'g')) > 100),
c AS (SELECT *, unnest(range(0, len(words), {STEP})) AS st FROM w)"""


@register("build_index", f"""WITH {_INDEX_SQL}
SELECT '{VECTOR_COLLECTION_NAME}' AS collection_name, count(DISTINCT (ticker, filing_type, filing_date, section, st)) AS total_documents FROM c""")
def q_build_index(spark, sf_dir):
    """#96: landed files -> index -> chunks -> vectors -> table stats."""
    from .compositions import build_index

    recs = build_index(_scan(spark, sf_dir), dim=64)
    path = tb.vector_table_write(recs, scratch_path(spark, "index"), reset=True)
    return tb.vector_table_stats(tb.vector_table_read(spark, path))


_REACTION_CTES = _px()[_px().index("bk AS ("):].rstrip()


@register("build_pipeline", f"""WITH {_INDEX_SQL},
px AS (SELECT 'src' || (user_id % 20) AS ticker, TIMESTAMP '2019-12-01' + to_days(CAST(event_id % 2500 AS INTEGER)) + to_microseconds(event_id % 1000000) AS ts, event_id, value AS close,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id % 2500, event_id) AS rn
       FROM events WHERE event_type <> '{b.EVENT_FILING_TYPE}'),
fl AS (SELECT DISTINCT ticker, CAST(filing_date AS TIMESTAMP) AS earnings_date, filing_type FROM landed),
{_REACTION_CTES},
nc AS (SELECT ticker, filing_type, CAST(filing_date AS TIMESTAMP) AS earnings_date, count(DISTINCT (section, st)) AS n_records FROM c GROUP BY ALL)
SELECT rx.ticker, CAST(rx.earnings_date AS DATE) AS filing_date, rx.filing_type, round(rx.price_change_pct, 6) AS price_change_pct,
  CASE WHEN rx.price_change_pct > 0 THEN 'up' ELSE 'down' END AS direction, coalesce(nc.n_records, 0) AS n_records
FROM rx LEFT JOIN nc USING (ticker, earnings_date, filing_type)""")
def q_build_pipeline(spark, sf_dir):
    """#96: landed files and prices -> vector table and price reactions, both written; reactions with their filings' records."""
    from .compositions import build_pipeline

    ev = b.table(spark, sf_dir, "events").where(F.col("event_type") != b.EVENT_FILING_TYPE)
    day = F.timestamp_add("DAY", (F.col("event_id") % 2500).cast("int"), F.lit("2019-12-01").cast("timestamp_ntz"))
    day = F.timestamp_add("MICROSECOND", (F.col("event_id") % 1_000_000).cast("int"), day)  # no two prices at once
    prices = ev.select(F.concat(F.lit("src"), F.col("user_id") % 20).alias("ticker"), day.alias("ts"), "event_id", F.col("value").alias("close"),
                       F.get_json_object("props", "$.k").cast("double").alias("volume"))
    vectors, reactions = build_pipeline(_scan(spark, sf_dir), prices, scratch_path(spark, "pipeline"), dim=64, tie="event_id")
    n = tb.vector_table_read(spark, vectors).groupBy("ticker", "filing_type", F.to_date("filing_date").alias("filing_date")).agg(F.count(F.lit(1)).alias("n_records"))
    r = tb.parquet_source(spark, reactions).withColumn("filing_date", F.to_date("earnings_date"))
    return r.join(n, ["ticker", "filing_type", "filing_date"], "left").select(
        "ticker", "filing_date", "filing_type", "price_change_pct", "direction", F.coalesce("n_records", F.lit(0)).cast("long").alias("n_records"))
