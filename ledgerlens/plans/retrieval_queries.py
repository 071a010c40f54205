"""Driver queries for retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import QA_TEMPLATE, VECTOR_COLLECTION_NAME, WS_RUN
from ..operators import retrieval as rt
from . import bindings as b
from .registry import register

_SECTIONS = ", ".join(f"'{s}'" for s in b.SECTION_NAMES)
_CORPUS = f"""corpus AS (
  SELECT vec_id AS id, 'T' || CAST(vec_id % 5 AS VARCHAR) AS ticker,
         CASE WHEN vec_id % 2 = 0 THEN '10-K' ELSE '10-Q' END AS filing_type,
         DATE '2019-01-01' + CAST(vec_id * 5 AS INTEGER) AS filing_date,
         ([{_SECTIONS}])[label % 4 + 1] AS section, CAST(vec_id % 7 AS INTEGER) AS chunk_id,
         'chunk text ' || CAST(vec_id AS VARCHAR) AS text, embedding
  FROM embeddings),
q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0)"""
# the centroids of the labels, the vectors of the part questions
_CENTROIDS = """qc AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS v FROM (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos),
lc AS (SELECT CAST(label AS BIGINT) AS label, list(v ORDER BY pos) AS embedding FROM qc GROUP BY label)"""


def _dist(where: str = "TRUE") -> str:
    return f"""d AS (
  SELECT q.query_id, c.id, c.ticker, c.section, c.filing_date,
         list_sum(list_transform(range(1, len(q.embedding) + 1),
                  lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE))
                          * (CAST(q.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)))) AS distance
  FROM q, corpus c WHERE {where})"""


def _topk_sql(k: int, where: str = "TRUE") -> str:
    return f"""WITH {_CORPUS}, {_dist(where)}
SELECT query_id, rank, id, round(distance, 6) AS distance FROM (
  SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
WHERE rank <= {k}"""


def _topk(spark, sf_dir, k, filters=None):
    r = rt.vector_topk(b.vector_queries(spark, sf_dir), b.vector_corpus(spark, sf_dir), k, filters=filters)
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")


@register("query_corpus_cross", f"""WITH {_CORPUS}, {_dist()}
SELECT query_id, id, round(distance, 6) AS distance FROM d""")
def q_query_corpus_cross(spark, sf_dir):
    """#36: every query vector against every candidate (broadcast queries, size-checked)."""
    return rt.query_corpus_cross(b.vector_queries(spark, sf_dir), b.vector_corpus(spark, sf_dir))


@register("vector_topk", _topk_sql(5))
def q_vector_topk(spark, sf_dir):
    """#61: exact 5 nearest by squared L2, ties on id."""
    return _topk(spark, sf_dir, 5)


@register("rank_per_query", _topk_sql(10))
def q_rank_per_query(spark, sf_dir):
    """#59: position 1..10 of each hit per query."""
    return _topk(spark, sf_dir, 10)


@register("filter_equal_all", _topk_sql(5, "c.ticker = 'T3' AND c.section = 'RISK_FACTORS'"))
def q_filter_equal_all(spark, sf_dir):
    """#25: two metadata keys ANDed before ranking."""
    return _topk(spark, sf_dir, 5, {"ticker": "T3", "section": "RISK_FACTORS"})


@register("filter_ticker", _topk_sql(5, "c.ticker = 'T1'"))
def q_filter_ticker(spark, sf_dir):
    """#26: query_by_ticker."""
    return _topk(spark, sf_dir, 5, {"ticker": "T1"})


@register("filter_section", _topk_sql(5, "c.section = 'MD&A'"))
def q_filter_section(spark, sf_dir):
    """#26: query_by_section."""
    return _topk(spark, sf_dir, 5, {"section": "MD&A"})


@register("filter_year_contains", f"""WITH {_CORPUS}
SELECT id, CAST(filing_date AS VARCHAR) AS filing_date FROM corpus
WHERE contains(CAST(filing_date AS VARCHAR), '{b.YEAR_FILTER}')""")
def q_filter_year_contains(spark, sf_dir):
    """#27: str(year) contained in the filing date."""
    c = rt.filter_year_contains(b.vector_corpus(spark, sf_dir), b.YEAR_FILTER)
    return c.select("id", F.col("filing_date").cast("string").alias("filing_date"))


@register("metadata_project", f"""WITH {_CORPUS}
SELECT id, ticker, filing_type, CAST(filing_date AS VARCHAR) AS filing_date, section, chunk_id FROM corpus""")
def q_metadata_project(spark, sf_dir):
    """#28: 5-key metadata, all text except chunk_id."""
    return rt.metadata_project(b.vector_corpus(spark, sf_dir))


@register("vector_topk_overfetch_year", f"""WITH {_CORPUS}, {_dist()},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r0 FROM d),
f AS (SELECT * FROM r WHERE r0 <= 15 AND contains(CAST(filing_date AS VARCHAR), '{b.YEAR_FILTER}'))
SELECT query_id, rank, id, round(distance, 6) AS distance FROM (
  SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM f)
WHERE rank <= 5""")
def q_vector_topk_overfetch_year(spark, sf_dir):
    """#62 parity mode: fetch 3k, keep the year, cut to k (may return fewer than k)."""
    r = rt.vector_topk_overfetch_year(b.vector_queries(spark, sf_dir), b.vector_corpus(spark, sf_dir), 5,
                                      year=b.YEAR_FILTER, overfetch=3)
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")


@register("vector_topk_prefilter_year", _topk_sql(5, f"contains(CAST(c.filing_date AS VARCHAR), '{b.YEAR_FILTER}')"))
def q_vector_topk_prefilter_year(spark, sf_dir):
    """#62 prefilter mode: year applied before ranking."""
    r = rt.vector_topk_overfetch_year(b.vector_queries(spark, sf_dir), b.vector_corpus(spark, sf_dir), 5,
                                      year=b.YEAR_FILTER, mode="prefilter")
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")


@register("vector_table_stats", f"""SELECT '{VECTOR_COLLECTION_NAME}' AS collection_name,
count(*) AS total_documents FROM embeddings""")
def q_vector_table_stats(spark, sf_dir):
    """#13: name and row count of the vector table."""
    from ..sources.tables import vector_table_stats

    return vector_table_stats(b.vector_corpus(spark, sf_dir))


# ------------------------------------------------------------------ keyword search
_WORDSET = f"list_distinct(list_filter(regexp_split_to_array(lower(text), '{WS_RUN}'), lambda x: x <> ''))"
_OVERLAP = f"""qw AS (SELECT item_id, {_WORDSET} AS w FROM benchmark),
dw AS (SELECT doc_id, {_WORDSET} AS w FROM documents),
ov AS (SELECT item_id, doc_id, CAST(len(list_intersect(qw.w, dw.w)) AS BIGINT) AS overlap FROM qw, dw),
kt AS (SELECT item_id AS query_id, doc_id, overlap,
              row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM ov)"""


def _bench_queries(spark, sf_dir):
    return b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _keyword(spark, sf_dir, k=5):
    return rt.keyword_topk(_bench_queries(spark, sf_dir), b.table(spark, sf_dir, "documents"), k)


@register("term_overlap_join", f"""WITH {_OVERLAP}
SELECT item_id AS query_id, doc_id, overlap FROM ov WHERE overlap > 0""")
def q_term_overlap_join(spark, sf_dir):
    """#37: shared distinct words per (benchmark item, document), via a term equi-join."""
    return rt.term_overlap(_bench_queries(spark, sf_dir), b.table(spark, sf_dir, "documents"))


@register("keyword_topk", f"""WITH {_OVERLAP}
SELECT query_id, rank, doc_id, overlap FROM kt WHERE rank <= 5""")
def q_keyword_topk(spark, sf_dir):
    """#63: top 5 by overlap, ties by input order, zero-overlap documents may fill."""
    return _keyword(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "overlap")


def _hits(spark, sf_dir):
    d = b.document_chunks_input(spark, sf_dir)
    return _keyword(spark, sf_dir).join(d, "doc_id")


_HITS = f"""WITH {_OVERLAP},
h AS (SELECT kt.query_id, kt.rank, d.source AS ticker, '10-K' AS filing_type,
             strftime(CAST(DATE '2019-01-01' + CAST(d.doc_id AS INTEGER) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS fdate,
             d.lang AS section, d.text
      FROM kt JOIN documents d USING (doc_id) WHERE kt.rank <= 5)"""


@register("format_context", _HITS + """
SELECT query_id, string_agg('[Source ' || rank || '] ' || ticker || ' - ' || filing_type || ' (' || fdate || ') - '
       || section || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
FROM h GROUP BY query_id""")
def q_format_context(spark, sf_dir):
    """#79: numbered source blocks joined by a blank line, in rank order."""
    return rt.format_context(_hits(spark, sf_dir))


@register("format_context_labeled", _HITS + """
SELECT query_id, string_agg('[Document ' || rank || ']' || chr(10) || 'Ticker: ' || ticker || chr(10) || 'Filing: '
       || filing_type || chr(10) || 'Date: ' || fdate || chr(10) || 'Section: ' || section || chr(10) || 'Content: '
       || text || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS context
FROM h GROUP BY query_id""")
def q_format_context_labeled(spark, sf_dir):
    """#80: labelled document blocks joined by ---."""
    return rt.format_context_labeled(_hits(spark, sf_dir))


def _sql_template(context: str, question: str) -> str:
    head, rest = QA_TEMPLATE.split("{context}")
    mid, tail = rest.split("{question}")
    lit = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"{lit(head)} || {context} || {lit(mid)} || {question} || {lit(tail)}"


@register("qa_prompt", _HITS + f""",
c AS (SELECT query_id, string_agg('[Source ' || rank || '] ' || ticker || ' - ' || filing_type || ' (' || fdate
       || ') - ' || section || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
      FROM h GROUP BY query_id)
SELECT c.query_id, {_sql_template('c.context', 'b.text')} AS prompt
FROM c JOIN benchmark b ON b.item_id = c.query_id""")
def q_qa_prompt(spark, sf_dir):
    """#81: the question template filled with the context and the question."""
    ctx = rt.format_context(_hits(spark, sf_dir))
    qs = _bench_queries(spark, sf_dir)
    return ctx.join(qs, "query_id").select("query_id", rt.qa_prompt(F.col("context"), F.col("text")).alias("prompt"))


@register("text_preview", """SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...'
ELSE text END AS preview FROM documents""")
def q_text_preview(spark, sf_dir):
    """#30: first 300 characters plus '...' when longer."""
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", rt.text_preview(F.col("text")).alias("preview"))
