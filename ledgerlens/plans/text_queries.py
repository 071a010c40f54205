"""Driver queries for document processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CHUNK_OVERLAP, CHUNK_SIZE, WS_CLASS, WS_RUN
from ..functions import text as tx
from ..operators import documents as dc
from . import bindings as b
from . import section_sql
from .registry import register

STEP = CHUNK_SIZE - CHUNK_OVERLAP
_WORDS = f"list_filter(regexp_split_to_array(text, '{WS_RUN}'), lambda x: x <> '')"
_STRIP = f"'^{WS_CLASS}+|{WS_CLASS}+$'"


# Named references the SQL oracle decodes (the ones the driver pages use, plus common ones);
# the flag says the ';' is required (names outside the legacy set).
_SQL_ENTITIES = [("nbsp", "\u00a0", False), ("lt", "<", False), ("gt", ">", False), ("quot", '"', False),
                 ("apos", "'", True), ("copy", "\u00a9", False), ("reg", "\u00ae", False),
                 ("middot", "\u00b7", False)]


def _sql_html(col: str) -> str:
    t = col
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<!DOCTYPE[^>]*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for name, char, semi in _SQL_ENTITIES:
        t = f"regexp_replace({t}, '&{name}{';' if semi else ';?'}', chr({ord(char)}), 'g')"
    t = f"regexp_replace({t}, '&amp;?', '&', 'g')"
    t = f"regexp_replace({t}, '{WS_RUN}', ' ', 'g')"
    return f"regexp_replace({t}, {_STRIP}, '', 'g')"


@register("whitespace_collapse", f"SELECT page_id, regexp_replace(html, '{WS_RUN}', ' ', 'g') AS text FROM pages")
def q_whitespace_collapse(spark, sf_dir):
    """#18: every run of Unicode whitespace becomes one space."""
    p = b.table(spark, sf_dir, "pages")
    return p.select("page_id", tx.collapse_ws(F.col("html")).alias("text"))


@register("html_to_text", f"SELECT page_id, {_sql_html('html')} AS text FROM pages")
def q_html_to_text(spark, sf_dir):
    """#16: script/style/comments dropped, tags to spaces, entities decoded, whitespace collapsed."""
    p = b.table(spark, sf_dir, "pages")
    return p.select("page_id", tx.html_to_text(F.col("html")).alias("text"))


def _nation_tables(spark, sf_dir):
    n = b.table(spark, sf_dir, "nation")
    r = b.table(spark, sf_dir, "region")
    t = n.join(r, n.n_regionkey == r.r_regionkey)
    html = F.concat(
        F.lit("<TABLE border=1><tr><th>Nation</th><th>Region</th></tr><tr><td> "), F.col("n_name"),
        F.lit(" </td><td><b>"), F.col("r_name"), F.lit("</b> &amp; co</td></tr><tr></tr></TABLE>"),
    )
    return t.select("n_nationkey", "n_name", html.alias("html"))


_SQL_TABLE = ("'Nation | Region' || chr(10) || n_name || ' | ' || r_name || '& co'")


@register("table_flatten", f"""SELECT n_nationkey, {_SQL_TABLE} AS text
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q_table_flatten(spark, sf_dir):
    """#17: each tr with cells -> cell texts joined ' | ' (inner tags joined without space); empty rows dropped."""
    t = _nation_tables(spark, sf_dir)
    return t.select("n_nationkey", tx.table_flatten(F.col("html")).alias("text"))


@register("html_tables", """SELECT n_nationkey,
  n_name || ' Nation | Region ' || n_name || ' | ' || r_name || '& co tail' AS text
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q_html_tables(spark, sf_dir):
    """#16 with tables: a table inside a page is replaced by its flattened rows."""
    t = _nation_tables(spark, sf_dir)
    page = F.concat(F.lit("<html><body><p>"), F.col("n_name"), F.lit("</p>"), F.col("html"),
                    F.lit("<p>tail</p></body></html>"))
    return t.select("n_nationkey", tx.html_to_text(page).alias("text"))


@register("chunk_words", f"""WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents)
SELECT doc_id, CAST(st // {STEP} AS INTEGER) AS chunk_id,
       array_to_string(list_slice(words, st + 1, st + {CHUNK_SIZE}), ' ') AS text
FROM (SELECT doc_id, words, unnest(range(0, len(words), {STEP})) AS st FROM w)""")
def q_chunk_words(spark, sf_dir):
    """#21: windows of 512 words every 412 words over whole documents."""
    d = tx.with_chunks(b.table(spark, sf_dir, "documents"), keep=["doc_id"])
    return d.select("doc_id", F.posexplode_outer("_chunks").alias("chunk_id", "text")).where(
        F.col("chunk_id").isNotNull()).select(
        "doc_id", F.col("chunk_id").cast("int").alias("chunk_id"), "text")


_CHUNK_DOCS = f"""WITH w AS (
  SELECT source AS ticker, '10-K' AS filing_type, DATE '2019-01-01' + CAST(doc_id AS INTEGER) AS filing_date,
         lang AS section, doc_id, {_WORDS} AS words FROM documents),
c AS (SELECT *, unnest(range(0, len(words), {STEP})) AS st, len(range(0, len(words), {STEP})) AS total FROM w)
"""


@register("chunk_documents", _CHUNK_DOCS + f"""
SELECT ticker, filing_type, filing_date, section, doc_id, CAST(st // {STEP} AS INTEGER) AS chunk_id,
       array_to_string(list_slice(words, st + 1, st + {CHUNK_SIZE}), ' ') AS text,
       CAST(st // {STEP} AS INTEGER) AS chunk_index, CAST(total AS INTEGER) AS total_chunks FROM c""")
def q_chunk_documents(spark, sf_dir):
    """#22: chunk rows with chunk_id, chunk_index and total_chunks (row-local, no shuffle)."""
    ch = dc.chunk_documents(b.document_chunks_input(spark, sf_dir))
    return ch.select("ticker", "filing_type", "filing_date", "section", "doc_id", "chunk_id", "text",
                     "metadata.chunk_index", "metadata.total_chunks")


@register("chunk_id_key", _CHUNK_DOCS + f"""
SELECT doc_id, CAST(st // {STEP} AS INTEGER) AS chunk_id,
       concat_ws('_', ticker, filing_type, strftime(CAST(filing_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S'), section,
                 CAST(st // {STEP} AS VARCHAR)) AS id FROM c""")
def q_chunk_id_key(spark, sf_dir):
    """#24: id ticker_type_date_section_chunk with the date rendered as a timestamp string."""
    ch = dc.chunk_documents(b.document_chunks_input(spark, sf_dir))
    return ch.select("doc_id", "chunk_id", dc.chunk_id_key(F.col("ticker"), F.col("filing_type"),
                                                          F.col("filing_date"), F.col("section"),
                                                          F.col("chunk_id")).alias("id"))


@register("drop_empty_results", f"""WITH w AS (SELECT source AS ticker, {_WORDS} AS words FROM documents)
SELECT ticker, count(*) AS n_docs, sum(len(range(0, len(words), {STEP}))) AS n_chunks
FROM w WHERE len(words) > 0 GROUP BY ticker""")
def q_drop_empty_results(spark, sf_dir):
    """#31: per-document chunk lists that are empty are skipped before concatenation."""
    d = tx.with_chunks(b.table(spark, sf_dir, "documents").withColumnRenamed("source", "ticker"),
                       out="chunks", keep=["ticker"])
    # Conditional aggregates instead of a filter: a filter on the derived array would be
    # pushed below the projection and re-evaluate the chunking inside the predicate.
    n = F.size("chunks")
    return d.groupBy("ticker").agg(F.count(F.when(n > 0, F.lit(1))).alias("n_docs"),
                                   F.sum(F.when(n > 0, n)).cast("long").alias("n_chunks")) \
        .where(F.col("n_docs") > 0)


def synthetic_sections(spark, sf_dir):
    f = b.synthetic_filings(spark, sf_dir)
    return dc.extract_sections(f.select("ticker", "filing_type", "filing_date", "file_path", "text"))


@register("section_extract", f"""WITH {section_sql.filings_sql()}, {section_sql.sections_sql()}
SELECT ticker, filing_type, filing_date, section, length(stext) AS text_length, md5(stext) AS text_md5
FROM kept""")
def q_section_extract(spark, sf_dir):
    """#19: sections cut from one synthetic filing per (source, doc block); checked in pytest."""
    s = synthetic_sections(spark, sf_dir)
    return s.select("ticker", "filing_type", "filing_date", "section", F.length("text").alias("text_length"),
                    F.md5("text").alias("text_md5"))


@register("parse_filing", f"""WITH {section_sql.filings_sql()}, {section_sql.sections_sql()}
SELECT ticker, filing_type, filing_date, section, file_path, length(stext) AS text_length, md5(stext) AS text_md5 FROM kept
WHERE length(regexp_replace(stext, {_STRIP}, '', 'g')) > 100""")
def q_parse_filing(spark, sf_dir):
    """#20: filing HTML -> text -> sections -> section rows with metadata."""
    f = b.synthetic_filings(spark, sf_dir)
    html = F.concat(F.lit("<html><body><p>"), F.col("text"), F.lit("</p></body></html>"))
    docs = dc.parse_filing(f.select("ticker", "filing_type", "filing_date", "file_path", html.alias("html")))
    return docs.select("ticker", "filing_type", "filing_date", "section", "metadata.file_path",
                       "metadata.text_length", F.md5("text").alias("text_md5"))


@register("process_filings", f"""WITH {section_sql.filings_sql()}, {section_sql.sections_sql()},
w AS (SELECT ticker, filing_type, filing_date, section, {_WORDS.replace('(text,', '(stext,')} AS words FROM kept
      WHERE length(regexp_replace(stext, {_STRIP}, '', 'g')) > 100),
c AS (SELECT *, unnest(range(0, len(words), {STEP})) AS st, len(range(0, len(words), {STEP})) AS total FROM w)
SELECT ticker, filing_type, filing_date, section, CAST(st // {STEP} AS INTEGER) AS chunk_id,
       CAST(total AS INTEGER) AS total_chunks,
       md5(array_to_string(list_slice(words, st + 1, st + {CHUNK_SIZE}), ' ')) AS chunk_md5, CAST(NULL AS VARCHAR) AS error FROM c""")
def q_process_filings(spark, sf_dir):
    """#23: whole filing table -> chunks in one plan."""
    f = b.synthetic_filings(spark, sf_dir)
    html = F.concat(F.lit("<html><body><p>"), F.col("text"), F.lit("</p></body></html>"))
    ch = dc.process_filings(f.select("ticker", "filing_type", "filing_date", "file_path", html.alias("html")))
    return ch.select("ticker", "filing_type", "filing_date", "section", "chunk_id", "metadata.total_chunks",
                     F.md5("text").alias("chunk_md5"), "error")
