"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, filter_audit, warc
from .common import table
from .decontaminate import overlaps
from .html_blocks import main_text
from .jaccard import jaccard_components
from .kneser_ney import score_documents
from .language import of_documents, of_pages
from .packing import pack_documents
from .quality import judged
from .repeats import remove_repeats
from .secret_scan import scan
from .secret_scan import train as train_secrets
from .toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("op10_ngram_jaccard", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
f AS (SELECT g FROM t GROUP BY g HAVING count(*) > 1),
c AS (SELECT t.doc_id, t.g FROM t JOIN f USING (g)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM c x JOIN c y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.sh) + len(y.sh) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, r.m AS component_id FROM s JOIN r ON r.a = s.doc_id
""")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op7_kneser_ney")
def kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@query("op8_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op6_bm25_packing")
def bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_spaced_seed_decontamination")
def spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train_secrets(docs))


@query("op4_weak_supervision_quality")
def weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query("op5_toxicity_grammar")
def toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = of_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select("doc_id", F.col("lang").alias("declared"), F.col("source").alias("host"), "language", "probability", "declared_probability", (~F.col("rejected")).alias("kept"))


@query("page_language")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on pages, which have markup and addresses."""
    return of_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "language", "probability", "declared_probability", (~F.col("rejected")).alias("kept"))


@query("op3_html_lstm")
def html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


@query("op12_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, {
        'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws),
        'C': 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text),
        'D': regexp_matches(d.text, '[#$%&*|]'), 'E': coalesce(d.doc_id > m.first, false)} AS x
      FROM d JOIN m USING (text) LEFT JOIN l ON l.doc_id = d.doc_id),
v AS (SELECT part, good, toxic, (CASE WHEN x['A'] THEN 'A' ELSE '' END) || (CASE WHEN x['B'] THEN 'B' ELSE '' END) || (CASE WHEN x['C'] THEN 'C' ELSE '' END)
        || (CASE WHEN x['D'] THEN 'D' ELSE '' END) || (CASE WHEN x['E'] THEN 'E' ELSE '' END) AS fails FROM f),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM v GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
p AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a, k b, k c, k d, k e
      WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
      FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own,
        sum(CASE WHEN translate(fails, before || own, '') = fails THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
""")
def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
o AS (SELECT i, lang, source, unnest(ws) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
k AS (SELECT lang, term, count(DISTINCT i) AS df FROM o GROUP BY ALL HAVING df >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT t.lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY t.lang, source) + v) AS HUGEINT) AS p FROM t JOIN v USING (lang)),
w AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL),
q AS (SELECT w.lang, term, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY w.lang) + v) AS HUGEINT) AS q FROM w JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL
      SELECT p.lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM s WHERE part = 'pair' OR rank <= 200
""")
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_warc", r"""
WITH d AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM d GROUP BY html),
x AS (SELECT page_id, html, first, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
        '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', substr(sha1(html), i, 1))]), '') AS bits FROM d JOIN f USING (html))
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INT)
    + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM x
""")
def warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select(F.col("capture_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to.capture_id").cast("long").alias("refers_to"))
