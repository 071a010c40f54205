"""Driver queries for evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import evaluation as ev
from ..operators import retrieval as rt
from ..operators import stats
from . import bindings as b
from .registry import register
from ..session import materialize

KEY = ["conv_id", "turn"]
_LEX = b.FIXTURE_POSITIVE + b.FIXTURE_NEGATIVE
_LEX_SQL = "[" + ", ".join(f"'{w}'" for w in _LEX) + "]"
_POS_SQL = "[" + ", ".join(f"'{w}'" for w in b.FIXTURE_POSITIVE) + "]"
_NEG_SQL = "[" + ", ".join(f"'{w}'" for w in b.FIXTURE_NEGATIVE) + "]"

_PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS reference, a.text AS prediction
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def _grams(col: str, n: int) -> str:
    t = f"regexp_extract_all(lower({col}), '[a-z0-9]+')"
    if n == 1:
        return t
    return f"list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string(list_slice({t}, i, i + {n - 1}), ' '))"


def _rouge_sql(n: int, where: str = "TRUE") -> str:
    return f"""tok{n} AS (SELECT conv_id, turn, {_grams('reference', n)} AS gr, {_grams('prediction', n)} AS gh
  FROM pairs WHERE {where}),
x{n} AS (SELECT conv_id, turn, unnest(gr) AS g, 1 AS cr, 0 AS ch FROM tok{n}
      UNION ALL SELECT conv_id, turn, unnest(gh) AS g, 0 AS cr, 1 AS ch FROM tok{n}),
c{n} AS (SELECT conv_id, turn, g, sum(cr) AS cr, sum(ch) AS ch FROM x{n} GROUP BY ALL),
m{n} AS (SELECT conv_id, turn, sum(least(cr, ch)) AS m FROM c{n} GROUP BY ALL),
r{n} AS (SELECT t.conv_id, t.turn, CASE WHEN len(gr) + len(gh) = 0 THEN 0.0
          ELSE 2.0 * coalesce(m.m, 0) / (len(gr) + len(gh)) END AS rouge{n}
  FROM tok{n} t LEFT JOIN m{n} m USING (conv_id, turn))"""


def _pairs(spark, sf_dir):
    return b.conversation_pairs(spark, sf_dir)


@register("pair_zip", f"WITH {_PAIRS} SELECT conv_id, turn, reference, prediction FROM pairs")
def q_pair_zip(spark, sf_dir):
    """#38: user turn aligned with the next assistant turn on an explicit pair key."""
    return _pairs(spark, sf_dir).select(*KEY, "reference", "prediction")


@register("rouge_n", f"""WITH {_PAIRS}, {_rouge_sql(1)}, {_rouge_sql(2)}
SELECT conv_id, turn, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM r1 JOIN r2 USING (conv_id, turn)""")
def q_rouge_n(spark, sf_dir):
    """#41: ROUGE-1 and ROUGE-2 F per pair (relational n-gram counts, no stemming)."""
    p = _pairs(spark, sf_dir)
    return ev.rouge_scores(p, key=KEY, lcs=False)


_LCS_SQL = """t AS (SELECT conv_id, turn, regexp_extract_all(lower(reference), '[a-z0-9]+') AS r, regexp_extract_all(lower(prediction), '[a-z0-9]+') AS h
      FROM pairs),
-- one row of the table of common subsequences per step: f[j + 1] for the first j tokens of the prediction
lcs(conv_id, turn, i, f) AS (
  SELECT conv_id, turn, 0, list_transform(range(len(h) + 1), lambda x: 0::BIGINT) FROM t
  UNION ALL
  SELECT lcs.conv_id, lcs.turn, i + 1, list_reduce(
    list_prepend([0::BIGINT], list_transform(range(1, len(t.h) + 1), lambda j: [j])),
    lambda a, x: list_append(a, greatest(a[-1], CASE WHEN t.h[x[1]] = t.r[lcs.i + 1] THEN lcs.f[x[1]] + 1 ELSE lcs.f[x[1] + 1] END)))
  FROM lcs JOIN t USING (conv_id, turn) WHERE i < len(t.r)),
rl AS (SELECT t.conv_id, t.turn, CASE WHEN f[-1] = 0 THEN 0.0 ELSE 2.0 * f[-1] / (len(r) + len(h)) END AS "rougeL"
FROM lcs JOIN t USING (conv_id, turn) WHERE i = len(r))"""


@register("rouge_l", f"""WITH RECURSIVE {_PAIRS}, {_LCS_SQL}
SELECT conv_id, turn, round("rougeL", 6) AS "rougeL" FROM rl""")
def q_rouge_l(spark, sf_dir):
    """#42: ROUGE-L F per pair (LCS in an Arrow UDF); checked in pytest."""
    return ev.rouge_l(_pairs(spark, sf_dir), key=KEY)


_ENT = f"""ent AS (SELECT conv_id, turn,
  list_filter({_LEX_SQL}, lambda w: contains(lower(prediction), w)) AS p,
  list_filter({_LEX_SQL}, lambda w: contains(lower(reference), w)) AS t FROM pairs),
prf0 AS (SELECT conv_id, turn, len(p) AS np, len(t) AS nt, len(list_intersect(p, t)) AS tp FROM ent),
prf1 AS (SELECT conv_id, turn, np, nt,
  CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS pr, CASE WHEN nt > 0 THEN tp / nt ELSE 0.0 END AS rc FROM prf0),
prf AS (SELECT conv_id, turn,
  CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 THEN 0.0 ELSE pr END AS precision,
  CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 THEN 0.0 ELSE rc END AS recall,
  CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 THEN 0.0 WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc)
       ELSE 0.0 END AS f1 FROM prf1)"""


@register("rouge_stemmed")
def q_rouge_stemmed(spark, sf_dir):
    """#41/#42 with Porter stemming (the reference scorer's setting); checked in pytest."""
    p = _pairs(spark, sf_dir)
    return ev.rouge_scores(p, key=KEY, stem=True)


@register("entity_prf", f"""WITH {_PAIRS}, {_ENT}
SELECT conv_id, turn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf""")
def q_entity_prf(spark, sf_dir):
    """#43: per-pair entity precision/recall/F1 with the fixture lexicon (both empty -> 1)."""
    return ev.entity_prf(_pairs(spark, sf_dir), key=KEY, lexicon=_LEX)


@register("macro_mean", f"""WITH {_PAIRS}, {_ENT}, {_rouge_sql(1)}
SELECT round(avg(f1), 6) AS entity_f1, round(avg(precision), 6) AS entity_precision,
       round(avg(recall), 6) AS entity_recall, round((SELECT avg(rouge1) FROM r1), 6) AS rouge1 FROM prf""")
def q_macro_mean(spark, sf_dir):
    """#40: unweighted means of per-pair scores."""
    p = _pairs(spark, sf_dir)
    e = ev.entity_prf(p, key=KEY, lexicon=_LEX).agg(
        stats.macro_mean(F.col("f1")).alias("entity_f1"), stats.macro_mean(F.col("precision")).alias("entity_precision"),
        stats.macro_mean(F.col("recall")).alias("entity_recall"))
    r = ev.rouge_n(p, 1, key=KEY).agg(stats.macro_mean(F.col("rouge1")).alias("rouge1"))
    return e.withColumn("_one", F.lit(1)).join(r.withColumn("_one", F.lit(1)), "_one").drop("_one")


@register("array_set_intersect", f"""WITH {_PAIRS}, {_ENT}
SELECT conv_id, turn, list_sort(list_intersect(p, t)) AS common FROM ent""")
def q_array_set_intersect(spark, sf_dir):
    """#69: set intersection of found entities per pair."""
    p = _pairs(spark, sf_dir)
    return p.select(*KEY, F.array_sort(F.array_intersect(lx.entity_extract(F.col("prediction"), _LEX),
                                                         lx.entity_extract(F.col("reference"), _LEX))).alias("common"))


_CBA_SQL = f"""{_PAIRS}, {_ENT}, {_rouge_sql(1)}, {_rouge_sql(2)},
s AS (SELECT p.conv_id % 2 AS half, r1.rouge1, r2.rouge2, prf.f1
      FROM pairs p JOIN r1 USING (conv_id, turn) JOIN r2 USING (conv_id, turn) JOIN prf USING (conv_id, turn)),
l AS (SELECT half, 'rouge1' AS metric, avg(rouge1) AS v FROM s GROUP BY 1 UNION ALL
      SELECT half, 'rouge2', avg(rouge2) FROM s GROUP BY 1 UNION ALL SELECT half, 'entity_f1', avg(f1) FROM s GROUP BY 1),
cba AS (SELECT b.metric, b.v AS before, a.v AS after, a.v - b.v AS delta,
               CASE WHEN b.v > 0 THEN (a.v - b.v) / b.v * 100 ELSE 0.0 END AS pct_change
        FROM l b JOIN l a ON a.metric = b.metric AND b.half = 0 AND a.half = 1)"""


@register("compare_before_after", f"""WITH {_PAIRS}, {_ENT}, {_rouge_sql(1)}, {_rouge_sql(2)},
s AS (SELECT p.conv_id % 2 AS half, r1.rouge1, r2.rouge2, prf.f1
      FROM pairs p JOIN r1 USING (conv_id, turn) JOIN r2 USING (conv_id, turn) JOIN prf USING (conv_id, turn)),
l AS (SELECT half, 'rouge1' AS metric, avg(rouge1) AS v FROM s GROUP BY 1 UNION ALL
      SELECT half, 'rouge2', avg(rouge2) FROM s GROUP BY 1 UNION ALL SELECT half, 'entity_f1', avg(f1) FROM s GROUP BY 1)
SELECT b.metric, round(b.v, 6) AS before, round(a.v, 6) AS after, round(a.v - b.v, 6) AS delta,
       round(CASE WHEN b.v > 0 THEN (a.v - b.v) / b.v * 100 ELSE 0.0 END, 6) AS pct_change
FROM l b JOIN l a ON a.metric = b.metric AND b.half = 0 AND a.half = 1""")
def q_compare_before_after(spark, sf_dir):
    """#55: metrics of two halves of the pairs (even / odd conversations) before vs after."""
    p = _pairs(spark, sf_dir)
    s = ev.rouge_scores(p, key=KEY, lcs=False).join(ev.entity_prf(p, key=KEY, lexicon=_LEX).select(*KEY, "f1"), KEY)
    # the pairs are scored once: the written means (one row per half) serve both sides
    halves = materialize(s.groupBy((F.col("conv_id") % 2).alias("half")).agg(
        F.avg("rouge1").alias("rouge1"), F.avg("rouge2").alias("rouge2"), F.avg("f1").alias("entity_f1")))

    def side(h):
        return ev.long_metrics(halves.where(F.col("half") == h), ["rouge1", "rouge2", "entity_f1"])

    return ev.compare_before_after(side(0), side(1))


@register("substantive_answer_flag", """SELECT conv_id, turn,
  length(text) > 100 AND NOT contains(substr(lower(text), 1, 50), 'context') AS substantive
FROM conversations WHERE role = 'assistant'""")
def q_substantive_answer_flag(spark, sf_dir):
    """#29: long enough and no 'context' in the first 50 lower-cased characters."""
    c = b.table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return c.select(*KEY, lx.substantive_answer(F.col("text")).alias("substantive"))


# ------------------------------------------------------------------ lexicons
_SENT = f"""sent AS (SELECT doc_id, n_chars,
  len(list_filter({_POS_SQL}, lambda w: contains(lower(text), w))) AS p,
  len(list_filter({_NEG_SQL}, lambda w: contains(lower(text), w))) AS n FROM documents),
sc AS (SELECT doc_id, n_chars, CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / (p + n) END AS score FROM sent)"""


def _scores(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", "n_chars", lx.sentiment_score(F.col("text"), b.FIXTURE_POSITIVE,
                                                            b.FIXTURE_NEGATIVE).alias("score"))


@register("sentiment_score", f"WITH {_SENT} SELECT doc_id, round(score, 6) AS score FROM sc")
def q_sentiment_score(spark, sf_dir):
    """#70: (p - n) / (p + n) over fixture lexicon words contained in each document."""
    return _scores(spark, sf_dir).select("doc_id", "score")


@register("entity_extract", f"""SELECT doc_id, list_filter({_LEX_SQL}, lambda w: contains(lower(text), w)) AS entities
FROM documents""")
def q_entity_extract(spark, sf_dir):
    """#72: lexicon terms contained in each document, in lexicon order."""
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", lx.entity_extract(F.col("text"), _LEX).alias("entities"))


_NUM_TEXT = "'$' || printf('%.2f', l_extendedprice) || ' revenue up ' || printf('%.2f', l_discount * 100) || '%'"


@register("numeric_entities", f"""SELECT l_orderkey, l_linenumber, list_concat(list_concat(
  regexp_extract_all({_NUM_TEXT}, '(?i)\\$[\\d,]+\\.?\\d*[MBK]?'),
  regexp_extract_all({_NUM_TEXT}, '(?i)\\d+\\.?\\d*%')),
  regexp_extract_all({_NUM_TEXT}, '(?i)\\d+\\.?\\d*[MBK]?\\s*(?:dollars|revenue|earnings|profit)')) AS entities
FROM lineitem""")
def q_numeric_entities(spark, sf_dir):
    """#73: money, percent and amount-noun patterns over text built from lineitem."""
    li = b.table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("$"), F.format_string("%.2f", "l_extendedprice"), F.lit(" revenue up "),
                    F.format_string("%.2f", F.col("l_discount") * 100), F.lit("%"))
    return li.select("l_orderkey", "l_linenumber", lx.numeric_entities(text).alias("entities"))


# ------------------------------------------------------------------ correlation
_EVK = "ek AS (SELECT value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"


def _ev_k(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    return e.select("value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def _avg_rank(col: str, tbl: str) -> str:
    return (f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)")


@register("pearson", f"WITH {_EVK} SELECT count(*) AS n, round(corr(value, k), 6) AS r FROM ek")
def q_pearson(spark, sf_dir):
    """#47: Pearson r of events value against props.k (guarded against constant input)."""
    return stats.pearson(_ev_k(spark, sf_dir), "value", "k")


@register("spearman", f"""WITH {_EVK}, rk AS (SELECT {_avg_rank('value', 'ek')} AS rx, {_avg_rank('k', 'ek')} AS ry FROM ek)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS r FROM rk""")
def q_spearman(spark, sf_dir):
    """#48: Spearman r with average ranks for ties (range-partitioned ranks, no single-partition window)."""
    return stats.spearman(_ev_k(spark, sf_dir), "value", "k")


def _p_value_sql(source: str) -> str:
    """Two-sided p of (n, r) rows: the regularised incomplete beta function by 500 steps of its continued fraction."""
    odd = "(e[1] * (q - e[1]) * x / ((p - 1 + 2 * e[1]) * (p + 2 * e[1])))"
    even = "(-(p + e[1]) * (p + q + e[1]) * x / ((p + 2 * e[1]) * (p + 1 + 2 * e[1])))"
    c1, d1 = f"(1 + {odd} / s[1])", f"(1 / (1 + {odd} * s[2]))"
    c2, d2 = f"(1 + {even} / {c1})", f"(1 / (1 + {even} * {d1}))"
    return f"""pv AS (SELECT n, r, (n - 2) / 2.0 AS a, CAST(0.5 AS DOUBLE) AS b, 1 - r * r AS x0 FROM {source}),
pw AS (SELECT *, x0 < (a + 1) / (a + b + 2) AS direct FROM pv),
px AS (SELECT *, CASE WHEN direct THEN a ELSE b END AS p, CASE WHEN direct THEN b ELSE a END AS q,
              CASE WHEN direct THEN x0 ELSE 1 - x0 END AS x FROM pw),
pf AS (SELECT *, list_reduce(list_prepend([1.0::DOUBLE, 1 / (1 - (p + q) * x / (p + 1)), 1 / (1 - (p + q) * x / (p + 1))],
         list_transform(range(1, 500), lambda m: [m::DOUBLE, 0, 0])),
         lambda s, e: [{c2}, {d2}, s[3] * {d1} * {c1} * {d2} * {c2}])[3]
         * exp(lgamma(a + b) - lgamma(a) - lgamma(b) + p * ln(x) + q * ln(1 - x)) / p AS part FROM px)
SELECT n, round(r, 6) AS r, round(CASE WHEN direct THEN part ELSE 1 - part END, 6) AS p_value FROM pf"""


@register("pearson_p_value", f"WITH {_EVK}, rn AS (SELECT count(*) AS n, corr(value, k) AS r FROM ek), {_p_value_sql('rn')}")
def q_pearson_p_value(spark, sf_dir):
    """#47: two-sided p-value of r (t distribution, n - 2 df)."""
    return stats.with_p_value(stats.pearson(_ev_k(spark, sf_dir), "value", "k"))


@register("spearman_p_value", f"""WITH {_EVK}, rk AS (SELECT {_avg_rank('value', 'ek')} AS rx, {_avg_rank('k', 'ek')} AS ry FROM ek),
rn AS (SELECT count(*) AS n, corr(rx, ry) AS r FROM rk), {_p_value_sql('rn')}""")
def q_spearman_p_value(spark, sf_dir):
    """#48: two-sided p-value of the Spearman r."""
    return stats.with_p_value(stats.spearman(_ev_k(spark, sf_dir), "value", "k"))


@register("sentiment_price_correlation", f"""WITH {_SENT},
rk AS (SELECT score, n_chars, {_avg_rank('score', 'sc')} AS rx, {_avg_rank('n_chars', 'sc')} AS ry FROM sc)
SELECT count(*) AS n, round(corr(score, n_chars), 6) AS pearson_r, round(corr(rx, ry), 6) AS spearman_r FROM rk""")
def q_sentiment_price_correlation(spark, sf_dir):
    """#71: sentiment of documents against n_chars: Pearson and Spearman r."""
    # One row per document, read by four branches: written once instead of re-scoring the texts.
    s = materialize(_scores(spark, sf_dir))
    p = stats.pearson(s, "score", "n_chars").withColumnRenamed("r", "pearson_r")
    sp = stats.spearman(s, "score", "n_chars").select(F.col("r").alias("spearman_r"))
    return p.withColumn("_one", F.lit(1)).join(sp.withColumn("_one", F.lit(1)), "_one").drop("_one")


# ------------------------------------------------------------------ timing
@register("time_reduction", f"""WITH m AS (SELECT event_type, avg(value) AS t FROM events GROUP BY 1)
SELECT round(s.t, 6) AS llm_avg_time, round(bl.t, 6) AS baseline_avg_time,
       round((bl.t - s.t) / bl.t * 100, 6) AS time_reduction_pct
FROM m s JOIN m bl ON s.event_type = '{b.TIME_SYSTEM}' AND bl.event_type = '{b.TIME_BASELINE}'""")
def q_time_reduction(spark, sf_dir):
    """#49: mean time per method and the percent reduction of the system against the baseline."""
    e = b.table(spark, sf_dir, "events")
    return ev.time_reduction(e, method="event_type", time="value", system=b.TIME_SYSTEM, baseline=b.TIME_BASELINE)


@register("query_stats", f"""WITH {_EVK}
SELECT round(avg(value), 6) AS avg_query_time_s, round(min(value), 6) AS min_query_time_s,
       round(max(value), 6) AS max_query_time_s, round(avg(k), 6) AS avg_docs_retrieved FROM ek""")
def q_query_stats(spark, sf_dir):
    """#50: avg / min / max time and mean documents retrieved (time = value, documents = props.k)."""
    return ev.query_stats(_ev_k(spark, sf_dir), time="value", docs="k")


# ------------------------------------------------------------------ retrieval metrics
_REL = """rel AS (SELECT bm.item_id AS query_id, d.doc_id FROM benchmark bm JOIN documents d ON contains(d.text, bm.text))"""


def _rel(spark, sf_dir):
    return rt.containment_pairs(b.table(spark, sf_dir, "benchmark"), b.table(spark, sf_dir, "documents")) \
        .withColumnRenamed("item_id", "query_id")


def _bq(spark, sf_dir):
    return b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _kw(spark, sf_dir):
    return rt.keyword_topk(_bq(spark, sf_dir), b.table(spark, sf_dir, "documents"), 5)


def _kw_sql() -> str:
    from .retrieval_queries import _OVERLAP

    return _OVERLAP


@register("containment_truth", f"WITH {_REL} SELECT query_id, doc_id FROM rel")
def q_containment_truth(spark, sf_dir):
    """Relevance truth: documents containing the benchmark item text (exact, no all-pairs join)."""
    return _rel(spark, sf_dir)


@register("precision_at_k", f"""WITH {_kw_sql()}, {_REL},
tp AS (SELECT kt.query_id, count(*) AS tp FROM kt JOIN rel USING (query_id, doc_id) WHERE kt.rank <= 5 GROUP BY 1)
SELECT bm.item_id AS query_id, round(coalesce(tp.tp, 0) / 5.0, 6) AS precision
FROM benchmark bm LEFT JOIN tp ON tp.query_id = bm.item_id""")
def q_precision_at_k(spark, sf_dir):
    """#44: |top 5 & relevant| / 5 per query (keyword top-5 against containment truth)."""
    return ev.precision_at_k(_bq(spark, sf_dir), _kw(spark, sf_dir), _rel(spark, sf_dir), 5)


@register("recall_at_k", f"""WITH {_kw_sql()}, {_REL},
tp AS (SELECT kt.query_id, count(*) AS tp FROM kt JOIN rel USING (query_id, doc_id) WHERE kt.rank <= 5 GROUP BY 1),
nr AS (SELECT query_id, count(*) AS nr FROM rel GROUP BY 1)
SELECT bm.item_id AS query_id, round(CASE WHEN coalesce(nr.nr, 0) > 0 THEN coalesce(tp.tp, 0) / nr.nr ELSE 0.0 END, 6)
       AS recall
FROM benchmark bm LEFT JOIN tp ON tp.query_id = bm.item_id LEFT JOIN nr ON nr.query_id = bm.item_id""")
def q_recall_at_k(spark, sf_dir):
    """#45: |top 5 & relevant| / |relevant| per query; no relevant documents gives 0."""
    return ev.recall_at_k(_bq(spark, sf_dir), _kw(spark, sf_dir), _rel(spark, sf_dir), 5)


@register("mrr", f"""WITH {_kw_sql()}, {_REL},
fr AS (SELECT kt.query_id, min(kt.rank) AS r FROM kt JOIN rel USING (query_id, doc_id) WHERE kt.rank <= 5 GROUP BY 1)
SELECT round(avg(CASE WHEN coalesce(fr.r, 0) > 0 THEN 1.0 / fr.r ELSE 0.0 END), 6) AS mrr
FROM benchmark bm LEFT JOIN fr ON fr.query_id = bm.item_id""")
def q_mrr(spark, sf_dir):
    """#46: mean reciprocal rank of the first relevant hit in the keyword top 5 (0 when none)."""
    ranks = ev.first_relevant_rank(_bq(spark, sf_dir), _kw(spark, sf_dir), _rel(spark, sf_dir))
    return ev.mrr(ranks)


@register("compare_retrieval", f"""WITH {_kw_sql()}, {_REL},
ln AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
sys AS (SELECT bm.item_id AS query_id, ln.doc_id, ln.rank FROM benchmark bm, ln WHERE ln.rank <= 5),
nr AS (SELECT query_id, count(*) AS nr FROM rel GROUP BY 1),
m AS (SELECT bm.item_id AS query_id,
  (SELECT count(*) FROM sys JOIN rel USING (query_id, doc_id) WHERE sys.query_id = bm.item_id) AS tps,
  (SELECT count(*) FROM kt JOIN rel USING (query_id, doc_id) WHERE kt.query_id = bm.item_id AND kt.rank <= 5) AS tpk,
  coalesce((SELECT nr FROM nr WHERE nr.query_id = bm.item_id), 0) AS nr FROM benchmark bm)
SELECT round(avg(tps / 5.0), 6) AS system_precision,
       round(avg(CASE WHEN nr > 0 THEN tps / nr ELSE 0.0 END), 6) AS system_recall,
       round(avg(tpk / 5.0), 6) AS baseline_precision,
       round(avg(CASE WHEN nr > 0 THEN tpk / nr ELSE 0.0 END), 6) AS baseline_recall,
       round(avg(tps / 5.0) - avg(tpk / 5.0), 6) AS precision_diff,
       round(avg(CASE WHEN nr > 0 THEN tps / nr ELSE 0.0 END) - avg(CASE WHEN nr > 0 THEN tpk / nr ELSE 0.0 END), 6)
       AS recall_diff
FROM m""")
def q_compare_retrieval(spark, sf_dir):
    """#54: precision@5 / recall@5 of a length-ranked system against the keyword baseline."""
    docs = b.table(spark, sf_dir, "documents")
    # rank of each of the 5 longest documents, as a bounded scalar array
    ranked = docs.orderBy(F.col("n_chars").desc(), F.col("doc_id")).limit(5) \
        .select(F.collect_list(F.struct(F.col("n_chars"), F.col("doc_id"))).alias("a"))
    arr = ranked.select(F.transform(F.array_sort(F.col("a"), lambda x, y: F.when(x["n_chars"] > y["n_chars"], -1)
                                                 .when(x["n_chars"] < y["n_chars"], 1)
                                                 .when(x["doc_id"] < y["doc_id"], -1).otherwise(1)),
                                    lambda x, i: F.struct(x["doc_id"].alias("doc_id"), (i + 1).alias("rank")))).scalar()
    sysr = _bq(spark, sf_dir).select("query_id", F.explode(arr).alias("_h")).select(
        "query_id", "_h.doc_id", "_h.rank")
    return ev.compare_retrieval(_bq(spark, sf_dir), sysr, _kw(spark, sf_dir), _rel(spark, sf_dir), 5)


@register("union_all", f"""WITH {_kw_sql()}
SELECT query_id, doc_id, overlap FROM kt WHERE rank <= 5""")
def q_union_all(spark, sf_dir):
    """#68: per-question results concatenated (even and odd items searched separately, then united)."""
    q = _bq(spark, sf_dir)
    d = b.table(spark, sf_dir, "documents")
    parts = [rt.keyword_topk(q.where(F.col("query_id") % 2 == h), d, 5) for h in (0, 1)]
    return parts[0].unionByName(parts[1]).select("query_id", "doc_id", "overlap")
