"""Scoring of answers and retrieval: ROUGE, entity P/R/F, ranking metrics, timing summaries.

A pair's ROUGE scores depend on its two texts alone: one Arrow function per row computes all of them from
the projected tokens, with no explode, shuffle or join.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import TIME_BASELINE_METHOD, TIME_SYSTEM_METHOD
from ..functions.lexicon import entity_extract

_TOKEN = "[a-z0-9]+"


def rouge_tokens(text: Column, stem: bool = False) -> Column:
    """Lower-cased ``[a-z0-9]+`` runs (the ROUGE tokenizer); ``stem`` Porter-stems tokens over 3 characters."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), 0)
    if stem:
        from ..functions.stem import stem_tokens

        return stem_tokens(toks)
    return toks


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array (empty when there are fewer than n tokens)."""
    if n == 1:
        return tokens
    count = F.size(tokens) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


def pair_zip(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Align two lists by an explicit pair key (inner join)."""
    return left.join(right, key, "inner")


def unmatched_pairs(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys present on one side only, with the side named (what positional zipping would hide)."""
    lk, rk = left.select(*key), right.select(*key)
    return lk.join(rk, key, "left_anti").withColumn("side", F.lit("left")).unionByName(
        rk.join(lk, key, "left_anti").withColumn("side", F.lit("right")))


def _f_measure(common: int, sizes: int) -> float:
    return 2.0 * common / sizes if common else 0.0


def _ngram_overlap(ref: list[str], pred: list[str], n: int) -> float:
    """F-measure of the clipped common n-grams."""
    r, h = (Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in (ref, pred))
    return _f_measure(sum((r & h).values()), sum(r.values()) + sum(h.values()))


def rouge_scores(pairs: DataFrame, *, key: list[str], ns: tuple[int, ...] = (1, 2), lcs: bool = True, prediction: str = "prediction",
                 reference: str = "reference", stem: bool = False) -> DataFrame:
    """Per pair ``rouge{n}`` for each n and, with ``lcs``, ``rougeL``: F-measures, 0 where nothing is common.

    ``stem=True`` reproduces the reference scorer, which stems tokens of more than three characters.
    """
    names = [f"rouge{n}" for n in ns] + (["rougeL"] if lcs else [])

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def score(refs: pd.Series, preds: pd.Series) -> pd.DataFrame:
        from ..functions.stem import stem_token

        out = []
        for r, h in zip(refs, preds, strict=True):
            r, h = ([stem_token(t) for t in x] if stem else list(x) for x in (r, h))
            row = [_ngram_overlap(r, h, n) for n in ns]
            out.append(row + ([_f_measure(lcs_length(r, h), len(r) + len(h))] if lcs else []))
        return pd.DataFrame(out, columns=names, dtype="float64")

    toks = pairs.select(*key, rouge_tokens(F.col(reference)).alias("_r"), rouge_tokens(F.col(prediction)).alias("_h"))
    return toks.select(*key, score("_r", "_h").alias("_s")).select(*key, "_s.*")


def rouge_n(pairs: DataFrame, n: int, *, key: list[str], prediction: str = "prediction",
            reference: str = "reference", stem: bool = False) -> DataFrame:
    """Per pair ROUGE-n F-measure ``rouge{n}`` = 2 * overlap / (ref n-grams + pred n-grams)."""
    return rouge_scores(pairs, key=key, ns=(n,), lcs=False, prediction=prediction, reference=reference, stem=stem)


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence length, bit-parallel over Python integers."""
    if not a or not b:
        return 0
    if len(b) > len(a):
        a, b = b, a
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        m = masks.get(tok)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def rouge_l(pairs: DataFrame, *, key: list[str], prediction: str = "prediction",
            reference: str = "reference", stem: bool = False) -> DataFrame:
    """Per pair ROUGE-L F-measure (longest common subsequence of tokens)."""
    return rouge_scores(pairs, key=key, ns=(), prediction=prediction, reference=reference, stem=stem)


def entity_prf(pairs: DataFrame, *, key: list[str], lexicon: list[str] | None = None,
               prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Per pair entity precision / recall / F1 over lexicon-term sets.

    Both empty -> 1/1/1; prediction empty -> 0/0/0; otherwise set overlap (an
    empty truth then gives precision 0 and F1 0).
    """
    p = F.array_distinct(entity_extract(F.col(prediction), lexicon))
    t = F.array_distinct(entity_extract(F.col(reference), lexicon))
    base = pairs.select(*key, p.alias("_p"), t.alias("_t"))
    tp = F.size(F.array_intersect("_p", "_t")).cast("double")
    np_, nt = F.size("_p").cast("double"), F.size("_t").cast("double")
    prec = F.when(np_ > 0, tp / np_).otherwise(F.lit(0.0))
    rec = F.when(nt > 0, tp / nt).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    both_empty = (np_ == 0) & (nt == 0)
    pred_empty = np_ == 0
    return base.select(
        *key,
        F.when(both_empty, 1.0).when(pred_empty, 0.0).otherwise(prec).alias("precision"),
        F.when(both_empty, 1.0).when(pred_empty, 0.0).otherwise(rec).alias("recall"),
        F.when(both_empty, 1.0).when(pred_empty, 0.0).otherwise(f1).alias("f1"),
    )


# ------------------------------------------------------------------ ranking metrics
def _hits_at_k(retrieved: DataFrame, relevant: DataFrame, k: int, query_id: str, doc_id: str,
               rank: str) -> DataFrame:
    top = retrieved.where(F.col(rank) <= k).select(query_id, doc_id).distinct()
    return top.join(relevant.select(query_id, doc_id).distinct(), [query_id, doc_id], "inner") \
        .groupBy(query_id).agg(F.count(F.lit(1)).alias("_tp"))


def precision_at_k(queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int = 5, *,
                   query_id: str = "query_id", doc_id: str = "doc_id", rank: str = "rank") -> DataFrame:
    """Per query |set(top k) & relevant| / k (k <= 0 gives 0)."""
    tp = _hits_at_k(retrieved, relevant, k, query_id, doc_id, rank)
    q = queries.select(query_id).distinct().join(tp, query_id, "left").fillna(0, ["_tp"])
    val = F.col("_tp") / F.lit(float(k)) if k > 0 else F.lit(0.0)
    return q.select(query_id, val.cast("double").alias("precision"))


def recall_at_k(queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int = 5, *,
                query_id: str = "query_id", doc_id: str = "doc_id", rank: str = "rank") -> DataFrame:
    """Per query |set(top k) & relevant| / |set(relevant)| (no relevant documents gives 0)."""
    tp = _hits_at_k(retrieved, relevant, k, query_id, doc_id, rank) if k > 0 else \
        retrieved.limit(0).select(query_id, F.lit(0).alias("_tp"))
    nrel = relevant.select(query_id, doc_id).distinct().groupBy(query_id).agg(F.count(F.lit(1)).alias("_nr"))
    q = queries.select(query_id).distinct().join(tp, query_id, "left").join(nrel, query_id, "left") \
        .fillna(0, ["_tp", "_nr"])
    return q.select(query_id, F.when(F.col("_nr") > 0, F.col("_tp") / F.col("_nr")).otherwise(0.0)
                    .cast("double").alias("recall"))


def first_relevant_rank(queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, *,
                        query_id: str = "query_id", doc_id: str = "doc_id", rank: str = "rank") -> DataFrame:
    """Per query the rank of the first relevant hit, 0 when none."""
    hit = retrieved.join(relevant.select(query_id, doc_id).distinct(), [query_id, doc_id], "inner") \
        .groupBy(query_id).agg(F.min(rank).alias("first_rank"))
    return queries.select(query_id).distinct().join(hit, query_id, "left").fillna(0, ["first_rank"]) \
        .select(query_id, F.col("first_rank").cast("long").alias("first_rank"))


def mrr(ranks: DataFrame, rank: str = "first_rank") -> DataFrame:
    """Mean of 1/rank with rank <= 0 counting 0."""
    return ranks.agg(F.avg(F.when(F.col(rank) > 0, 1.0 / F.col(rank)).otherwise(0.0)).alias("mrr"))


def compare_retrieval(queries: DataFrame, system: DataFrame, baseline: DataFrame, relevant: DataFrame,
                      k: int = 5, **kw) -> DataFrame:
    """precision@k / recall@k of a system and a keyword baseline, and their differences (one row)."""
    def means(ret: DataFrame, tag: str) -> DataFrame:
        p = precision_at_k(queries, ret, relevant, k, **kw)
        r = recall_at_k(queries, ret, relevant, k, **kw)
        return p.join(r, kw.get("query_id", "query_id")).agg(
            F.avg("precision").alias(f"{tag}_precision"), F.avg("recall").alias(f"{tag}_recall"))

    a = means(system, "system").withColumn("_one", F.lit(1))
    b = means(baseline, "baseline").withColumn("_one", F.lit(1))
    j = a.join(b, "_one")
    return j.select("system_precision", "system_recall", "baseline_precision", "baseline_recall",
                    (F.col("system_precision") - F.col("baseline_precision")).alias("precision_diff"),
                    (F.col("system_recall") - F.col("baseline_recall")).alias("recall_diff"))


# ------------------------------------------------------------------ timing and summaries
def time_reduction(timings: DataFrame, *, method: str = "method", time: str = "time_seconds",
                   system: str = TIME_SYSTEM_METHOD, baseline: str = TIME_BASELINE_METHOD) -> DataFrame:
    """Mean time per method; (baseline - system) / baseline * 100.  Missing method -> no row."""
    means = timings.groupBy(method).agg(F.avg(time).alias("_t"))
    row = means.agg(
        F.max(F.when(F.col(method) == system, F.col("_t"))).alias("llm_avg_time"),
        F.max(F.when(F.col(method) == baseline, F.col("_t"))).alias("baseline_avg_time"),
    )
    return row.where(F.col("llm_avg_time").isNotNull() & F.col("baseline_avg_time").isNotNull()).select(
        "llm_avg_time", "baseline_avg_time",
        (F.try_divide(F.col("baseline_avg_time") - F.col("llm_avg_time"), F.col("baseline_avg_time")) * 100.0)
        .alias("time_reduction_pct"))


def query_stats(results: DataFrame, *, time: str = "query_time_s", docs: str = "docs_retrieved",
                substantive: Column | None = None) -> DataFrame:
    """avg / min / max query time, mean documents retrieved and (optionally) the substantive-answer rate."""
    aggs = [F.avg(time).alias("avg_query_time_s"), F.min(time).alias("min_query_time_s"),
            F.max(time).alias("max_query_time_s"), F.avg(F.col(docs).cast("double")).alias("avg_docs_retrieved")]
    if substantive is not None:
        aggs.append(F.avg(substantive.cast("double")).alias("substantive_answer_rate"))
    return results.agg(*aggs)


def compare_before_after(before: DataFrame, after: DataFrame, *, metric: str = "metric",
                         value: str = "value") -> DataFrame:
    """Per metric before, after, delta and percent change (0 when before <= 0)."""
    b = before.select(metric, F.col(value).alias("before"))
    a = after.select(metric, F.col(value).alias("after"))
    j = b.join(a, metric)
    return j.select(metric, "before", "after", (F.col("after") - F.col("before")).alias("delta"),
                    F.when(F.col("before") > 0, (F.col("after") - F.col("before")) / F.col("before") * 100.0)
                    .otherwise(0.0).alias("pct_change"))


def long_metrics(df: DataFrame, cols: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Wide one-row metric table -> (metric, value) rows."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(metric), F.col(c).cast("double").alias(value))
                                        for c in cols])).alias("_m")).select("_m.*")

