"""Retrieval over tables of questions: exact vector top-k, keyword overlap, context building.

Every operator takes a table of queries, so one plan serves many questions.
Vector search reads the cells of ``vector_search`` that a block of queries may need.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import KEYWORD_TOP_K, RETRIEVER_OVERFETCH, RETRIEVER_TOP_K
from ..functions.text import split_words
from ..session import materialize
from .vector_search import HELD_HITS, MAX_QUERY_BYTES, CellIndex, _codes, deal_cells, search
from .vector_search import cut_hits as _cut_hits

# Largest query table broadcast in one piece (rows x vector bytes stays well under
# the broadcast limit for 384-float vectors: 20,000 x 1.5 KB = 30 MB).
MAX_BROADCAST_QUERIES = 20000
# Pairs of queries and candidates that a task makes at once.
HELD_PAIRS = 100_000
# Bytes of text of a block of contained items; its automaton takes some 50 times that in a worker.
MAX_ITEM_BYTES = 2 << 20


def bounded_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, int]:
    """Return (df hinted for broadcast if it has at most ``max_rows`` rows, row count)."""
    n = df.count()
    return (F.broadcast(df) if n <= max_rows else df), n


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance accumulated in DOUBLE."""
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v)


def filter_equal_all(df: DataFrame, filters: dict | None) -> DataFrame:
    """Metadata filter: every ``{column: value}`` must hold (AND); empty or None means no filter."""
    if not filters:
        return df
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in filters.items()]))


def filter_ticker(df: DataFrame, ticker: str) -> DataFrame:
    return filter_equal_all(df, {"ticker": ticker})


def filter_section(df: DataFrame, section: str) -> DataFrame:
    return filter_equal_all(df, {"section": section})


def year_matches(filing_date: Column, year: Column | int | None) -> Column:
    """``str(year) in str(filing_date)``; a NULL or 0 year means no filter."""
    y = year if isinstance(year, Column) else F.lit(year)
    return y.isNull() | (y == 0) | F.contains(filing_date.cast("string"), y.cast("string"))


def filter_year_contains(df: DataFrame, year: int | None, col: str = "filing_date") -> DataFrame:
    """Rows of a year (none given: all). On a DATE this is a range, which the Parquet scan gets as pushed filters."""
    if not year:
        return df
    if isinstance(df.schema[col].dataType, T.DateType) and 1000 <= int(year) <= 9998:
        return df.where((F.col(col) >= F.lit(f"{year}-01-01").cast("date")) & (F.col(col) < F.lit(f"{int(year) + 1}-01-01").cast("date")))
    return df.where(year_matches(F.col(col), year))


def metadata_project(corpus: DataFrame) -> DataFrame:
    """The 5-key metadata of a vector record: text fields as strings, chunk_id as int."""
    return corpus.select(
        "id",
        F.col("ticker").cast("string").alias("ticker"),
        F.col("filing_type").cast("string").alias("filing_type"),
        F.col("filing_date").cast("string").alias("filing_date"),
        F.col("section").cast("string").alias("section"),
        F.col("chunk_id").cast("int").alias("chunk_id"),
    )


def query_corpus_cross(queries: DataFrame, corpus: DataFrame, *, query_id: str = "query_id",
                       embedding: str = "embedding", id_col: str = "id", match_cols: list[str] | None = None,
                       keep_cols: list[str] | None = None, max_broadcast: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Every query against every (matching) candidate: (query_id, id, distance, keep_cols...).

    ``match_cols`` are per-query filters: a candidate is kept when the query's
    value is NULL or equal.  Queries are broadcast in blocks of at most ``max_broadcast``, and the corpus streams
    through Arrow batches with no shuffle; the pairs of a batch are made in pieces of HELD_PAIRS.  A vector that
    is NULL, has a NULL or another length than the query's gives a pair with a NULL distance.
    """
    match_cols, keep_cols = list(match_cols or []), list(keep_cols or [])
    qsel = queries.select(query_id, embedding, *match_cols)
    blocks = max(1, -(-qsel.count() // max_broadcast))
    candidates = corpus.select(id_col, embedding, *dict.fromkeys([*match_cols, *keep_cols]))
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(id_col, corpus.schema[id_col].dataType),
                           T.StructField("distance", T.DoubleType()), *[corpus.schema[k] for k in keep_cols]])
    parts = []
    for i in range(blocks):
        rows = (qsel if blocks == 1 else qsel.where(F.pmod(F.hash(F.col(query_id)), F.lit(blocks)) == i)).toArrow()
        shared = queries.sparkSession.sparkContext.broadcast(rows.combine_chunks())

        def run(batches, shared=shared):
            asked = shared.value
            ids, vectors = asked[query_id].combine_chunks(), _vectors_by_size(asked[embedding].combine_chunks())
            known = {m: {v: j for j, v in enumerate(dict.fromkeys(x for x in asked[m].to_pylist() if x is not None))} for m in match_cols}
            wanted = {m: _codes(asked[m].to_pylist(), known[m]) for m in match_cols}
            for b in batches:
                there = {m: _codes(b.column(m).to_pylist(), known[m]) for m in match_cols}
                points, step = _vectors_by_size(b.column(embedding)), max(1, HELD_PAIRS // max(1, b.num_rows))
                for lo in range(0, len(ids) if b.num_rows else 0, step):
                    hi = min(lo + step, len(ids))
                    keep = np.ones((hi - lo, b.num_rows), bool)
                    for m in match_cols:
                        mine = wanted[m][lo:hi, None]
                        keep &= (mine == -1) | (mine == there[m][None, :])
                    d, missing = _pair_distances(vectors, points, lo, hi, b.num_rows)
                    q, at = np.nonzero(keep)
                    if len(q):
                        at_rows = pa.array(at)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + lo)), b.column(id_col).take(at_rows), pa.array(d[q, at], mask=missing[q, at]),
                                                          *[b.column(k).take(at_rows) for k in keep_cols]], names=[query_id, id_col, "distance", *keep_cols])

        parts.append(candidates.mapInArrow(run, schema))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _vectors_by_size(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length the places of the vectors without NULLs, and their matrix with a row per component."""
    sizes, out = np.asarray(pc.fill_null(pc.list_value_length(column), -1)), {}
    for size in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == size)
        values = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64())
        whole = ~np.asarray(values.is_null()).reshape(len(at), size).any(axis=1)
        out[size] = at[whole], np.ascontiguousarray(np.asarray(values.fill_null(0.0)).reshape(len(at), size)[whole].T)
    return out


def _pair_distances(queries: dict, points: dict, lo: int, hi: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the queries of a range and the points, summed in the order of the components, and which pairs have none."""
    out, missing = np.zeros((hi - lo, n)), np.ones((hi - lo, n), bool)
    for size in queries.keys() & points.keys():
        (places, q), (at, p) = queries[size], points[size]
        mine = slice(*np.searchsorted(places, (lo, hi)))
        total = np.zeros((mine.stop - mine.start, len(at)))
        for a, b in zip(q[:, mine], p, strict=True):
            part = a[:, None] - b[None, :]
            part *= part
            total += part
        cells = np.ix_(places[mine] - lo, at)
        out[cells], missing[cells] = total, False
    return out, missing


def rank_per_query(hits: DataFrame, k: int | None, *, query_id: str = "query_id", score: str = "distance",
                   id_col: str = "id", descending: bool = False) -> DataFrame:
    """``rank`` 1..k per query by score (ties on id); k None keeps all ranks."""
    order = [F.col(score).desc() if descending else F.col(score).asc(), F.col(id_col).asc()]
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order)))
    return ranked.where(F.col("rank") <= k) if k is not None else ranked


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = RETRIEVER_TOP_K, *, filters: dict | None = None,
                match_cols: list[str] | None = None, keep_cols: list[str] | None = None,
                query_id: str = "query_id", embedding: str = "embedding", id_col: str = "id", index: CellIndex | None = None,
                within: tuple[str, str, int] | None = None) -> DataFrame:
    """Exact nearest ``k`` candidates per query by squared L2 (ties on id).

    ``filters`` is the metadata filter applied to the corpus before ranking (it
    reaches the Parquet scan as pushed filters); ``match_cols`` are per-query filters
    (NULL: none).  ``index``: the corpus as ``deal_cells`` wrote it, for many searches; else it is
    dealt for this one.  ``within``: see ``search``.  Query ids are distinct.  Queries and rows without a whole finite vector take no part.
    """
    dim = queries.agg(F.max(F.size(embedding))).first()[0]
    if index is None:
        index = deal_cells(filter_equal_all(corpus, filters), match_cols=match_cols, keep_cols=keep_cols, embedding=embedding, id_col=id_col, dim=dim)
    elif filters:  # a fixed filter is a filter of every query
        queries = queries.withColumns({c: F.lit(v) for c, v in filters.items()})
        match_cols = list(dict.fromkeys([*(match_cols or []), *filters]))
    return search(queries, index, k, match_cols=match_cols, keep_cols=keep_cols, query_id=query_id, within=within)


def vector_topk_overfetch_year(queries: DataFrame, corpus: DataFrame, k: int = RETRIEVER_TOP_K, *,
                               year: int | None = None, year_col: str | None = None, overfetch: int = RETRIEVER_OVERFETCH,
                               mode: str = "parity", filters: dict | None = None,
                               match_cols: list[str] | None = None, keep_cols: list[str] | None = None,
                               query_id: str = "query_id", id_col: str = "id",
                               date_col: str = "filing_date") -> DataFrame:
    """Top-k with a year filter on the filing date: one ``year`` for all queries, or each query's ``year_col``.

    ``parity``: fetch ``overfetch * k`` nearest, keep those whose date contains the
    year, cut to k (may return fewer than k, as the reference does).
    ``prefilter``: apply the year filter before ranking (always k when available).
    Without a year this is plain top-k.
    """
    keep = list(dict.fromkeys((keep_cols or []) + [date_col]))
    if year_col and mode == "prefilter":
        dated = corpus.withColumn("_year", F.year(F.col(date_col)))
        asked = queries.withColumn("_year", F.when(F.col(year_col) != 0, F.col(year_col)).cast("int"))
        hits = vector_topk(asked, dated, k, filters=filters, match_cols=[*(match_cols or []), "_year"], keep_cols=keep, query_id=query_id, id_col=id_col)
        return hits
    if not year and not year_col:
        return vector_topk(queries, corpus, k, filters=filters, match_cols=match_cols, keep_cols=keep,
                           query_id=query_id, id_col=id_col)
    if mode == "prefilter":
        cand = filter_year_contains(filter_equal_all(corpus, filters), year, date_col)
        return vector_topk(queries, cand, k, match_cols=match_cols, keep_cols=keep, query_id=query_id, id_col=id_col)
    asked = F.col(year_col) if year_col else F.lit(year)
    wanted = queries.withColumn("_year", F.when(asked != 0, asked).cast("string"))  # NULL or 0: no filter
    return vector_topk(wanted, corpus, k * overfetch, filters=filters, match_cols=match_cols, keep_cols=keep, query_id=query_id, id_col=id_col,
                       within=(date_col, "_year", k))


# ------------------------------------------------------------------ keyword search
def distinct_words(text: Column) -> Column:
    """Distinct lower-cased whitespace words (``set(text.lower().split())``)."""
    return F.array_distinct(split_words(F.lower(text)))


def term_overlap(queries: DataFrame, docs: DataFrame, *, query_id: str = "query_id", query_text: str = "text",
                 doc_id: str = "doc_id", doc_text: str = "text",
                 max_broadcast_terms: int = 5_000_000) -> DataFrame:
    """(query_id, doc_id, overlap) for every pair sharing at least one distinct word.

    Query terms are broadcast when their count is within the bound, and documents meet them where they are.
    Beyond it, words are dealt by document frequency: a word of more than a fourth of a shuffle partition's
    share of all (document, word) pairs is split over as many salts as it has such shares, so no word is one
    key.  There are at most four such words per partition, and they alone are broadcast.
    """
    qt = queries.select(F.col(query_id).alias("_q"), F.explode_outer(distinct_words(F.col(query_text))).alias("_term")) \
        .where(F.col("_term").isNotNull())
    qt, n_terms = bounded_broadcast(qt, max_broadcast_terms)
    dt = docs.select(F.col(doc_id).alias("_d"), F.explode_outer(distinct_words(F.col(doc_text))).alias("_term")) \
        .where(F.col("_term").isNotNull())
    if n_terms <= max_broadcast_terms:
        pairs = dt.join(qt, "_term")
    else:
        frequency = materialize(dt.groupBy("_term").agg(F.count(F.lit(1)).alias("_df")))
        total = frequency.agg(F.sum("_df")).first()[0] or 0
        share = max(1, total // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        heavy = F.broadcast(frequency.where(F.col("_df") > share).select("_term", F.ceil(F.col("_df") / share).cast("long").alias("_salts")))
        salts = F.coalesce("_salts", F.lit(1).cast("long"))
        dealt = dt.join(heavy, "_term", "left").withColumn("_salt", F.pmod(F.xxhash64("_d"), salts)).drop("_salts")
        asked = qt.join(heavy, "_term", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
        pairs = dealt.join(asked, ["_term", "_salt"])
    return pairs.groupBy(F.col("_q").alias(query_id), F.col("_d").alias(doc_id)).agg(
        F.count(F.lit(1)).alias("overlap"))


class _QueryTerms:
    """Terms of a block of queries; scores the documents of a batch that can be among a query's k best.

    A batch gets an inverted index of the queries' terms.  A document with an overlap of at least ``need`` with a
    query of which m terms occur in the batch holds one of the m - need + 1 rarest of these: only documents of
    those lists are scored, and no document if m < need.  ``need`` is the k-th best overlap seen so far.
    """

    def __init__(self, ids: pa.Array, words: list[list[str]], k: int):
        self.ids, self.k, self.place = ids, k, {}
        self.terms = [np.array([self.place.setdefault(w, len(self.place)) for w in ws or ()], np.int64) for ws in words]
        self.need = np.ones(len(ids), np.int64)
        self.scored = 0

    def near(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, overlap) of the documents that may be among a query's k best."""
        held = [[self.place[w] for w in set((t or "").split()) if w in self.place] for t in texts]
        docs, terms = np.repeat(np.arange(len(texts)), [len(x) for x in held]), np.array([w for x in held for w in x], np.int64)
        docs = docs[np.argsort(terms, kind="stable")]
        sizes = np.bincount(terms, minlength=len(self.place))
        ends = np.cumsum(sizes)
        out = []
        for q, mine in enumerate(self.terms):
            there = mine[sizes[mine] > 0]
            spare = len(there) - self.need[q]
            if spare < 0:
                continue
            there = there[np.argsort(sizes[there], kind="stable")]
            lists = [docs[ends[w] - sizes[w] : ends[w]] for w in there.tolist()]
            some, n = np.unique(np.concatenate(lists[: spare + 1]), return_counts=True)
            for other in lists[spare + 1 :]:
                n += other[np.minimum(np.searchsorted(other, some), len(other) - 1)] == some
            self.scored += len(some)
            if len(n) >= self.k:
                self.need[q] = max(self.need[q], np.partition(n, len(n) - self.k)[len(n) - self.k])
            good = n >= self.need[q]
            out.append((np.full(good.sum(), q), some[good], n[good]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best_overlaps(queries: DataFrame, docs: DataFrame, k: int, query_id: str, query_text: str, doc_id: str, doc_text: str,
                   ordinal: str) -> DataFrame:
    """(query_id, doc_id, overlap, _ord) of at most k overlapping documents per query and task, so (query,
    document) pairs are not shuffled. Queries go in blocks of at most MAX_QUERY_BYTES of text."""
    terms = queries.select(F.col(query_id).alias("_id"), distinct_words(F.coalesce(F.col(query_text), F.lit(""))).alias("_terms"),
                           F.coalesce(F.length(query_text), F.lit(0)).alias("_n"))
    n, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    blocks = max(1, -(-size * 4 // MAX_QUERY_BYTES), -(-n // MAX_BROADCAST_QUERIES))
    fields = [T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(doc_id, docs.schema[doc_id].dataType),
              T.StructField("overlap", T.LongType()), T.StructField("_ord", docs.schema[ordinal].dataType)]
    texts = docs.select(F.col(doc_id).alias("_d"), F.col(ordinal).alias("_ord"), F.lower(doc_text).alias("_text"))
    parts = []
    for i in range(blocks):
        rows = (terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == i)).select("_id", "_terms").toArrow()
        shared = queries.sparkSession.sparkContext.broadcast((rows["_id"].combine_chunks(), rows["_terms"].to_pylist()))

        def run(batches, shared=shared):
            block, held, made = _QueryTerms(*shared.value, k), [], 0
            order = [("overlap", "descending"), ("_ord", "ascending")]
            for b in batches:
                q, d, n = block.near(b.column("_text").to_pylist())
                if len(q):
                    t = b.select(["_d", "_ord"]).take(pa.array(d))
                    held.append(pa.table([pa.array(q), *t.columns, pa.array(n.astype(np.int64))], names=["_q", "_d", "_ord", "overlap"]))
                    made += len(q)
                if made > HELD_HITS:
                    held = [_cut_hits(pa.concat_tables(held), k, order)]
                    made = len(held[0]) // 2
            if held:
                hits = _cut_hits(pa.concat_tables(held), k, order)
                yield from pa.table([block.ids.take(hits["_q"].combine_chunks()), hits["_d"], hits["overlap"], hits["_ord"]],
                                    names=[query_id, doc_id, "overlap", "_ord"]).to_batches()

        parts.append(texts.mapInArrow(run, T.StructType(fields)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def keyword_topk(queries: DataFrame, docs: DataFrame, k: int = KEYWORD_TOP_K, *, query_id: str = "query_id",
                 query_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text",
                 ordinal: str | None = None) -> DataFrame:
    """Top-k documents per query by distinct-word overlap; ties by input order.

    Documents with zero overlap fill the list when fewer than k overlap (the
    reference sorts all documents), lowest ordinal first.  Only the 2k lowest
    ordinals can ever be needed for that, so the padding side is bounded by 2k
    rows per query.  Output: (query_id, rank, doc_id, overlap).
    """
    ordinal = ordinal or doc_id
    ords = docs.select(F.col(doc_id), F.col(ordinal).alias("_ord"))
    pos = _best_overlaps(queries, docs, k, query_id, query_text, doc_id, doc_text, ordinal)
    w = Window.partitionBy(query_id).orderBy(F.col("overlap").desc(), F.col("_ord").asc())
    pos = pos.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    # The 2k lowest ordinals as one bounded array (a scalar subquery, no join).
    pad_arr = ords.orderBy("_ord").limit(2 * k).select(
        F.array_sort(F.collect_list(F.struct(F.col("_ord"), F.col(doc_id).alias("d"))))).scalar()
    pad = queries.select(query_id, F.explode(pad_arr).alias("_p")).select(
        query_id, F.col("_p.d").alias(doc_id), F.lit(0).cast("long").alias("overlap"), F.col("_p._ord").alias("_ord"))
    both = pos.select(query_id, doc_id, F.col("overlap").cast("long").alias("overlap"), "_ord").unionByName(pad)
    cand = both.groupBy(query_id, doc_id).agg(F.max("overlap").alias("overlap"), F.min("_ord").alias("_ord"))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select(query_id, "rank", doc_id, "overlap")


# ------------------------------------------------------------------ context and prompts
def date_text(c: Column) -> Column:
    """A filing date as the reference renders it: ``yyyy-MM-dd HH:mm:ss`` (NULL: ``NaT``)."""
    return F.coalesce(F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit("NaT"))


def format_context(hits: DataFrame, *, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """Per query: ``[Source i] ticker - type (date) - section:\\ntext`` blocks joined by a blank line."""
    block = F.concat(
        F.lit("[Source "), F.col(rank).cast("string"), F.lit("] "), F.col("ticker").cast("string"), F.lit(" - "),
        F.col("filing_type"), F.lit(" ("), date_text(F.col("filing_date")), F.lit(") - "), F.col("section"),
        F.lit(":\n"), F.col("text"),
    )
    return _ordered_join(hits, query_id, rank, block, "\n\n", "context")


def format_context_labeled(hits: DataFrame, *, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """Per query: multi-line ``[Document i]`` blocks joined by ``\\n---\\n``."""
    block = F.concat(
        F.lit("[Document "), F.col(rank).cast("string"), F.lit("]\nTicker: "), F.col("ticker").cast("string"),
        F.lit("\nFiling: "), F.col("filing_type"), F.lit("\nDate: "), date_text(F.col("filing_date")),
        F.lit("\nSection: "), F.col("section"), F.lit("\nContent: "), F.col("text"), F.lit("\n"),
    )
    return _ordered_join(hits, query_id, rank, block, "\n---\n", "context")


def _ordered_join(df: DataFrame, key: str, order: str, value: Column, sep: str, out: str) -> DataFrame:
    """Per key, values joined in ``order`` (the list per key is bounded by k)."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("_l"))
    return g.select(key, F.array_join(F.transform("_l", lambda x: x["v"]), sep).alias(out))


def fill_template(template: str, **values: Column) -> Column:
    """Fill ``{name}`` placeholders of a template with columns (no other formatting)."""
    parts: list[Column] = []
    rest = template
    while rest:
        starts = [(rest.find("{" + k + "}"), k) for k in values if rest.find("{" + k + "}") >= 0]
        if not starts:
            parts.append(F.lit(rest))
            break
        i, k = min(starts)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(values[k])
        rest = rest[i + len(k) + 2:]
    return F.concat(*parts) if parts else F.lit("")


def qa_prompt(context: Column, question: Column, template: str | None = None) -> Column:
    from ..constants import QA_TEMPLATE

    return fill_template(template or QA_TEMPLATE, context=context, question=question)


def text_preview(c: Column, n: int = 300) -> Column:
    """First n characters plus '...' when longer; otherwise unchanged."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


_AUTOMATA: dict[int, tuple] = {}


def _automaton(key: int, texts: list[str | None]) -> tuple:
    """The items' automaton (values: places of the items with that text) and the places of empty items; the last
    one made is kept, so that a worker makes it once for its tasks."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        places: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            if t is not None:
                places.setdefault(t, []).append(i)
        empty = places.pop("", [])
        found = ahocorasick.Automaton()
        for t, at in places.items():
            found.add_word(t, at)
        if places:
            found.make_automaton()
        _AUTOMATA[key] = (found if places else None, empty)
    return _AUTOMATA[key]


def containment_pairs(items: DataFrame, docs: DataFrame, *, item_id: str = "item_id", item_text: str = "text",
                      doc_id: str = "doc_id", doc_text: str = "text", max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """(item_id, doc_id) for every document whose text contains the item's text.

    Items go in blocks of about ``max_item_bytes`` of text; a block's Aho-Corasick automaton finds all its items
    in one pass over each document, whatever their length, so nothing is shuffled.  An empty item is in every
    document with a text; a NULL text neither contains nor is contained; repeated rows give repeated pairs.
    """
    rows = items.select(F.col(item_id).alias("_i"), F.col(item_text).alias("_t"))
    size = rows.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    blocks = max(1, -(-size // max_item_bytes))
    texts = docs.select(F.col(doc_id).alias("_d"), F.col(doc_text).alias("_text")).where("_text IS NOT NULL")
    schema = T.StructType([T.StructField(item_id, items.schema[item_id].dataType), T.StructField(doc_id, docs.schema[doc_id].dataType)])
    parts = []
    for n in range(blocks):
        block = (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("_i", "_t"), F.lit(blocks)) == n)).toArrow()
        shared = items.sparkSession.sparkContext.broadcast((block["_i"].combine_chunks(), block["_t"].to_pylist()))

        def run(batches, shared=shared):
            ids, words = shared.value
            found, empty = _automaton(shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(words), words)
            for b in batches:
                at, who = [], []
                for i, t in enumerate(b.column("_text").to_pylist()):
                    mine = set(empty)
                    if found is not None:
                        for _, places in found.iter(t):
                            mine.update(places)
                    at += [i] * len(mine)
                    who += mine
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who, pa.int64())), b.column("_d").take(pa.array(at, pa.int64()))], names=[item_id, doc_id])

        parts.append(texts.mapInArrow(run, schema))
    return reduce(lambda a, b: a.unionByName(b), parts)
