"""Exact nearest neighbours over a corpus that is dealt into cells, of which whole ones are skipped.

``deal_cells`` writes the corpus once: every row goes to its nearest pivot (a few rows of the corpus; any choice
gives exact results), files hold one pivot's rows in the order of the filter columns, and a small table knows for
each combination of filter values and pivot how many rows there are and how near and how far from the pivot.

``search`` makes two passes for a block of queries.  The first reads the nearest cells that hold k rows under the
query's filters, so the k-th distance found bounds the result.  By the triangle inequality a row of a cell is no nearer
than d - farthest or nearest - d, where d is the distance of query and pivot: the second pass reads the
other cells whose bound is within the k-th distance and skips the rest.  A row is multiplied with the queries that chose
its cell and that its filter values pass.  The corpus is not shuffled by such a search; k hits per query and task are.

With so many queries that these hits outweigh the corpus, ``search`` shuffles the corpus instead: queries go in blocks
of like filters and near cells, each block is a task's that the rows under its filters pass through, nearest cells
first, and gives k hits per query in all.  Rows whose cells a query's k-th distance so far excludes are not multiplied.

If the corpus is small enough to be held by every task, as it is when the questions outnumber it, it is not shuffled
either: it is broadcast, and the queries pass by in their own tasks.  Products are then made in single precision,
with a bound of their rounding, and exact distances only for the rows that may be among the k nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch_path

#: most pivots (half the square root of the rows, if that is less)
MAX_PIVOTS = 256
#: bytes of the query vectors and chosen cells of a block, which every task of a pass holds
MAX_QUERY_BYTES = 64 << 20
#: distances that a task holds at once, and hits that it holds before it cuts them to k per query
HELD_DISTANCES, HELD_HITS, HELD_ROWS = 1_000_000, 1_000_000, 8192
#: bytes of the queries of a block with the hits held for them, when the corpus goes to the queries
MAX_BLOCK_BYTES = 64 << 20
#: most rows (block, filter values) that are broadcast to the corpus
MAX_BROADCAST_KINDS = 200_000
SALTS = 64
#: most bytes of a corpus that every task holds, and the queries and rows whose products a task makes at once then
MAX_CORPUS_BYTES = 128 << 20
TILE_QUERIES, TILE_ROWS = 512, 1024


def whole_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a whole vector of ``dim`` finite components, and their matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)))
    values = np.asarray(pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64()).fill_null(float("nan"))).reshape(len(rows), dim)
    good = np.isfinite(values).all(axis=1)
    return rows[good], values[good]


def distances(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row per query, without the rounding of the product form."""
    return np.sqrt(np.stack([((q - p) ** 2).sum(axis=1) for p in points], axis=1)) if len(points) else np.zeros((len(q), 0))


@dataclass
class CellIndex:
    """``rows``: the written corpus with ``_cell``; ``stats``: rows, nearest and farthest per filter values and cell."""

    rows: DataFrame
    stats: DataFrame
    pivots: np.ndarray
    match_cols: list[str]
    embedding: str
    id_col: str


def _nearest(pivots: np.ndarray, embedding: str):
    def run(batches):
        for b in batches:
            rows, c = whole_vectors(b.column(embedding), pivots.shape[1])
            cells, gaps = np.zeros(len(c), np.int32), np.zeros(len(c))
            step = max(1, HELD_DISTANCES // len(pivots))
            for lo in range(0, len(c), step):
                part = c[lo : lo + step]
                d = (pivots * pivots).sum(axis=1)[None, :] - 2 * (part @ pivots.T)
                cells[lo : lo + step] = d.argmin(axis=1)
                gaps[lo : lo + step] = np.sqrt(((part - pivots[cells[lo : lo + step]]) ** 2).sum(axis=1))
            kept = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cells), pa.array(gaps)], names=[*b.schema.names, "_cell", "_gap"])

    return run


def deal_cells(corpus: DataFrame, *, match_cols: list[str] | None = None, keep_cols: list[str] | None = None, embedding: str = "embedding",
               id_col: str = "id", dim: int | None = None, pivots: int | None = None, path: str | None = None) -> CellIndex:
    """Write ``corpus`` dealt into cells (to ``path``, or the shared checkpoint folder).  Rows without a whole vector go."""
    spark, match_cols = corpus.sparkSession, list(match_cols or [])
    rows = corpus.select(*dict.fromkeys([id_col, embedding, *match_cols, *(keep_cols or [])]))
    n, widest = rows.agg(F.count(F.lit(1)), F.max(F.size(embedding))).first()
    dim = max(dim or widest or 1, 1)
    most = pivots or min(MAX_PIVOTS, max(1, math.isqrt(n) // 2))
    sample = rows.where(F.size(embedding) == dim).select(id_col, embedding).orderBy(F.xxhash64(id_col), id_col).limit(most).toArrow()
    points = np.unique(whole_vectors(sample[embedding], dim)[1], axis=0) if len(sample) else np.zeros((0, dim))
    points = points if len(points) else np.zeros((1, dim))
    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_gap", T.DoubleType())])
    schema = schema.add("_row", T.LongType())  # ids may repeat
    order = ["_cell", *match_cols, F.xxhash64(id_col)]
    path = path or scratch_path(spark, "cells")
    # by ranges, so that a cell with very many rows is split and few files hold a cell
    rows.mapInArrow(_nearest(points, embedding), T.StructType(schema.fields[:-1])).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("_cell").parquet(path)
    dealt = spark.read.schema(schema).parquet(path)
    stats = materialize(dealt.groupBy(*match_cols, "_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_gap").alias("near"), F.max("_gap").alias("far")))
    return CellIndex(dealt, stats, points, match_cols, embedding, id_col)


# ------------------------------------------------------------------ which cells a query needs
def _profiles(queries: DataFrame, index: CellIndex, match_cols: list[str]) -> DataFrame:
    """``queries`` with ``_cells``: per cell under the query's filters (NULL: any value), its rows, nearest and farthest.

    Queries are joined by the filters that they have, so at most 2 to the number of filters joins; a profile holds
    at most as many entries as there are pivots.  Queries of the same values are spread by a salt.
    """
    nulls = [F.col(m).isNull() for m in match_cols]
    patterns = queries.select(*[x.alias(m) for m, x in zip(match_cols, nulls, strict=True)]).distinct().collect() if match_cols else []
    patterns = patterns or [dict.fromkeys(match_cols, True)]
    entry = F.collect_list(F.struct("_cell", "n", "near", "far")).alias("_cells")
    parts = []
    for p in patterns:
        given = [m for m in match_cols if not p[m]]
        mine = queries.where(reduce(lambda a, b: a & b, [(~x if m in given else x) for m, x in zip(match_cols, nulls, strict=True)])) if match_cols else queries
        merged = index.stats.groupBy(*given, "_cell").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far"))
        if given:
            salted = mine.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
            profile = merged.groupBy(*given).agg(entry).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            parts.append(salted.join(profile, [*given, "_salt"], "left").select(*queries.columns, "_cells"))
        else:  # one row, of at most as many entries as there are pivots
            parts.append(mine.join(F.broadcast(merged.agg(entry).withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).select(*queries.columns, "_cells"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _matrix(column: pa.Array, kind, rows: int) -> np.ndarray:
    """Binary values of one length each as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _planned(b: pa.RecordBatch, chosen: np.ndarray, n: np.ndarray, more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with the chosen cells as bits and the rows in them."""
    bits = np.packbits(chosen, axis=1)
    new = {"_chosen": pa.array([x.tobytes() for x in bits], pa.binary()), "_read": pa.array((n * chosen).sum(axis=1)), **more}
    names = [c for c in b.schema.names if c not in new and c not in ("_cells", "_most")]
    return pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *new.values()], names=[*names, *new])


def _first_cells(pivots: np.ndarray, embedding: str, k: int):
    """Chooses the nearest cells that hold k rows; ``_bound`` is how near a row of each cell may be, ``_n`` its rows."""

    def run(batches):
        for b in batches:
            rows, q = whole_vectors(b.column(embedding), pivots.shape[1])
            b = b.take(pa.array(rows))
            d, cells = distances(q, pivots), b.column("_cells")
            n, near, far = np.zeros(d.shape, np.int64), np.zeros(d.shape), np.zeros(d.shape)
            row = np.repeat(np.arange(len(rows)), np.asarray(pc.fill_null(pc.list_value_length(cells), 0)))
            entries = pc.list_flatten(cells)
            cell = np.asarray(entries.field("_cell"))
            for name, values in (("n", n), ("near", near), ("far", far)):
                values[row, cell] = np.asarray(entries.field(name))
            order = np.argsort(np.where(n > 0, d, np.inf), axis=1, kind="stable")
            ordered = np.take_along_axis(n, order, axis=1)
            chosen = np.zeros(d.shape, bool)
            np.put_along_axis(chosen, order, (np.cumsum(ordered, axis=1) - ordered < k) & (ordered > 0), axis=1)
            bound = np.maximum(np.maximum(d - far, near - d), 0) * (1 - 1e-9)  # a margin for rounding
            yield _planned(b, chosen, n, {"_all": pa.array(n.sum(axis=1)), "_home": pa.array(d.argmin(axis=1).astype(np.int32)),
                                          "_bound": pa.array([x.tobytes() for x in bound], pa.binary()), "_n": pa.array([x.tobytes() for x in n], pa.binary())})

    return run


def _other_cells(cells: int):
    """Chooses the cells not yet read that may hold a row within the k-th distance (all of them if there is none)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            most = np.sqrt(np.asarray(b.column("_most").fill_null(float("inf"))))[:, None]
            done = np.unpackbits(_matrix(b.column("_chosen"), np.uint8, b.num_rows), axis=1, count=cells).astype(bool)
            n = _matrix(b.column("_n"), np.int64, b.num_rows)
            chosen = (n > 0) & ~done & (_matrix(b.column("_bound"), np.float64, b.num_rows) <= most * (1 + 1e-9))
            out = _planned(b, chosen, n, {})
            yield out.filter(pa.array(chosen.any(axis=1)))

    return run


# ------------------------------------------------------------------ a pass over the chosen cells
def _codes(values: list, known: dict) -> np.ndarray:
    """Place of each value among the queries' values; -1 for NULL, -2 for others."""
    return np.array([-1 if v is None else known.get(v, -2) for v in values], np.int64)


def _near_pairs(q: np.ndarray, points: np.ndarray, most: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, point, squared distance) of at most k pairs per query and HELD_DISTANCES products, none beyond ``most``.

    Of equal distances the first points are taken; ``most``, a query's k-th distance as far as known, gets smaller.
    """
    per_pair = max(1, HELD_DISTANCES // max(1, points.shape[1]))
    for lo in range(0, len(points), HELD_ROWS):
        p = points[lo : lo + HELD_ROWS]
        sizes = (p * p).sum(axis=1)
        step, last = max(1, HELD_DISTANCES // len(p)), min(k, len(p)) - 1
        for first in range(0, len(q), step):
            part, bound = q[first : first + step], most[first : first + step]
            own = (part * part).sum(axis=1)
            d = part @ p.T
            d *= -2
            d += own[:, None]
            d += sizes[None, :]
            limit = bound if np.isfinite(bound).all() else np.minimum(bound, np.partition(d, last, axis=1)[:, last] if len(p) >= k else np.inf)
            # a margin for the rounding of the product form, which grows with the vectors: the exact distances decide
            a, b = np.nonzero(d <= (limit + 1e-9 * (own + sizes.max()) + 1e-300)[:, None])
            exact = np.empty(len(a))
            for i in range(0, len(a), per_pair):
                exact[i : i + per_pair] = ((part[a[i : i + per_pair]] - p[b[i : i + per_pair]]) ** 2).sum(axis=1)
            order = np.lexsort((exact, a))  # stable: of equal distances the first points
            a, b, exact = a[order], b[order], exact[order]
            kept, kth = _first_k(a, k)
            bound[a[kth]] = np.minimum(bound[a[kth]], exact[kth])
            yield a[kept] + first, b[kept] + lo, exact[kept]


def _first_k(q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted entries are among the k first of their query, and the places of the k-th ones."""
    first = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return rank < k, np.flatnonzero(rank == k - 1)


class _Block:
    """Query vectors with their filters and chosen cells; finds the k nearest rows of Arrow batches."""

    def __init__(self, rows: pa.Table, query_id: str, embedding: str, match_cols: list[str], cells: int, dim: int, k: int):
        _, self.q = whole_vectors(rows[embedding], dim)
        self.ids, self.dim, self.k = rows[query_id].combine_chunks(), dim, k
        self.chosen = np.unpackbits(_matrix(rows["_chosen"], np.uint8, len(rows)), axis=1, count=cells).astype(bool) if len(rows) else np.zeros((0, cells), bool)
        self.known = {m: {v: i for i, v in enumerate(dict.fromkeys(x for x in rows[m].to_pylist() if x is not None))} for m in match_cols}
        self.codes = {m: _codes(rows[m].to_pylist(), self.known[m]) for m in match_cols}

    def cells(self) -> list[int]:
        return np.flatnonzero(self.chosen.any(axis=0)).tolist()

    def near(self, batch: pa.RecordBatch, embedding: str, id_col: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, row, squared distance) of at most k rows per query (of equal distances those of the least ids), and the products made."""
        rows, c = whole_vectors(batch.column(embedding), self.dim)
        if id_col:
            by_id = np.asarray(pc.array_sort_indices(batch.column(id_col).take(pa.array(rows))))
            rows, c = rows[by_id], c[by_id]
        kinds = np.stack([np.asarray(batch.column("_cell"))[rows], *[_codes(batch.column(m).take(pa.array(rows)).to_pylist(), known) for m, known in self.known.items()]], axis=1)
        place, found, size, made = np.arange(len(rows)), [], 0, 0
        most = np.full(len(self.q), np.inf)
        alike, kind_of = np.unique(kinds, axis=0, return_inverse=True) if len(rows) else (np.zeros((0, kinds.shape[1]), np.int64), np.zeros(0, np.int64))
        by_kind = np.argsort(kind_of.ravel(), kind="stable")
        cuts = np.searchsorted(kind_of.ravel()[by_kind], np.arange(len(alike) + 1))
        for i, kind in enumerate(alike):
            who = self.chosen[:, kind[0]]
            for code, mine in zip(kind[1:], self.codes.values(), strict=True):
                who = who & ((mine == -1) | (mine == code))
            who, at = np.flatnonzero(who), by_kind[cuts[i] : cuts[i + 1]]
            made += len(who) * len(at)
            bound = most[who]
            for q, p, d in _near_pairs(self.q[who], c[at], bound, self.k):
                found.append((who[q], place[at[p]], d))
                size += len(q)
            most[who] = bound
            if size > HELD_HITS:
                found = [self._least(found, most)]
                size = len(found[0][0]) // 2  # so that they are cut again when as many more have come
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), made
        q, at, d = self._least(found, most)
        return q, rows[at], d, made

    def _least(self, found: list[tuple], most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k first pairs of every query, by distance and place."""
        q, at, d = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, d, q))
        q, at, d = q[order], at[order], d[order]
        kept, kth = _first_k(q, self.k)
        most[q[kth]] = np.minimum(most[q[kth]], d[kth])
        return q[kept], at[kept], d[kept]


def cut_hits(hits: pa.Table, k: int, order: list[tuple[str, str]]) -> pa.Table:
    """The k first hits of every query."""
    hits = hits.take(pc.sort_indices(hits, [("_q", "ascending"), *order]))
    q = np.asarray(hits["_q"])
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return hits.filter(pa.array(rank < k))


def _blocks(asked: DataFrame, dim: int, cells: int) -> list[Column | None]:
    """Conditions on ``_home`` and a hash that deal the queries into blocks; those of near cells share one."""
    most = max(1, MAX_QUERY_BYTES // (dim * 8 + cells + 64))
    counts = [(r["_home"], r["n"]) for r in asked.groupBy("_home").agg(F.count(F.lit(1)).alias("n")).orderBy("_home").collect()]  # at most a row per pivot
    out, held, size = [], [], 0
    for home, n in counts:
        if n > most:
            parts = -(-n // most)
            out += [(F.col("_home") == home) & (F.pmod(F.monotonically_increasing_id(), F.lit(parts)) == i) for i in range(parts)]
            continue
        if size + n > most:
            out.append(F.col("_home").isin(held))
            held, size = [], 0
        held.append(home)
        size += n
    return [*out, F.col("_home").isin(held)] if held else out


def _pass(asked: DataFrame, index: CellIndex, k: int, query_id: str, match_cols: list[str], keep_cols: list[str]) -> DataFrame:
    """(query_id, id, distance, keep_cols) of at most k rows per query and task, from the cells that queries chose."""
    spark, id_col, embedding, dim = asked.sparkSession, index.id_col, index.embedding, index.pivots.shape[1]
    extra = [c for c in keep_cols if c not in (id_col, embedding, query_id)]
    read = list(dict.fromkeys([id_col, embedding, "_cell", *match_cols, *extra]))
    fields = [T.StructField(query_id, asked.schema[query_id].dataType), T.StructField(id_col, index.rows.schema[id_col].dataType),
              T.StructField("distance", T.DoubleType()), *[index.rows.schema[c] for c in extra]]
    parts = []
    for condition in _blocks(asked, dim, len(index.pivots)):
        block = _Block(asked.where(condition).select(query_id, embedding, *match_cols, "_chosen").toArrow(), query_id, embedding, match_cols, len(index.pivots), dim, k)
        if not block.cells():
            continue
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            block, held, size = shared.value, [], 0
            order = [("distance", "ascending"), (id_col, "ascending")]
            for b in batches:
                q, rows, d, _ = block.near(b, embedding, id_col)
                if len(q):
                    taken = b.select([id_col, *extra]).take(pa.array(rows))
                    held.append(pa.table([pa.array(q), *taken.columns, pa.array(d)], names=["_q", id_col, *extra, "distance"]))
                    size += len(q)
                if size > HELD_HITS:
                    held = [cut_hits(pa.concat_tables(held), block.k, order)]
                    size = len(held[0]) // 2  # so that it is cut again when as many more have come
            if held:
                hits = cut_hits(pa.concat_tables(held), block.k, order)
                columns = [block.ids.take(hits["_q"].combine_chunks()), hits[id_col], hits["distance"], *[hits[c] for c in extra]]
                yield from pa.table(columns, names=[query_id, id_col, "distance", *extra]).to_batches()

        parts.append(index.rows.where(F.col("_cell").isin(block.cells())).select(*read).mapInArrow(run, T.StructType(fields)))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], T.StructType(fields))


def _ranked(hits: DataFrame, k: int, query_id: str, id_col: str) -> DataFrame:
    order = Window.partitionBy(query_id).orderBy(F.col("distance"), F.col(id_col))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_steps(queries: DataFrame, index: CellIndex, k: int, *, match_cols: list[str] | None = None, keep_cols: list[str] | None = None,
                 query_id: str = "query_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranked hits, and the plans of both passes (per query ``_read`` of ``_all`` rows that its filters pass)."""
    match_cols, keep_cols = list(match_cols or []), list(keep_cols or [])
    if set(match_cols) - set(index.match_cols):
        raise ValueError(f"the cells are dealt by {index.match_cols}, not by {match_cols}")
    asked = queries.select(query_id, index.embedding, *match_cols)
    plan = [T.StructField("_chosen", T.BinaryType()), T.StructField("_read", T.LongType())]
    kept = [T.StructField("_all", T.LongType()), T.StructField("_home", T.IntegerType()), T.StructField("_bound", T.BinaryType()), T.StructField("_n", T.BinaryType())]
    profiles = _profiles(asked, index, match_cols)
    first = materialize(profiles.mapInArrow(_first_cells(index.pivots, index.embedding, k), T.StructType([*asked.schema.fields, *plan, *kept])))
    hits = materialize(_ranked(_pass(first, index, k, query_id, match_cols, keep_cols), k, query_id, index.id_col).drop("rank"))
    most = hits.groupBy(query_id).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_most"))
    rest = first.where("_read < _all").join(most, query_id, "left")
    second = materialize(rest.mapInArrow(_other_cells(len(index.pivots)), T.StructType([*asked.schema.fields, *kept, *plan])))
    hits = hits.unionByName(_pass(second, index, k, query_id, match_cols, keep_cols))
    return _ranked(hits, k, query_id, index.id_col), first, second


# ------------------------------------------------------------------ many queries: the corpus goes to them
class _Group:
    """The queries of a block; rows of the corpus pass by and the nearest are held."""

    def __init__(self, names: tuple[str, str, str], match_cols: list[str], pivots: np.ndarray, k: int):
        (self.query_id, self.id_col, self.tag), self.match_cols, self.pivots, self.k = names, match_cols, pivots, k
        self.batches, self.held, self.size, self.q = [], [], 0, None

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch.select([self.query_id, "_asked", "_pattern", "_want", *self.match_cols]))

    def _ready(self) -> None:
        rows = pa.Table.from_batches(self.batches)
        self.batches, self.ids, self.want = [], rows[self.query_id].combine_chunks(), rows["_want"].to_pylist()
        self.q, self.pattern = whole_vectors(rows["_asked"], self.pivots.shape[1])[1], np.asarray(rows["_pattern"])
        self.most = np.full(len(self.q), np.inf)
        self.known = {m: {v: i for i, v in enumerate(dict.fromkeys(x for x in rows[m].to_pylist() if x is not None))} for m in self.match_cols}
        self.codes = {m: _codes(rows[m].to_pylist(), self.known[m]) for m in self.match_cols}

    def meet(self, batch: pa.RecordBatch) -> None:
        """Rows under the filters of a pattern (which columns are NULL, as bits) meet the queries of that pattern."""
        if self.q is None:
            self._ready()
        batch = batch.take(pc.array_sort_indices(batch.column(self.id_col)))
        c, pattern = whole_vectors(batch.column("_vector"), self.pivots.shape[1])[1], np.asarray(batch.column("_pattern"))
        cell, gap = np.asarray(batch.column("_cell")), np.asarray(batch.column("_gap"))
        given = [np.where(pattern >> i & 1, -1, _codes(batch.column(m).to_pylist(), self.known[m])) for i, m in enumerate(self.match_cols)]
        alike, kind_of = np.unique(np.stack([pattern, *given], axis=1), axis=0, return_inverse=True)
        for i, kind in enumerate(alike):
            who, at = self.pattern == kind[0], np.flatnonzero(kind_of.ravel() == i)
            for code, mine in zip(kind[1:], self.codes.values(), strict=True):
                who = who & (mine == code)
            who = self._in_reach(np.flatnonzero(who), cell[at], gap[at])
            bound = self.most[who]
            for q, p, d in _near_pairs(self.q[who], c[at], bound, self.k):
                taken = batch.select([self.id_col, "_row", "_tag"]).take(pa.array(at[p]))
                self.held.append(pa.table([pa.array(who[q]), *taken.columns, pa.array(d)], names=["_q", self.id_col, "_row", "_tag", "distance"]))
                self.size += len(q)
                if self.size > 2 * len(self.q) * self.k + HELD_HITS:
                    self._cut()
            self.most[who] = np.minimum(self.most[who], bound)

    def _in_reach(self, who: np.ndarray, cell: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The queries for which some row of these cells may be within the k-th distance."""
        sure = np.isfinite(self.most[who])
        if not sure.any():
            return who
        cells, place = np.unique(cell, return_inverse=True)
        near, far = np.full(len(cells), np.inf), np.zeros(len(cells))
        np.minimum.at(near, place, gap)
        np.maximum.at(far, place, gap)
        most, reach = np.sqrt(self.most[who]) * (1 + 1e-9), ~sure
        for i, x in enumerate(cells):
            d = distances(self.q[who], self.pivots[x : x + 1])[:, 0]
            reach |= np.maximum(d - far[i], near[i] - d) * (1 - 1e-9) <= most
            if reach.all():
                break
        return who[reach]

    def _cut(self) -> None:
        """Hits beyond a query's k-th distance go; of equal distances at the k-th place, those of greater ids."""
        hits = pa.concat_tables(self.held)
        q, d = np.asarray(hits["_q"]), np.asarray(hits["distance"])
        order = np.lexsort((d, q))
        sorted_q, sorted_d = q[order], d[order]
        kth = _first_k(sorted_q, self.k)[1]
        self.most[sorted_q[kth]] = np.minimum(self.most[sorted_q[kth]], sorted_d[kth])
        hits = hits.filter(pa.array(d <= self.most[q]))
        if len(hits) > len(self.q) * self.k:
            hits = cut_hits(hits, self.k, [("distance", "ascending"), (self.id_col, "ascending")])
        self.held, self.size = [hits.combine_chunks()], len(hits)

    def result(self, n: int | None) -> pa.Table | None:
        """The k hits of every query, or those of them whose tag holds what the query wants, n at most."""
        if not self.held:
            return None
        hits = cut_hits(pa.concat_tables(self.held), self.k, [("distance", "ascending"), (self.id_col, "ascending")])
        if n is not None:
            q, good = np.asarray(hits["_q"]), np.zeros(len(hits), bool)
            tags = hits["_tag"].combine_chunks().dictionary_encode()
            texts, at = tags.dictionary.to_pylist(), np.asarray(tags.indices.fill_null(-1))
            wanted = {w: i for i, w in enumerate(dict.fromkeys(self.want))}
            asked = np.array([wanted[w] for w in self.want], np.int64)[q]
            for w, i in wanted.items():
                mine = np.flatnonzero(asked == i)
                if w is None:
                    good[mine] = True
                    continue
                there = np.unique(at[mine])
                holds = np.array([x >= 0 and w in texts[x] for x in there.tolist()], bool)
                good[mine] = holds[np.searchsorted(there, at[mine])]
            hits = hits.filter(pa.array(good))
            hits = hits.filter(pa.array(_first_k(np.asarray(hits["_q"]), n)[0]))
        return pa.table([self.ids.take(hits["_q"].combine_chunks()), hits[self.id_col], hits["_row"], hits["distance"]], names=[self.query_id, self.id_col, "_row", "distance"])


def _met(names: tuple[str, str, str], match_cols: list[str], pivots: np.ndarray, k: int, n: int | None):
    """Batches of blocks, each with its queries first, to the blocks' hits."""

    def run(batches):
        group, number = None, None
        for b in batches:
            blocks, is_row = np.asarray(b.column("_block")), np.asarray(b.column("_is_row"))
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(is_row) != 0)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if blocks[lo] != number:
                    if group is not None and (out := group.result(n)) is not None:
                        yield from out.to_batches(max_chunksize=100_000)
                    group, number = _Group(names, match_cols, pivots, k), blocks[lo]
                (group.meet if is_row[lo] else group.add)(b.slice(lo, hi - lo))
        if group is not None and (out := group.result(n)) is not None:
            yield from out.to_batches(max_chunksize=100_000)

    return run


def _search_many(queries: DataFrame, index: CellIndex, k: int, match_cols: list[str], keep_cols: list[str], query_id: str, blocks: int,
                 within: tuple[str, str, int] | None) -> DataFrame:
    """The hits of ``search`` without ranks; ``within``: of a query's k hits the n whose text of a column holds the query's."""
    spark, id_col, embedding, rows = queries.sparkSession, index.id_col, index.embedding, index.rows
    tag, want, n = within or (None, None, None)
    pattern = sum((F.when(F.col(m).isNull(), 1 << i).otherwise(0) for i, m in enumerate(match_cols)), F.lit(0)).alias("_pattern")
    asked = queries.select(query_id, embedding, *match_cols, (F.col(want) if want else F.lit(None)).cast("string").alias("_want"), pattern)
    schema = T.StructType([*asked.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_gap", T.DoubleType())])
    order = [*match_cols, "_cell", F.xxhash64(query_id)]
    dealt = materialize(asked.mapInArrow(_nearest(index.pivots, embedding), schema).repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()))
    kinds = materialize(dealt.groupBy("_block", "_pattern", *match_cols).agg(F.min("_cell").alias("_home")))
    few = kinds.count() <= MAX_BROADCAST_KINDS
    # nearest cells first, as seen from a block's first cell
    near = np.argsort(np.argsort(distances(index.pivots, index.pivots), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = spark.createDataFrame(pa.table({"_home": np.repeat(np.arange(len(near), dtype=np.int32), len(near)), "_cell": np.tile(np.arange(len(near), dtype=np.int32), len(near)),
                                            "_order": near.ravel().astype(np.int32)}))
    vectors = [F.lit(None).cast(rows.schema[embedding].dataType).alias("_vector")]
    kept = [id_col, "_row", "_cell", "_gap"]
    parts = [dealt.select("_block", F.lit(False).alias("_is_row"), "_pattern", F.lit(-1).alias("_order"), query_id, F.col(embedding).alias("_asked"), "_want", *vectors,
                          *[F.lit(None).cast(rows.schema[c].dataType).alias(f"_c_{c}") for c in kept], F.lit(None).cast("string").alias("_tag"),
                          *match_cols)]
    for p in [r[0] for r in kinds.select("_pattern").distinct().collect()]:  # at most 2 to the number of filters
        given = [m for i, m in enumerate(match_cols) if not p >> i & 1]
        mine = kinds.where(F.col("_pattern") == p).groupBy("_block", "_pattern", *given).agg(F.min("_home").alias("_home"))
        mine = F.broadcast(mine) if few or not given else mine
        met = (rows.join(mine, given) if given else rows.crossJoin(mine)).join(F.broadcast(ranks), ["_home", "_cell"])
        parts.append(met.select("_block", F.lit(True).alias("_is_row"), "_pattern", "_order", F.lit(None).cast(asked.schema[query_id].dataType).alias(query_id),
                                F.lit(None).cast(asked.schema[embedding].dataType).alias("_asked"), F.lit(None).cast("string").alias("_want"), F.col(embedding).alias("_vector"),
                                *[F.col(c).alias(f"_c_{c}") for c in kept], (F.col(tag) if tag else F.lit(None)).cast("string").alias("_tag"), *match_cols))
    both = reduce(lambda a, b: a.unionByName(b), parts).withColumnsRenamed({"_c__row": "_row", "_c__cell": "_cell", "_c__gap": "_gap"})
    both = both.repartitionByRange(2 * blocks, "_block")  # a task gets one block, where hashing would give some tasks several
    both = both.sortWithinPartitions("_block", "_is_row", "_pattern", "_order")
    fields = [T.StructField(query_id, asked.schema[query_id].dataType), T.StructField(f"_c_{id_col}", rows.schema[id_col].dataType), T.StructField("_row", T.LongType()), T.StructField("distance", T.DoubleType())]
    hits = both.mapInArrow(_met((query_id, f"_c_{id_col}", "_tag"), match_cols, index.pivots, k, n), T.StructType(fields)).withColumnRenamed(f"_c_{id_col}", id_col)
    extra = [c for c in keep_cols if c not in (id_col, embedding, query_id)]
    return (hits.join(rows.select("_row", *extra), "_row") if extra else hits).select(query_id, id_col, "distance", *extra)


# ------------------------------------------------------------------ many queries: every task holds the corpus
class _Tiles:
    """Rows of the corpus that one filter passes, nearest to a pivot first, as matrices of TILE_ROWS rows.

    The vectors are moved to the corpus' mean and scaled, and have the part of a row's squared size beyond the
    median as one more component, so that a product with (-2 q, 1) orders the rows by distance.
    """

    def __init__(self, corpus: _Corpus, rows: np.ndarray):
        n, dim = len(rows), corpus.vectors.shape[1]
        self.rows, self.points, own = rows, np.empty((n, dim + 1), np.float32), np.empty(n)
        for lo in range(0, n, HELD_ROWS):
            moved = corpus.moved(corpus.vectors[rows[lo : lo + HELD_ROWS]])
            own[lo : lo + HELD_ROWS] = (moved * moved).sum(axis=1)
            self.points[lo : lo + HELD_ROWS, :dim] = moved
        self.middle = float(np.median(own)) if n else 0.0
        self.points[:, dim] = own - self.middle
        self.starts = np.arange(0, n, TILE_ROWS)
        self.widest = np.maximum.reduceat(np.abs(own - self.middle), self.starts) if n else np.zeros(0)
        self.longest = np.sqrt(np.maximum.reduceat(own, self.starts)) if n else np.zeros(0)
        # runs of rows of one cell in one tile, with their nearest and farthest from the pivot
        cell, gap = corpus.cell[rows], corpus.gap[rows] * corpus.scale
        first = np.unique(np.append(self.starts, np.flatnonzero(np.diff(cell)) + 1)) if n else np.zeros(0, np.int64)
        self.run_cell, self.run_tile = cell[first], first // TILE_ROWS
        self.near, self.far = (np.minimum.reduceat(gap, first), np.maximum.reduceat(gap, first)) if n else (gap, gap)
        self.first_run = np.searchsorted(self.run_tile, np.arange(len(self.starts)))


class _Corpus:
    """The rows of the corpus, in the order of cells and distances from their pivots, and the filters' values."""

    def __init__(self, rows: pa.Table, pivots: np.ndarray, match_cols: list[str], embedding: str, id_col: str):
        cell, gap = np.asarray(rows["_cell"]), np.asarray(rows["_gap"])
        order = np.lexsort((gap, cell))
        place = pa.array(order)
        self.cell, self.gap, self.pivots = cell[order], gap[order], pivots
        self.ids, self.row = rows[id_col].combine_chunks().take(place), rows["_row"].combine_chunks().take(place)
        values = pc.list_flatten(rows[embedding].combine_chunks())
        values = values if values.type == pa.float32() else values.cast(pa.float64())
        self.vectors = np.asarray(values).reshape(len(order), pivots.shape[1])[order]
        self.by_id = np.empty(len(order), np.int64)
        self.by_id[np.asarray(pc.array_sort_indices(self.ids))] = np.arange(len(order))
        tags = rows["_tag"].combine_chunks().take(place).dictionary_encode()
        self.tags, self.tag = tags.dictionary.to_pylist(), np.asarray(tags.indices.fill_null(-1))
        self.known, self.codes = [], []
        for m in match_cols:
            found = rows[m].combine_chunks().take(place).dictionary_encode()
            self.known.append({v: i for i, v in enumerate(found.dictionary.to_pylist())})
            self.codes.append(np.asarray(found.indices.fill_null(-1)))
        self.mean = sum((self.vectors[lo : lo + HELD_ROWS].astype(float).sum(axis=0) for lo in range(0, len(order), HELD_ROWS)), np.zeros(pivots.shape[1])) / max(1, len(order))
        most = max((float(np.abs(self.vectors[lo : lo + HELD_ROWS] - self.mean).max()) for lo in range(0, len(order), HELD_ROWS)), default=0.0) * math.sqrt(pivots.shape[1])
        self.scale = 2.0 ** -math.ceil(math.log2(most)) if most > 0 else 1.0  # sizes are 1 at most
        self.held: dict[tuple, _Tiles] = {}
        self.rows_held = 0

    def moved(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.mean) * self.scale

    def tiles(self, kind: tuple) -> _Tiles:
        """The rows that the filters' codes (-1: any) pass; those last asked for are kept, as many rows as the corpus has."""
        if kind not in self.held:
            passed = np.ones(len(self.row), bool)
            for code, mine in zip(kind, self.codes, strict=True):
                passed &= (mine == code) if code != -1 else True
            made = _Tiles(self, np.flatnonzero(passed))
            if self.rows_held + len(made.rows) > len(self.row):
                self.held.clear()
                self.rows_held = 0
            self.held[kind] = made
            self.rows_held += len(made.rows)
        return self.held[kind]

    def nearest(self, q: np.ndarray, kinds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, squared distance) of the k nearest rows of every query (ties on id), queries and hits in order."""
        moved = self.moved(q)
        centres = self.moved(self.pivots)
        gaps = (moved * moved).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :]
        gaps -= 2 * (moved @ centres.T)
        home = gaps.argmin(axis=1)
        order = np.lexsort((home, *kinds.T)) if kinds.shape[1] else np.argsort(home, kind="stable")
        step = max(8, min(TILE_QUERIES, HELD_HITS // (4 * k + TILE_ROWS)))
        new_kind = np.flatnonzero((kinds[order][1:] != kinds[order][:-1]).any(axis=1)) + 1
        found = []
        for lo, hi in zip([0, *new_kind.tolist()], [*new_kind.tolist(), len(order)], strict=True):
            tiles = self.tiles(tuple(kinds[order[lo]].tolist())) if hi > lo else None
            for first in range(lo, hi, step):
                who = order[first : min(first + step, hi)]
                if tiles is not None and len(tiles.rows):
                    a, rows, d = _Best(self, tiles, q[who], moved[who], k).search(gaps[who], math.sqrt((centres * centres).sum(axis=1).max()))
                    found.append((who[a], rows, d))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        a, rows, d = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(a, kind="stable")
        return a[order], rows[order], d[order]


class _Best:
    """The nearest rows of some queries among the tiles met so far.

    A product in single precision differs from the true one by ``_margin`` at most: a row is held if it may be among
    the k nearest of a query, given that k rows are surely within ``most``.
    """

    def __init__(self, corpus: _Corpus, tiles: _Tiles, q: np.ndarray, moved: np.ndarray, k: int):
        self.corpus, self.tiles, self.q, self.k, (n, dim) = corpus, tiles, q, k, q.shape
        self.size = np.sqrt((moved * moved).sum(axis=1))
        self.unit = np.maximum(self.size, 1)  # so that products of far queries do not overflow
        # rounding of products in single precision, and of exact distances
        self.single, self.double = (dim + 16) * 2.0**-24, 4 * (dim + 8) * 2.0**-53
        self.per_length = 2 * (self.single + self.double) * self.size / self.unit
        self.least = self.double * self.size * (self.size / self.unit) + 1e-30
        self.factors = np.concatenate([-2 * moved, np.ones((n, 1))], axis=1) / self.unit[:, None]
        self.factors = self.factors.astype(np.float32)
        self.most = np.full(n, np.inf)
        self.width = 4 * k + TILE_ROWS
        self.value, self.row, self.count = np.full((n, self.width), np.inf, np.float32), np.zeros((n, self.width), np.int32), np.zeros(n, np.int64)
        self.new = 0
        self.products, self.mask = np.empty(n * TILE_ROWS, np.float32), np.empty(n * TILE_ROWS, bool)

    def _margin(self, who: np.ndarray | slice, tile: np.ndarray | int) -> np.ndarray:
        """For some queries, all of a tile or each with its own tiles."""
        wide, long = self.tiles.widest[tile], self.tiles.longest[tile]
        each = (self.least, self.per_length, self.unit) if np.ndim(tile) < 2 else (x[:, None] for x in (self.least, self.per_length, self.unit))
        least, per_length, unit = (x[who] for x in each)
        return least + per_length * long + (self.single * wide + self.double * long * long) / unit

    def search(self, gaps: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``gaps``: squared distances of the (moved) queries and pivots, which have lengths up to ``longest``."""
        t = self.tiles
        slack = 1e-13 * (self.size[:, None] + longest + 1) ** 2
        low, high = np.sqrt(np.maximum(gaps - slack, 0)), np.sqrt(np.maximum(gaps + slack, 0))
        bound = np.maximum(np.maximum(low[:, t.run_cell] - t.far, t.near - high[:, t.run_cell]), 0) * (1 - 1e-9)
        bound = np.minimum.reduceat(bound, t.first_run, axis=1)
        bound = bound * bound - (self.size * self.size + t.middle)[:, None]  # in terms of the products
        bound = bound * (1 / self.unit)[:, None] - 1e-12 * (1 + self.size[:, None])
        nearness = np.minimum.reduceat(low.mean(axis=0)[t.run_cell], t.first_run)
        for tile in np.argsort(nearness, kind="stable"):
            who = np.flatnonzero(bound[:, tile] <= self.most)
            if len(who):
                self._meet(int(tile), who)
        return self._result()

    def _meet(self, tile: int, who: np.ndarray) -> None:
        lo = int(self.tiles.starts[tile])
        points = self.tiles.points[lo : lo + TILE_ROWS]
        m, n = len(who), len(points)
        if int(self.count.max()) + n > self.width or self.new > 2 * self.k * len(self.q):
            self._cut()
            if int(self.count.max()) + n > self.width:
                self._settle()
        products = self.products[: m * n].reshape(m, n)
        np.matmul(self.factors[who] if m < len(self.q) else self.factors, points.T, out=products)
        margin, most = self._margin(who, tile), self.most[who]
        unknown = np.flatnonzero(np.isinf(most)) if n >= self.k else ()
        if len(unknown):
            most[unknown] = np.partition(products[unknown], self.k - 1, axis=1)[:, self.k - 1] + margin[unknown]
            self.most[who] = most
        limit = np.nextafter(np.minimum(most + margin, 3e38).astype(np.float32), np.float32(np.inf))
        mask = np.less_equal(products, limit[:, None], out=self.mask[: m * n].reshape(m, n)).ravel()
        if len(mask) % 8:
            at = np.flatnonzero(mask)
        else:  # eight at once, as few rows are near
            at = (np.flatnonzero(mask.view(np.uint64) != 0)[:, None] * 8 + np.arange(8)).ravel()
            at = at[mask[at]]
        if not len(at):
            return
        a = at // n
        each = np.bincount(a, minlength=m)
        column = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each) + self.count[who][a]
        self.value[who[a], column], self.row[who[a], column] = products.ravel()[at], lo + at - a * n
        self.count[who] += each
        self.new += len(a)

    def _cut(self) -> None:
        """Rows that are surely not among the k nearest go."""
        width = max(int(self.count.max()), 1)
        value, row = self.value[:, :width], self.row[:, :width]
        margin = self._margin(slice(None), row // TILE_ROWS)
        if width >= self.k:
            self.most = np.minimum(self.most, np.partition(value + margin, self.k - 1, axis=1)[:, self.k - 1])
        self._keep((value - margin <= self.most[:, None]) & (np.arange(width) < self.count[:, None]))

    def _keep(self, kept: np.ndarray) -> None:
        a, column = np.nonzero(kept)
        value, row, each = self.value[a, column], self.row[a, column], np.bincount(a, minlength=len(self.q))
        self.value[:, : kept.shape[1]] = np.inf
        column = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
        self.value[a, column], self.row[a, column] = value, row
        self.count, self.new = each, 0

    def _ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, column, row of the corpus, squared distance) of the k nearest of the rows held."""
        a, column = np.nonzero(np.arange(max(int(self.count.max()), 1)) < self.count[:, None])
        rows, exact = self.tiles.rows[self.row[a, column]], np.empty(len(a))
        step = max(1, HELD_DISTANCES // max(1, self.q.shape[1]))
        for lo in range(0, len(a), step):
            exact[lo : lo + step] = ((self.q[a[lo : lo + step]] - self.corpus.vectors[rows[lo : lo + step]]) ** 2).sum(axis=1)
        order = np.lexsort((self.corpus.by_id[rows], exact, a))
        order = order[_first_k(a[order], self.k)[0]]
        return a[order], column[order], rows[order], exact[order]

    def _settle(self) -> None:
        """Many rows are as near as the k-th one: those of greater ids go."""
        a, column, _, _ = self._ranked()
        kept = np.zeros((len(self.q), max(int(self.count.max()), 1)), bool)
        kept[a, column] = True
        self._keep(kept)

    def _result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._cut()
        a, _, rows, exact = self._ranked()
        return a, rows, exact


def _hold(tags: list[str], tag: np.ndarray, wants: list[str | None], asked: np.ndarray) -> np.ndarray:
    """Which hits' tags hold the text that their query wants (NULL: any)."""
    known = {w: i for i, w in enumerate(dict.fromkeys(wants))}
    texts, want = list(known), np.array([known[w] for w in wants], np.int64)[asked]
    good = want == known.get(None, -1)
    at = np.flatnonzero(~good & (tag >= 0))
    pairs, place = np.unique(want[at] * max(1, len(tags)) + tag[at], return_inverse=True)
    good[at] = np.array([texts[x // len(tags)] in tags[x % len(tags)] for x in pairs.tolist()], bool)[place]
    return good


def _search_held(queries: DataFrame, index: CellIndex, k: int, match_cols: list[str], keep_cols: list[str], query_id: str, blocks: int,
                 within: tuple[str, str, int] | None) -> DataFrame:
    """``_search_many`` for a corpus of at most MAX_CORPUS_BYTES, which goes to every task."""
    spark, id_col, embedding, rows = queries.sparkSession, index.id_col, index.embedding, index.rows
    tag, want, n = within or (None, None, None)
    extra = [c for c in keep_cols if c not in (id_col, embedding, query_id)]
    read = list(dict.fromkeys([id_col, embedding, "_cell", "_gap", "_row", *match_cols]))
    corpus = _Corpus(rows.select(*read, (F.col(tag) if tag else F.lit(None)).cast("string").alias("_tag")).toArrow(), index.pivots, match_cols, embedding, id_col)
    shared = spark.sparkContext.broadcast(corpus)
    dim = index.pivots.shape[1]

    def run(batches):
        corpus = shared.value
        for b in batches:
            good, q = whole_vectors(b.column(embedding), dim)
            b = b.take(pa.array(good))
            kinds = [np.array([-1 if v is None else known.get(v, -2) for v in b.column(m).to_pylist()], np.int64) for m, known in zip(match_cols, corpus.known, strict=True)]
            a, at, d = corpus.nearest(q, np.stack(kinds, axis=1) if kinds else np.zeros((len(q), 0), np.int64), k)
            if n is not None:
                kept = np.flatnonzero(_hold(corpus.tags, corpus.tag[at], b.column("_want").to_pylist(), a))
                kept = kept[_first_k(a[kept], n)[0]]
                a, at, d = a[kept], at[kept], d[kept]
            place = pa.array(at)
            out = pa.table([b.column(query_id).take(pa.array(a)), corpus.ids.take(place), corpus.row.take(place), pa.array(d)], names=[query_id, id_col, "_row", "distance"])
            yield from out.to_batches(max_chunksize=100_000)

    asked = queries.select(query_id, embedding, *match_cols, (F.col(want) if want else F.lit(None)).cast("string").alias("_want"))
    asked = asked.repartition(blocks, F.xxhash64(query_id, embedding))
    fields = [T.StructField(query_id, asked.schema[query_id].dataType), T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("_row", T.LongType()), T.StructField("distance", T.DoubleType())]
    hits = asked.mapInArrow(run, T.StructType(fields))
    return (hits.join(rows.select("_row", *extra), "_row") if extra else hits).select(query_id, id_col, "distance", *extra)


def _can_be_held(index: CellIndex, tag: str | None) -> bool:
    """Whether every task can hold the corpus: the rows' vectors, ids, tags and places."""
    n = index.stats.agg(F.sum("n")).first()[0] or 0
    width = index.pivots.shape[1] * (4 if isinstance(index.rows.schema[index.embedding].dataType.elementType, T.FloatType) else 8) + 128
    if not 0 < n * width <= MAX_CORPUS_BYTES:
        return False
    texts = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in (index.id_col, tag) if c), F.lit(0).cast("long"))
    return n * width + index.rows.agg(F.sum(texts)).first()[0] <= MAX_CORPUS_BYTES


def _many(queries: DataFrame, index: CellIndex, k: int, query_id: str) -> tuple[int, bool]:
    """Blocks of queries if their hits outweigh the corpus sent to all blocks (else 0), and whether query ids are unique."""
    n, ids = queries.agg(F.count(F.lit(1)), F.count_distinct(query_id)).first()
    if n * k <= HELD_HITS:
        return 0, n == ids
    cores, dim = queries.sparkSession.sparkContext.defaultParallelism, index.pivots.shape[1]
    corpus = index.stats.agg(F.sum("n")).first()[0] or 0
    blocks = max(-(-n * (dim * 8 + 64 + k * 48) // MAX_BLOCK_BYTES), 2 * cores)
    tasks = max(cores, corpus * dim * 8 // MAX_QUERY_BYTES)
    return (blocks if blocks * corpus <= 2 * n * k * tasks else 0), n == ids


def search(queries: DataFrame, index: CellIndex, k: int, *, match_cols: list[str] | None = None, keep_cols: list[str] | None = None,
           query_id: str = "query_id", within: tuple[str, str, int] | None = None) -> DataFrame:
    """The exact k nearest rows of every query (ties on id), with ``distance`` (squared) and ``rank``.

    ``within`` (column, query column, n): of a query's k hits only the n first whose text in ``column`` holds the
    query's text (NULL: any), ranked anew.
    """
    match_cols, keep_cols = list(match_cols or []), list(keep_cols or [])
    if set(match_cols) - set(index.match_cols):
        raise ValueError(f"the cells are dealt by {index.match_cols}, not by {match_cols}")
    blocks, unique = _many(queries, index, k, query_id)
    if blocks and (unique or not within):
        run = _search_held if _can_be_held(index, within and within[0]) else _search_many
        hits = run(queries, index, k, match_cols, keep_cols, query_id, blocks, within)
        return _ranked(hits, within[2] if within else k, query_id, index.id_col)
    if not within:
        return search_steps(queries, index, k, match_cols=match_cols, keep_cols=keep_cols, query_id=query_id)[0]
    column, want, n = within
    keep = list(dict.fromkeys([*keep_cols, column]))
    hits = search(queries, index, k, match_cols=match_cols, keep_cols=keep, query_id=query_id)
    asked = queries.select(F.col(query_id), F.col(want).cast("string").alias("_want"))
    kept = hits.join(asked, query_id).where(F.col("_want").isNull() | F.contains(F.col(column).cast("string"), F.col("_want"))).drop("rank", "_want")
    return _ranked(kept, n, query_id, index.id_col)
