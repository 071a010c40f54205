"""Cells: the exact neighbours, what is skipped, edge rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import retrieval as rt
from ledgerlens.operators import vector_search as vs

SCHEMA = "id long, embedding array<double>, ticker string, year int, text string"


def corpus_rows(n=900, dim=6, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 20, (12, dim))
    rows = [(i, (centres[i % 12] + r.normal(0, 1, dim)).tolist(), [None, "A", "B", "C"][i % 4], [2019, 2020, None][i % 3], f"t{i}") for i in range(n)]
    same = [0.5] * dim
    rows += [(10_000 + i, same, "A", 2019, "same") for i in range(300)]  # ties, and one hot cell
    rows += [(20_000, None, "A", 2019, "x"), (20_001, same[:-1], "A", 2019, "x"), (20_002, [None, *same[1:]], "A", 2019, "x"), (20_003, [float("nan"), *same[1:]], "A", 2019, "x"), (20_004, [], "A", 2019, "x")]
    return rows


def brute_force(queries, rows, k, cols):
    out, dim = [], max(len(q[1]) for q in queries if q[1])
    good = [r for r in rows if r[1] is not None and len(r[1]) == dim and None not in r[1] and not np.isnan(r[1]).any()]
    for q in queries:
        if q[1] is None or len(q[1]) != dim:
            continue
        want = {"ticker": q[2], "year": q[3]}
        at = {"ticker": 2, "year": 3}
        hits = sorted((float(((np.array(q[1]) - np.array(r[1])) ** 2).sum()), r[0]) for r in good if all(want[c] is None or r[at[c]] == want[c] for c in cols))
        out += [(q[0], i + 1, h[1]) for i, h in enumerate(hits[:k])]
    return sorted(out)


QUERIES = [(i, r[1], [None, "A", "C", "Z"][i % 4], [None, 2020, 1990][i % 3]) for i, r in enumerate(corpus_rows(60, seed=3)[:60])]
QUERIES += [(100, [0.5] * 6, None, None), (101, [0.5] * 6, "A", 2019), (102, None, None, None), (103, [1.0], None, None)]


@pytest.fixture(scope="module")
def tables(spark):
    corpus = spark.createDataFrame(corpus_rows(), SCHEMA).repartition(5)
    return spark.createDataFrame(QUERIES, "query_id long, embedding array<double>, ticker string, year int"), corpus


@pytest.mark.parametrize("cols", [[], ["ticker"], ["ticker", "year"]])
@pytest.mark.parametrize("k", [1, 7])
def test_equals_brute_force(tables, cols, k):
    q, c = tables
    got = rt.vector_topk(q, c, k, match_cols=cols, keep_cols=["text"])
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == brute_force(QUERIES, corpus_rows(), k, cols)


def test_blocks_and_small_holds(tables, monkeypatch):
    q, c = tables
    monkeypatch.setattr(vs, "MAX_QUERY_BYTES", 900)
    got = rt.vector_topk(q, c, 4, match_cols=["ticker"])
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == brute_force(QUERIES, corpus_rows(), 4, ["ticker"])


def test_cells_are_skipped_and_one_index_serves_many_searches(tables):
    q, c = tables
    index = vs.deal_cells(c, match_cols=["ticker", "year"], keep_cols=["text"], pivots=40)
    for cols in ([], ["ticker", "year"]):
        hits, first, second = vs.search_steps(q, index, 5, match_cols=cols)
        assert sorted((r.query_id, r["rank"], r.id) for r in hits.collect()) == brute_force(QUERIES, corpus_rows(), 5, cols)
        read = first.agg(F.sum("_read")).first()[0] + (second.agg(F.sum("_read")).first()[0] or 0)
        assert read < first.agg(F.sum("_all")).first()[0] / 2
    fixed = rt.vector_topk(q, c, 5, filters={"ticker": "A"}, index=index)
    assert sorted((r.query_id, r["rank"], r.id) for r in fixed.collect()) == brute_force([(*x[:2], "A", None) for x in QUERIES], corpus_rows(), 5, ["ticker"])
    with pytest.raises(ValueError, match="dealt by"):
        vs.search(q, index, 1, match_cols=["text"])


def test_products_are_made_only_where_a_query_may_match(tables):
    """The rows multiplied in a task are those of the chosen cells that pass the query's filters."""
    q, c = tables
    index = vs.deal_cells(c, match_cols=["ticker"], pivots=20)
    _, first, _ = vs.search_steps(q, index, 5, match_cols=["ticker"])
    block = vs._Block(first.toArrow(), "query_id", "embedding", ["ticker"], len(index.pivots), index.pivots.shape[1], 5)
    made = sum(block.near(b, "embedding")[3] for b in index.rows.toArrow().to_batches())
    assert made == first.agg(F.sum("_read")).first()[0]


def test_files_hold_few_cells_and_passes_read_chosen_ones(tables):
    _, c = tables
    index = vs.deal_cells(c, match_cols=["ticker"], pivots=20)
    one = index.rows.where(F.col("_cell").isin([3]))
    assert "PartitionFilters: [isnotnull(_cell" in one._jdf.queryExecution().executedPlan().toString() or "_cell" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]
    assert len(index.rows.inputFiles()) <= len(index.pivots) + 2 * 4


def test_empty_tables(tables):
    q, c = tables
    assert rt.vector_topk(q, c.limit(0), 3).count() == 0
    assert rt.vector_topk(q.limit(0), c, 3, match_cols=["ticker"]).count() == 0
    assert rt.vector_topk(q, c.limit(0), 3, match_cols=["ticker"]).count() == 0


@pytest.mark.parametrize(("cols", "k"), [([], 1), (["ticker", "year"], 7)])
def test_corpus_that_goes_to_many_queries_gives_the_same(tables, monkeypatch, cols, k):
    q, c = tables
    monkeypatch.setattr(vs, "_many", lambda *a: (5, True))
    got = rt.vector_topk(q, c, k, match_cols=cols, keep_cols=["text"]).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == brute_force(QUERIES, corpus_rows(), k, cols)
    texts = {r[0]: r[4] for r in corpus_rows()}
    assert all(r.text == texts[r.id] for r in got)


@pytest.mark.parametrize("many", [(0, True), (5, True)])
def test_years_of_the_widened_hits(tables, monkeypatch, many):
    """Of the 12 nearest rows of a ticker those of the query's year, 3 at most: in the search or after it."""
    q, c = tables
    monkeypatch.setattr(vs, "_many", lambda *a: many)
    asked = q.select("query_id", "embedding", "ticker", F.when(F.col("query_id") % 2 == 0, 2020).alias("wanted"))
    dated = c.withColumn("filing_date", F.make_date("year", F.lit(1), F.lit(2)))
    got = rt.vector_topk_overfetch_year(asked, dated, 3, year_col="wanted", overfetch=4, match_cols=["ticker"], keep_cols=["text"])
    years, want = {r[0]: r[3] for r in corpus_rows()}, {}
    for i, _, x in brute_force(QUERIES, corpus_rows(), 12, ["ticker"]):
        if i % 2 or years[x] == 2020:
            want.setdefault(i, []).append(x)
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == sorted((i, n + 1, x) for i, xs in want.items() for n, x in enumerate(xs[:3]))


def test_few_rows_per_cell_hold_no_more_than_the_hits(monkeypatch):
    """Cells with fewer rows than k give all their rows as hits: what is held stays bounded over the cells of a batch."""
    r = np.random.default_rng(5)
    monkeypatch.setattr(vs, "HELD_HITS", 1000)
    n, cells, k = 40, 100, 20
    rows = pa.table({"query_id": list(range(n)), "embedding": r.normal(size=(n, 4)).tolist(), "_chosen": [bytes([255] * 13)] * n})
    block = vs._Block(rows, "query_id", "embedding", [], cells, 4, k)
    sizes, least = [], vs._Block._least
    monkeypatch.setattr(vs._Block, "_least", lambda self, found, most: (sizes.append(sum(len(x[0]) for x in found)), least(self, found, most))[1])
    batch = pa.record_batch({"id": list(range(1500)), "embedding": r.normal(size=(1500, 4)).tolist(), "_cell": [i // 15 for i in range(1500)]})
    q, _, _, made = block.near(batch, "embedding", "id")
    assert made == n * 1500 and len(q) == n * k and max(sizes) <= 2 * 1000 + n * 15  # of 60,000


def test_a_block_cuts_its_hits_and_keeps_the_least_ids(monkeypatch):
    r = np.random.default_rng(6)
    monkeypatch.setattr(vs, "HELD_HITS", 10)
    monkeypatch.setattr(vs, "HELD_DISTANCES", 300)
    points = np.repeat(r.normal(size=(60, 3)), 4, axis=0)  # four copies each: ties
    q, pivots, ids = r.normal(size=(9, 3)), points[:20:4], r.permutation(240)
    cell = ((points[:, None] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1).astype(np.int32)
    order = np.argsort(cell, kind="stable")
    queries = pa.record_batch({"query_id": list(range(9)), "_block": [0] * 9, "_is_row": [False] * 9, "_asked": q.tolist(), "_pattern": [0] * 9, "_want": [None, "a", "b"] * 3})
    rows = [pa.record_batch({"id": ids[at], "_row": at, "_block": [0] * len(at), "_is_row": [True] * len(at), "_vector": points[at].tolist(), "_pattern": [0] * len(at), "_cell": cell[at],
                             "_gap": np.sqrt(((points[at] - pivots[cell[at]]) ** 2).sum(axis=1)), "_tag": ["ab"[i % 2] for i in ids[at]]}) for at in np.array_split(order, 7)]
    for k, n in ((10, None), (10, 3)):
        found = [(x["query_id"], x["id"]) for b in _stream(vs._met(("query_id", "id", "_tag"), [], pivots, k, n), queries, rows) for x in b.to_pylist()]
        want = []
        for i in range(9):
            near = sorted((float(((q[i] - p) ** 2).sum()), int(x)) for p, x in zip(points, ids, strict=True))[:k]
            wanted = [None, "a", "b"][i % 3]
            want += [(i, x) for _, x in near if n is None or wanted is None or "ab"[x % 2] == wanted][: n if n else k * (i + 1)][:k]
        assert sorted(found) == sorted(want)


def _stream(run, queries, rows):
    """Queries and rows as the columns that the shuffle brings, each with NULLs for the other's."""
    both = pa.concat_tables([pa.Table.from_batches([b]) for b in (queries, *rows)], promote_options="default")
    return run(iter(both.to_batches(max_chunksize=50)))


@pytest.mark.parametrize("most", [1000, 20])
def test_all_pairs_equal_the_join(tables, most):
    """Every pair of the nested-loop join, with its distance to the last bit and NULL for vectors that do not fit."""
    q, c = tables
    got = rt.query_corpus_cross(q, c, match_cols=["ticker"], keep_cols=["text"], max_broadcast=most)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoopJoin" not in plan
    a, b = q.alias("a"), c.alias("b")
    want = a.join(b, F.col("a.ticker").isNull() | (F.col("a.ticker") == F.col("b.ticker"))).select(
        "a.query_id", "b.id", rt.squared_l2(F.col("a.embedding"), F.col("b.embedding")).alias("distance"), "b.text")
    rows = lambda df: sorted((r.query_id, r.id, str(r.distance), r.text) for r in df.collect())
    assert rows(got) == rows(want)


@pytest.mark.parametrize("bytes_held", [vs.MAX_CORPUS_BYTES, 0])
def test_a_small_corpus_goes_to_every_task_and_is_not_shuffled(tables, monkeypatch, bytes_held):
    """The same hits where every task holds the corpus and where it goes to blocks of queries; only these shuffle it."""
    q, c = tables
    monkeypatch.setattr(vs, "_many", lambda *a: (5, True))
    monkeypatch.setattr(vs, "MAX_CORPUS_BYTES", bytes_held)
    monkeypatch.setattr(vs, "TILE_ROWS", 64)
    asked = q.select("query_id", "embedding", "ticker", F.when(F.col("query_id") % 2 == 0, "2020").alias("wanted"))
    index = vs.deal_cells(c, match_cols=["ticker"], keep_cols=["text", "year"])
    got = vs.search(asked, index, 12, match_cols=["ticker"], keep_cols=["text"])
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == brute_force(QUERIES, corpus_rows(), 12, ["ticker"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("_is_row" in plan) == (not bytes_held)
    texts, years, want = {r[0]: r[4] for r in corpus_rows()}, {r[0]: r[3] for r in corpus_rows()}, {}
    assert all(r.text == texts[r.id] for r in got.collect())
    for i, _, x in brute_force(QUERIES, corpus_rows(), 12, ["ticker"]):
        if i % 2 or years[x] == 2020:
            want.setdefault(i, []).append(x)
    some = vs.search(asked, index, 12, match_cols=["ticker"], within=("year", "wanted", 3))
    assert sorted((r.query_id, r["rank"], r.id) for r in some.collect()) == sorted((i, n + 1, x) for i, xs in want.items() for n, x in enumerate(xs[:3]))


def _held(points, cells, ids, codes=None):
    """A corpus as a task holds it: the first ``cells`` points are the pivots."""
    pivots = points[:cells].astype(float)
    cell = np.stack([((points - p) ** 2).sum(axis=1) for p in pivots]).argmin(axis=0).astype(np.int32)
    rows = pa.table({"id": ids, "embedding": pa.array(points.tolist(), pa.list_(pa.from_numpy_dtype(points.dtype))), "_cell": cell, "_gap": np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1)),
                     "_row": np.arange(len(points)), "_tag": pa.nulls(len(points), pa.string()), "m": codes if codes is not None else [0] * len(points)})
    return vs._Corpus(rows, pivots, ["m"], "embedding", "id")


def _sphere(r, n, dim):
    x = r.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _odd_vectors():
    r = np.random.default_rng(8)
    centres = r.normal(0, 20, (20, 6))
    far = _sphere(r, 900, 6)
    far[5] *= 1e9
    far[17] *= 1e5
    return {
        "unit": (_sphere(r, 900, 16).astype(np.float32), _sphere(r, 90, 16)),
        "near the centre": (_sphere(r, 900, 16).astype(np.float32), _sphere(r, 90, 16) * 0.007),
        "clusters": (centres[r.integers(0, 20, 900)] + r.normal(size=(900, 6)), centres[r.integers(0, 20, 90)] + r.normal(size=(90, 6))),
        "many ties": (np.repeat(_sphere(r, 9, 6), 100, axis=0), _sphere(r, 40, 6)),
        "all alike": (np.ones((700, 4)), r.normal(size=(20, 4))),
        "whole numbers": (r.integers(0, 3, (900, 4)).astype(np.float32), r.integers(0, 3, (60, 4)).astype(float)),
        "far from zero": (_sphere(r, 900, 6) + 1e8, _sphere(r, 30, 6) + 1e8),
        "a few very long": (far, _sphere(r, 30, 6)),
        "far queries": (_sphere(r, 900, 6), _sphere(r, 30, 6) * 1e60),
        "tiny": (_sphere(r, 900, 6) * 1e-30, _sphere(r, 30, 6) * 1e-30),
        "one component": (r.normal(size=(900, 1)), r.normal(size=(60, 1))),
        "fewer rows than k": (_sphere(r, 5, 6), _sphere(r, 30, 6)),
    }


@pytest.mark.parametrize("kind", list(_odd_vectors()))
def test_a_held_corpus_gives_the_exact_neighbours(monkeypatch, kind):
    """Single precision only chooses the rows whose exact distances are taken: distances and ties are exact."""
    monkeypatch.setattr(vs, "TILE_ROWS", 104)
    monkeypatch.setattr(vs, "TILE_QUERIES", 25)
    points, q = _odd_vectors()[kind]
    r = np.random.default_rng(9)
    ids, codes, kinds = r.permutation(len(points)), r.integers(0, 3, len(points)), r.integers(-1, 4, (len(q), 1))
    kinds[kinds == 3] = -2  # a value that no row has
    corpus = _held(points, min(15, len(points)), ids, pa.array([["a", "b", None][x] for x in codes]))
    name = {"a": 0, "b": 1}
    asked = np.array([[-1 if x == -1 else corpus.known[0].get(["a", "b"][x], -2) if x in (0, 1) else -2] for x in kinds[:, 0]])
    a, at, d = corpus.nearest(q, asked, 7)
    got = [(int(i), int(corpus.ids[int(x)].as_py()), float(y)) for i, x, y in zip(a, at, d, strict=True)]
    want = []
    for i, v in enumerate(q):
        mine = [n for n in range(len(points)) if kinds[i, 0] == -1 or (codes[n] in name.values() and codes[n] == kinds[i, 0])]
        exact = ((v - points[mine].astype(float)) ** 2).sum(axis=1)
        want += [(i, x, y) for y, x in sorted(zip(exact.tolist(), ids[mine].tolist(), strict=True))[:7]]
    assert got == want


def test_exact_distances_are_taken_of_few_rows_only(monkeypatch):
    """Of 20,000 rows some more than k per query get an exact distance."""
    r = np.random.default_rng(10)
    corpus = _held(_sphere(r, 20_000, 16).astype(np.float32), 70, np.arange(20_000))
    ranked, counts = vs._Best._ranked, []
    monkeypatch.setattr(vs._Best, "_ranked", lambda self: (counts.append(int(self.count.sum())), ranked(self))[1])
    a, _, _ = corpus.nearest(_sphere(r, 300, 16), np.full((300, 1), -1), 50)
    assert len(a) == 300 * 50 and sum(counts) < 1.1 * len(a)
