"""Audit of five text filters in every order: what each removes, repeats, and alone would catch.

One pass of a byte transducer per text counts words, capitals, code points and symbols and puts the word spans
into a hash table whose hits are verified byte by byte, which gives the distinct words (``measures``).  A text's
failing filters are a set of five bits.  Counts per part and set are all that the orders need: whatever the
order, a document goes at its first failing filter.  So 32 counts a part become 120 orders of 5 steps.

Duplicates are found without gathering a group: the least id of a text comes from a partially combined minimum
by SHA-256, and a row is the first of its text if it holds that id, which is an equi-join on (id, text).
Repeated rows are counted together before that, so no join key is hot.

Defined results: null text and null source count as empty; a null id has no order, so it is no duplicate and makes
none; rows that repeat an id and text are all its first; of several labels of an id any that says so counts;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

from .common import batch, pieces
from .spans import CAPITAL, POINT, SYMBOL, Run, SpanTable, padded, words_of
from .tokens import SPACES, buffers

# FIXED VALUES: limits of the filters
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, "#$%&*|"
LETTERS = "ABCDE"

_BYTES = np.arange(256)
MACHINE = words_of(~SPACES, (_BYTES >= 65) & (_BYTES <= 90), np.isin(_BYTES, list(SYMBOLS.encode())))
_MEASURES = "id long, part string, digest binary, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long"


def measure_texts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of every row."""
    raw = padded(raw)
    run, table = Run(MACHINE, raw, offsets, (POINT, CAPITAL, SYMBOL)), SpanTable(raw)
    rows = len(offsets) - 1
    words = np.zeros(rows, np.int64)
    for row, starts, ends in run.words():
        words += np.bincount(row, minlength=rows)
        table.insert(row, starts, ends - starts)
    return {"n_words": words, "n_distinct": np.bincount(table.groups[: table.n], minlength=rows), "n_capitals": run.count(CAPITAL),
            "n_points": run.count(POINT), "n_symbols": run.count(SYMBOL)}


def _measure(batches):
    schema = pa.schema([("id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), *[(n, pa.int64()) for n in ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")]])
    for whole in batches:
        for b in pieces(whole):
            raw, offsets = buffers(b.column("text"))
            digests = [hashlib.sha256(raw[lo:hi]).digest() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield batch(schema, {"id": b.column("id"), "part": b.column("part"), "digest": pa.array(digests, pa.binary()), **measure_texts(raw, offsets)})


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id, part, digest`` (SHA-256 of the text) and the transducer's counts of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(part_col), F.lit("")).alias("part"))
    return rows.mapInArrow(_measure, _MEASURES)


def failing(words: str = "n_words") -> list[Column]:
    """Whether a row of ``measures`` fails filter A, B, C, D."""
    return [F.col(words) < LEAST_WORDS, 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col(words),
            100 * F.col("n_capitals") > CAPITAL_PERCENT * F.col("n_points"), F.col("n_symbols") > 0]


def failure_sets(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """``part, fails`` (bits of A to E) with the number of documents, of good ones and of toxic ones."""
    ensure_checkpoint_dir(docs.sparkSession)
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failing())), F.lit(0))
    rows = measures(docs, **columns).select("id", "part", "digest", bits.alias("fails"))
    # repeated rows together; ids that are null are spread by their text, as none has a label
    rows = rows.groupBy("id", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("known", F.col("id").isNotNull()).withColumn("key", F.coalesce("id", F.xxhash64("digest")))
    marks = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("quality"), F.col("toxic")).where(F.col("key").isNotNull())
    marks = marks.groupBy("key").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks.withColumn("known", F.lit(True)), ["key", "known"], "left").drop("key", "known").checkpoint()
    firsts = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    again = F.when(F.col("id").isNotNull() & F.col("first").isNull(), F.lit(16)).otherwise(F.lit(0))
    rows = rows.join(firsts, ["id", "digest"], "left").withColumn("fails", F.col("fails") + again)
    return rows.groupBy("part", "fails").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
                                             F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def _steps() -> Column:
    """The 80 pairs of a filter and a set of filters before it, each with the orders that hold it."""
    orders: dict[tuple[int, int], list[str]] = {}
    for order in permutations(range(5)):
        before = 0
        for f in order:
            orders.setdefault((1 << f, before), []).append("".join(LETTERS[i] for i in order))
            before |= 1 << f
    return F.array(*[F.struct(F.lit(f).alias("own"), F.lit(b).alias("before"), F.lit(b.bit_count() + 1).alias("step"), F.array(*[F.lit(o) for o in names]).alias("orders"))
                     for (f, b), names in sorted(orders.items())])


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    cells = failure_sets(docs, labels, **columns).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    rows = cells.select("part", "cells", F.explode(_steps()).alias("s")).select("part", "cells", "s.*")

    def total(where: str, value: str = "c.n") -> Column:
        return F.expr(f"aggregate(filter(cells, c -> {where}), 0L, (a, c) -> a + {value})")

    here = "(c.fails & own) <> 0 AND (c.fails & before) = 0"
    return rows.select(
        "part", F.explode("orders").alias("filter_order"), "step",
        total("(c.fails & (own | before)) = 0").alias("kept"), total(here).alias("removed"),
        total("(c.fails & own) <> 0 AND (c.fails & before) <> 0").alias("redundant"), total("c.fails = own").alias("unique_fails"),
        total(here, "c.good").alias("good_lost"), total(here, "c.toxic").alias("toxic_lost"),
        # of the 120 orders, each of a document's failing filters comes first in an equal share
        total("(c.fails & own) <> 0", "CAST(c.n * (120 DIV bit_count(c.fails)) AS BIGINT)").alias("shapley"))
