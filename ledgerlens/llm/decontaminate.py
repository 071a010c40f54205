"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, lower-cased (ASCII).  A fixed mask picks WEIGHT of the words of a
window and ignores the others, so a substituted word at an ignored place does not change the hash.  The
hashes of all benchmark windows are joined with those of all document windows; each hit gives a diagonal
(document word minus item word) on which the texts are compared word by word.  A document overlaps an item
if some stretch of the diagonal scores SCORE or more, where an equal word counts 1 and a substitution -2;
an item too short for that asks for 4 of 5 of its words.  Items shorter than a window are looked up
whole; items under LEAST words say too little and match only documents that hold nothing else.

The benchmark is the stated query set: it goes in blocks of at most BLOCK stretches of STRETCH words
(a proven bound), each block against all documents, which are not shuffled.

Defined results: null texts count as empty and match nothing; repeated rows and items give a row each;
null ids stay null; extra columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .tokens import PUNCTUATION, buffers, windows, word_hashes

#: fixed masks: the places of a window that count
MASKS = [[0, 1, 2, 4, 7, 8, 10], [0, 1, 3, 4, 6, 9, 10], [0, 2, 3, 5, 6, 8, 10]]
SPAN = 11
SCORE = 10
LEAST = 4
STRETCH, BLOCK = 512, 8192

_SEGMENT = "item_id long, start long, words binary, whole boolean"
_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()),
                  ("n_words", pa.int64()), ("n_equal", pa.int64())])


def _stretches(batches):
    """Items in stretches of STRETCH words that overlap by a window and more."""
    schema = pa.schema([("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.binary()), ("whole", pa.bool_())])
    for b in batches:
        words, at = word_hashes(*buffers(b.column("text")), PUNCTUATION)
        out = {n: [] for n in schema.names}
        for r, item in enumerate(b.column("item_id").to_pylist()):
            w = words[at[r] : at[r + 1]]
            for start in range(0, max(len(w) - 4 * SPAN, 1), STRETCH - 4 * SPAN):
                for n, v in zip(schema.names, (item, start, w[start : start + STRETCH].tobytes(), len(w) <= STRETCH), strict=True):
                    out[n].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Score, first and end of the stretch with the highest sum (equal 1, else -2); the first of ties."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    return int(sums[end] - low[end]), int(np.argmax(sums[: end + 1] == low[end])), end


class Seeds:
    """The masked hashes of a block of benchmark stretches."""

    def __init__(self, rows: list):
        self.items = [r["item_id"] for r in rows]
        self.starts = [r["start"] for r in rows]
        self.words = [np.frombuffer(bytes(r["words"]), np.uint64) for r in rows]
        self.picks = {tuple(m) for m in MASKS} | {tuple(range(len(w))) for w in self.words if 0 < len(w) < SPAN}
        at = np.concatenate([[0], np.cumsum([len(w) for w in self.words])])
        every = np.concatenate(self.words) if rows else np.zeros(0, np.uint64)
        self.tables = []
        for picks in sorted(self.picks):
            h, first = windows(every, at, list(picks))
            which = np.searchsorted(at, first, "right") - 1
            if len(picks) == picks[-1] + 1:  # short items, whole
                full = np.diff(at)[which] == len(picks)
                h, first, which = h[full], first[full], which[full]
            order = np.argsort(h, kind="stable")
            near = np.zeros(1 << 20, bool)
            near[(h >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((list(picks), near, h[order], which[order], (first - at[which])[order]))

    def hits(self, words: np.ndarray, at: np.ndarray):
        """Distinct (row, stretch, diagonal)."""
        found = set()
        for picks, near, hashes, which, place in self.tables:
            h, first = windows(words, at, picks)
            maybe = np.flatnonzero(near[(h >> np.uint64(44)).astype(np.int64)])
            lo = np.searchsorted(hashes, h[maybe], "left")
            n = np.searchsorted(hashes, h[maybe], "right") - lo
            maybe, lo, n = maybe[n > 0], lo[n > 0], n[n > 0]
            entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start = np.repeat(first[maybe], n)
            row = np.searchsorted(at, start, "right") - 1
            found.update(zip(row.tolist(), which[entry].tolist(), (start - at[row] - place[entry]).tolist(), strict=True))
        return sorted(found)

    def overlaps(self, words: np.ndarray, at: np.ndarray):
        """(row, item, first word in the row and the item, words, equal words), the best per row and stretch."""
        best = {}
        for row, s, diagonal in self.hits(words, at):
            doc, item = words[at[row] : at[row + 1]], self.words[s]
            lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
            equal = doc[lo + diagonal : hi + diagonal] == item[lo:hi]
            if len(item) < LEAST:
                ok = len(doc) == len(item) and bool(equal.all())
                score, a, z = len(item), 0, len(item)
            elif len(item) * 4 < SCORE * 5:
                ok, a, z = int(equal.sum()) * 5 >= len(item) * 4, 0, hi - lo
                score = int(equal.sum())
            else:
                score, a, z = best_stretch(equal)
                ok = score >= SCORE
            key = (row, s)
            if ok and (key not in best or score > best[key][0]):
                best[key] = (score, lo + a + diagonal, self.starts[s] + lo + a, z - a, int(equal[a:z].sum()))
        return [(row, self.items[s], *v[1:]) for (row, s), v in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = items.mapInArrow(_stretches, _SEGMENT)
    blocks = max(1, -(-rows.count() * 5 // (BLOCK * 4)))  # even dealing stays under BLOCK by a fifth
    if blocks == 1:
        yield Seeds(rows.limit(BLOCK).collect())
        return
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "start", "words"), F.lit(blocks))).checkpoint()
    for b in range(blocks):
        yield Seeds(rows.where(F.col("block") == b).collect())


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, doc_start, item_start, n_words, n_equal`` (word places) of every overlapping pair."""
    spark, parts = docs.sparkSession, []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for seeds in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(seeds)

        def run(batches, shared=shared):
            for b in (p for whole in batches for p in pieces(whole)):
                words, at = word_hashes(*buffers(b.column("text")), PUNCTUATION)
                ids = b.column("doc_id").to_pylist()
                got = shared.value.overlaps(words, at)
                yield pa.RecordBatch.from_pydict({n: [(ids[g[0]] if i == 0 else g[i]) for g in got] for i, n in enumerate(_HIT.names)}, schema=_HIT)

        parts.append(rows.mapInArrow(run, ", ".join(f"{n} long" for n in _HIT.names)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they are, that overlap no item."""
    kept = docs
    for seeds in _blocks(benchmark, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches, shared=shared):
            for b in (p for whole in batches for p in pieces(whole, text_col)):
                words, at = word_hashes(*buffers(b.column(text_col)), PUNCTUATION)
                mask = np.ones(b.num_rows, bool)
                mask[[g[0] for g in shared.value.overlaps(words, at)]] = False
                yield b.filter(pa.array(mask))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
