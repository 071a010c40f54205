"""Which sources of a language differ, and by which terms: an exact recount over minimal perfect hashes.

First pass: document frequencies of (language, term), combined exactly (by the terms' bytes) in every task; a
grouped sum keeps the terms of enough documents.  The kept terms are dealt to shards by hash, and a task per
language and shard builds a minimal perfect hash: at each level, keys that meet no other key set a bit, the others go
on to the next level, and a key's slot is the rank of its bit.  The terms themselves are stored by slot.

The shards are published as files in the shared checkpoint folder, which workers map into memory: a broadcast
without a bound on its size in any process.  Second pass: every distinct term of a slice of texts is looked up, its
bytes are compared with the stored key, and its occurrences go to its slot.  Partial counts per group and shard meet in
one dense array of the shard's slots.  A group is a (language, source); a language counts as a group of its own.

p = 1 + floor(SCALE * (count + 1) / (N + V)) and f = floor((p - q)^2 / q) are whole numbers throughout.  Pairs of
sources are computed in tiles of blocks of sources by shards of terms, and summed over the shards.

Defined results: null text, lang and source count as empty; repeated rows count each; a group without terms has
count 0 for every kept term; without kept terms all pairs have value 0; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import pack, save, shared_folder, slim, unpack
from .common import batch, by_group, pieces
from .spans import PAD, Run, SpanTable, padded, same_spans, span_hashes, words_of
from .tokens import LOWER, buffers, mix

# FIXED VALUES: least documents of a kept term, scale of p, ranks of the terms
LEAST_DOCUMENTS, SCALE, TERM_RANKS = 3, 1_000_000_000, 200
#: terms of a shard (a power of two of shards has at most so many on average), sources of a block
SHARD_TERMS, BLOCK = 1 << 15, 32
#: levels of a perfect hash before the keys that are left are searched
LEVELS = 32
#: entries that a task holds before it combines them, and sends them on if as many are left
HELD = 1 << 20

_BYTES = np.arange(256)
_NONE = np.zeros(256, bool)
MACHINE = words_of((_BYTES >= 128) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)), _NONE, _NONE)
#: what a level adds to a hash
_STEPS = (np.arange(1, LEVELS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_SHARD = np.uint64(0x8EBC6AF09C88C6E3)


def span_array(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The spans as an Arrow binary column."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[at]))])


def distinct_terms(raw: np.ndarray, offsets: np.ndarray, groups: np.ndarray):
    """Exact table of the terms of ``raw`` (padded, lower case) by group, and (row, number) of every occurrence."""
    run, table = Run(MACHINE, raw, offsets), SpanTable(raw)
    for rows, starts, ends in run.words():
        yield table, rows, table.insert(groups[rows], starts, ends - starts)


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    encoded = pc.dictionary_encode(column)
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    return np.asarray(encoded.indices).astype(np.int64), encoded.dictionary.to_pylist()


# ------------------------------------------------------------------ first pass
def _frequencies(batches):
    """(lang, term, documents) of the task, combined whenever HELD entries are there."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def combined(held):
        return pa.concat_tables(held).group_by(["lang", "term"]).aggregate([("n", "sum")]).rename_columns(["lang", "term", "n"])

    held, size = [], 0
    for whole in batches:
        for b in pieces(whole):
            raw, offsets = buffers(b.column("text"))
            raw = padded(LOWER[raw])
            langs, names = _codes(b.column("lang"))
            table, seen = None, []
            for table, rows, ids in distinct_terms(raw, offsets, langs):  # noqa: B007
                seen.append(np.unique(rows << 32 | ids))
            if not seen or not table.n:
                continue
            documents = np.bincount(np.unique(np.concatenate(seen)) & 0xFFFFFFFF, minlength=table.n)
            terms = span_array(raw, table.starts[: table.n], table.sizes[: table.n]).cast(pa.large_string())
            held.append(pa.table({"lang": pa.array(names, pa.string()).take(pa.array(table.groups[: table.n])), "term": terms, "n": documents}))
            size += table.n
            if size > HELD:
                held = [combined(held)]
                size = len(held[0])
                if size > HELD:
                    yield from held[0].cast(schema).to_batches(1 << 16)
                    held, size = [], 0
    if held:
        yield from combined(held).cast(schema).to_batches(1 << 16)


# ------------------------------------------------------------------ perfect hashes
class PerfectHash:
    """Slots 0 to n - 1 of n hashes.  Equal hashes and what no level takes come last, in the order of their hashes."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, spare: np.ndarray):
        self.sizes, self.words, self.spare = sizes, words, spare
        self.ranks = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
        self.taken = int(np.bitwise_count(words).sum())

    @staticmethod
    def places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((mix(hashes + _STEPS[level]) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray, levels: int = LEVELS) -> PerfectHash:
        sizes, words, left = [], [], hashes
        while len(left) and len(sizes) < levels:
            size = -(-2 * len(left) // 64) * 64
            at = cls.places(left, len(sizes), size)
            n = np.bincount(at, minlength=size)
            words.append(np.packbits(n == 1, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[n[at] > 1]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64), np.sort(left))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each held hash (any slot, or -1, for another; the first one of equal spare hashes)."""
        out, todo, base = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = self.places(hashes[todo], level, size)
            word, bit = self.words[base + (at >> 6)], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) != 0
            rank = self.ranks[base + (at >> 6)] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = rank[hit]
            todo, base = todo[~hit], base + size // 64
        if len(self.spare) and len(todo):
            at = np.searchsorted(self.spare, hashes[todo])
            hit = self.spare[np.minimum(at, len(self.spare) - 1)] == hashes[todo]
            out[todo[hit & (at < len(self.spare))]] = self.taken + at[hit & (at < len(self.spare))]
        return out


class Shard:
    """The terms of a language and shard: a perfect hash and the stored keys by slot."""

    def __init__(self, hash_: PerfectHash, at: np.ndarray, raw: np.ndarray):
        self.hash, self.at, self.raw = hash_, at, raw

    def __len__(self) -> int:
        return len(self.at) - 1

    @classmethod
    def build(cls, terms: pa.Array, levels: int = LEVELS) -> Shard:
        raw, offsets = buffers(terms)
        raw, sizes = padded(raw), np.diff(offsets)
        hashes = span_hashes(raw, offsets[:-1], sizes)
        found = PerfectHash.build(hashes, levels)
        slots = found.slots(hashes)
        order = np.argsort(slots, kind="stable")
        slots = slots[order]
        for _ in range(len(slots)):  # equal spare hashes: the second one, and so on, takes the next slot
            twice = np.flatnonzero(slots[1:] == slots[:-1]) + 1
            if not len(twice):
                break
            slots[twice] += 1
            again = np.argsort(slots, kind="stable")
            order, slots = order[again], slots[again]
        keys = span_array(raw, offsets[:-1][order], sizes[order])
        held, at = buffers(keys)
        return cls(found, at, padded(held))

    def find(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slots of the spans that equal a stored key; -1 for all others."""
        slots = self.hash.slots(hashes)
        out, todo = np.full(len(slots), -1, np.int64), np.flatnonzero(slots >= 0)
        while len(todo):
            s = slots[todo]
            alike = sizes[todo] == self.at[s + 1] - self.at[s]
            check = np.flatnonzero(alike)
            alike[check] = same_spans(raw, starts[todo[check]], sizes[todo[check]], self.raw, self.at[s[check]])
            out[todo[alike]] = s[alike]
            todo = todo[~alike & (s >= self.hash.taken) & (s + 1 < len(self))]  # the next of equal spare hashes
            slots[todo] += 1
        return out

    def terms(self, slots: np.ndarray) -> pa.Array:
        return span_array(self.raw, self.at[slots], self.at[slots + 1] - self.at[slots])

    def write(self, path: str) -> None:
        """All arrays in one file, so that a reader maps it once."""
        arrays = [self.hash.sizes, self.hash.words, self.hash.spare, np.asarray(self.at, np.int64), self.raw]
        head = np.array([len(a.tobytes()) for a in arrays], np.int64)
        save(path, np.concatenate([np.frombuffer(a.tobytes(), np.uint8) for a in (head, *arrays)]))

    @classmethod
    def read(cls, path: str) -> Shard:
        """The shard of a file; an empty one if there is none."""
        if not os.path.exists(path):
            return cls(PerfectHash.build(np.zeros(0, np.uint64)), np.zeros(1, np.int64), np.zeros(PAD, np.uint8))
        whole = np.load(path, mmap_mode="r")
        ends = 40 + np.cumsum(whole[:40].view(np.int64))
        part = [whole[lo:hi] for lo, hi in zip([40, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return cls(PerfectHash(part[0].view(np.int64), part[1].view(np.uint64), part[2].view(np.uint64)), part[3].view(np.int64), part[4])


def shards_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes ^ _SHARD) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


class Vocabulary:
    """Reader of the published shards, one memory map each."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.open = folder, bits, {}

    def path(self, lang: str, shard: int, kind: str) -> str:
        return f"{self.folder}/{hashlib.sha1(lang.encode()).hexdigest()}.{shard}.{kind}.npy"

    def shard(self, lang: str, shard: int) -> Shard:
        if (lang, shard) not in self.open:
            if len(self.open) >= 4096:
                self.open.clear()
            self.open[lang, shard] = Shard.read(self.path(lang, shard, "terms"))
        return self.open[lang, shard]

    def find(self, lang: str, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of every span (-1: not a kept term of the language)."""
        hashes = span_hashes(raw, starts, sizes)
        shards, slots = shards_of(hashes, self.bits), np.full(len(hashes), -1, np.int64)
        order = np.argsort(shards, kind="stable")
        cuts = np.searchsorted(shards[order], np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[s] : cuts[s + 1]]
            slots[at] = self.shard(lang, s).find(raw, starts[at], sizes[at], hashes[at])
        return shards, slots


def _deal(bits: int):
    def run(batches):
        for b in batches:
            raw, offsets = buffers(b.column("term"))
            raw = padded(raw)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("term"), pa.array(shards_of(span_hashes(raw, offsets[:-1], np.diff(offsets)), bits).astype(np.int32))], ["lang", "term", "shard"])

    return run


def publish(kept: DataFrame, folder: str, bits: int) -> None:
    """Write the perfect hash of every language and shard of ``kept(lang, term)``."""
    vocabulary = Vocabulary(folder, bits)

    def write(key, t: pa.Table) -> pa.Table:
        Shard.build(t["term"].combine_chunks()).write(vocabulary.path(key[0].as_py(), key[1].as_py(), "terms"))
        return pa.table({"n": pa.array([len(t)], pa.int64())})

    dealt = kept.mapInArrow(_deal(bits), "lang string, term string, shard int")
    by_group(dealt, ["lang", "shard"], write, "n long").agg(F.sum("n")).first()


# ------------------------------------------------------------------ second pass
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("whole", pa.bool_()), ("shard", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())])


class _Recount:
    """Occurrences per group, shard and slot that a task holds."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.groups, self.sent = vocabulary, {}, set()
        self.keys, self.counts = [], []

    def group(self, lang: str, source: str | None) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add(self, b: pa.RecordBatch) -> None:
        raw, offsets = buffers(b.column("text"))
        raw = padded(LOWER[raw])
        langs, names = _codes(b.column("lang"))
        sources, titles = _codes(b.column("source"))
        both, rows_group = np.unique(langs * len(titles) + sources, return_inverse=True)
        mine = np.array([self.group(names[x // len(titles)], titles[x % len(titles)]) for x in both.tolist()], np.int64)
        whole = np.array([self.group(n, None) for n in names], np.int64)
        table, seen, times = None, [], []
        for table, rows, ids in distinct_terms(raw, offsets, langs):  # noqa: B007
            k, n = np.unique(rows_group[rows] << 32 | ids, return_counts=True)
            seen.append(k)
            times.append(n)
        if not seen or not table.n:
            return
        place = np.full(table.n, -1, np.int64)
        for code, lang in enumerate(names):
            at = np.flatnonzero(table.groups[: table.n] == code)
            shards, slots = self.vocabulary.find(lang, raw, table.starts[at], table.sizes[at])
            place[at] = np.where(slots >= 0, shards << 24 | slots, -1)
        keys, times = np.concatenate(seen), np.concatenate(times)
        ids = keys & 0xFFFFFFFF
        held = place[ids] >= 0
        keys, ids, times = keys[held], ids[held], times[held]
        for owner in (mine[keys >> 32], whole[table.groups[ids]]):
            self.keys.append(owner << 40 | place[ids])
            self.counts.append(times)

    def combine(self) -> None:
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.counts = [np.bincount(back, np.concatenate(self.counts), len(keys)).astype(np.int64)]
        self.keys = [keys]

    def full(self) -> bool:
        if sum(map(len, self.keys)) > 2 * HELD:
            self.combine()
        return sum(map(len, self.keys)) > HELD * 3 // 2

    def rows(self, last: bool):
        """What is held, one row per group and shard; at the end also the groups and shards without any."""
        names = list(self.groups)
        columns = {n: [] for n in _PARTIAL.names}

        def row(group, shard, slots, counts):
            self.sent.add((group, shard))
            for n, v in zip(_PARTIAL.names, (*names[group], names[group][1] is None, shard, pack(slots.astype(np.uint32), True), pack(counts.astype(np.uint64))), strict=True):
                columns[n].append(v)

        if self.keys:
            self.combine()
            keys, counts = self.keys[0], self.counts[0]
            first = np.flatnonzero(np.diff(keys >> 24, prepend=-1))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=False):
                row(int(keys[lo] >> 40), int(keys[lo] >> 24 & 0xFFFF), keys[lo:hi] & 0xFFFFFF, counts[lo:hi])
                if len(columns["lang"]) >= 512:
                    yield pa.RecordBatch.from_pydict(columns, _PARTIAL)
                    for c in columns.values():
                        c.clear()
            self.keys, self.counts = [], []
        if last:
            none = np.zeros(0, np.int64)
            for group in range(len(names)):
                for shard in range(1 << self.vocabulary.bits):
                    if (group, shard) not in self.sent:
                        row(group, shard, none, none)
        yield pa.RecordBatch.from_pydict(columns, _PARTIAL)


def _recount(vocabulary: Vocabulary):
    def run(batches):
        held = _Recount(vocabulary)
        for whole in batches:
            for b in pieces(whole):
                held.add(b)
                if held.full():
                    yield from held.rows(False)
        yield from held.rows(True)

    return run


def _dense(vocabulary: Vocabulary):
    """All partial counts of a group and shard in one dense array of the shard's slots."""

    def run(key, t: pa.Table) -> pa.Table:
        lang, source, whole, shard = (k.as_py() for k in key)
        counts = np.zeros(len(vocabulary.shard(lang, shard)), np.int64)
        for slots, n in zip(t["slots"].to_pylist(), t["counts"].to_pylist(), strict=True):
            counts[unpack(slots, np.uint32, True)] += unpack(n, np.uint64).astype(np.int64)  # a row's slots differ
        if whole:
            save(vocabulary.path(lang, shard, "whole"), slim(counts))
        return pa.table({"lang": [lang], "source": pa.array([source], pa.string()), "whole": [whole], "shard": pa.array([shard], pa.int32()),
                         "counts": pa.array([pack(counts)], pa.binary()), "n": pa.array([int(counts.sum())], pa.int64())})

    return run


# ------------------------------------------------------------------ exact values
def scaled(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division in three digits of a thousand."""
    total = np.uint64(max(total, 1))
    rest = counts.astype(np.uint64) + np.uint64(1)
    out = rest // total
    rest = rest - out * total
    for _ in range(3):
        rest *= np.uint64(1000)
        digit = rest // total
        out = out * np.uint64(1000) + digit
        rest -= digit * total
    return out + np.uint64(1)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    d = np.where(p > q, p - q, q - p)
    return d * d // q


def _tile(key, t: pa.Table) -> pa.Table:
    """Values of the pairs of sources of two blocks (or inside one) over a shard's terms."""
    lang, _, lo, hi = (k.as_py() for k in key)
    names, blocks = t["source"].to_pylist(), np.asarray(t["block"])
    p = [scaled(unpack(c, np.int64), n) for c, n in zip(t["counts"].to_pylist(), t["weight"].to_pylist(), strict=True)]
    out = {"source": [], "item": [], "value": []}
    other = {b: np.flatnonzero(blocks == (hi if b == lo else lo)) for b in {lo, hi}}
    matrix = {b: np.stack([p[i] for i in at]) if len(at) else None for b, at in other.items()}
    for i, name in enumerate(names):
        at = other[int(blocks[i])]
        if not len(at):
            continue
        values = gaps(p[i][None, :], matrix[int(blocks[i])]).sum(axis=1).astype(np.int64)
        for j, v in zip(at.tolist(), values.tolist(), strict=True):
            if j != i:
                out["source"].append(name)
                out["item"].append(names[j])
                out["value"].append(v)
    return pa.table({"lang": pa.array([lang] * len(out["item"]), pa.string()), "source": pa.array(out["source"], pa.string()),
                     "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})


def _leading(vocabulary: Vocabulary, ranks: int):
    """The ``ranks`` leading terms of every group and shard."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                counts = unpack(r["counts"], np.int64)
                if not counts.any():
                    continue
                whole = np.load(vocabulary.path(r["lang"], r["shard"], "whole"), mmap_mode="r")
                at = np.flatnonzero(counts)
                p, q = scaled(counts[at], r["weight"]), scaled(whole[at], r["lang_weight"])
                at, p, q = at[p > q], p[p > q], q[p > q]
                f = gaps(p, q).astype(np.int64)
                if len(f) > ranks:
                    least = np.partition(f, len(f) - ranks)[len(f) - ranks]
                    at, f = at[f >= least], f[f >= least]
                t = pa.table({"item": vocabulary.shard(r["lang"], r["shard"]).terms(at), "value": f})
                t = t.take(pc.sort_indices(t, [("value", "descending"), ("item", "ascending")])[:ranks])
                yield batch(schema, {"lang": pa.array([r["lang"]] * len(t), pa.string()), "source": pa.array([r["source"]] * len(t), pa.string()),
                                     "item": t["item"].combine_chunks().cast(pa.large_string()), "value": t["value"].combine_chunks()})

    return run


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS,
          ranks: int = TERM_RANKS, shard_terms: int = SHARD_TERMS, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source (``pair``), the leading terms (``term``)."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "divergence")
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(text_col), empty).alias("text"), F.coalesce(F.col(lang_col), empty).alias("lang"), F.coalesce(F.col(source_col), empty).alias("source"))
    kept = rows.mapInArrow(_frequencies, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("n").checkpoint()
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    most = sizes.agg(F.max("v")).first()[0] or 0
    bits = min(max(0, int(np.ceil(np.log2(max(most, 1) / shard_terms)))), 16)
    publish(kept, folder, bits)
    vocabulary = Vocabulary(folder, bits)
    partial = rows.mapInArrow(_recount(vocabulary), "lang string, source string, whole boolean, shard int, slots binary, counts binary")
    dense = by_group(partial, ["lang", "source", "whole", "shard"], _dense(vocabulary), "lang string, source string, whole boolean, shard int, counts binary, n long").checkpoint()

    totals = dense.groupBy("lang", "source", "whole").agg(F.sum("n").alias("n")).join(sizes, "lang", "left").withColumn("weight", F.col("n") + F.coalesce("v", F.lit(0)))
    # per language: the weight of the whole and the number of blocks of sources
    langs = totals.groupBy("lang").agg(F.max(F.when(F.col("whole"), F.col("weight"))).alias("lang_weight"), F.ceil(F.count_if(~F.col("whole")) / block).alias("blocks"))
    groups = totals.where(~F.col("whole")).select("lang", "source", "weight").join(langs, "lang")
    counts = dense.where(~F.col("whole")).select("lang", "source", "shard", "counts").join(groups, ["lang", "source"])

    schema = "lang string, source string, item string, value long"
    tiles = counts.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("lang", "shard", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "source", "block", "counts", "weight")
    pairs = by_group(tiles, ["lang", "shard", "lo", "hi"], _tile, schema).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = counts.select("lang", "source", "shard", "counts", "weight", "lang_weight").mapInArrow(_leading(vocabulary, ranks), schema)

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).cast("int")
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank)
    terms = terms.withColumn("part", F.lit("term")).withColumn("rank", rank).where(F.col("rank") <= ranks)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
