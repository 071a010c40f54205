"""Exact repeats of ``length`` bytes, from the common-prefix intervals of sparse enhanced suffix arrays.

Every window of ``length`` bytes names an anchor: the rightmost of its k-byte strings with the least hash.
The choice depends on the window's bytes alone, so equal windows have equal anchors at equal places, and
all windows of one anchor form one context (the bytes they cover).  Contexts meet by their anchor's hash:
anchors that occur once cannot hold a repeat and go no further.

The contexts of one anchor are aligned at it.  Their suffixes from the anchor are sorted, and a stack scan
of the neighbours' common prefixes gives the interval tree; within each interval the reversed left parts
are scanned the same way.  An interval of both scans whose members differ on the right (they are in
several children) and on the left (left-extension diversity) is a maximal repeat; all its members are
occurrences, and where left and right common parts make ``length`` bytes, each member's part is covered.

An anchor with more than HOT occurrences, whose group could be a large share of the corpus, is not
gathered: hashes of its windows are counted with a local combine in every task, and a window counted
twice is a repeat.  Both ways cover the same windows exactly (64-bit hashes, as for texts).  Equal texts
are one text with a count; a text of ``length`` bytes or more that occurs twice is covered whole.

The same search runs a second time over the texts' words (64-bit hashes of them; white space and the case of A-Z
do not count): ``n_passage_words`` are the words within strings of ``words`` words that occur elsewhere.  Nothing is removed for them:
a passage of that many words may be shorter than ``length`` bytes.

Defined results: null text counts as empty; a text shorter than ``length`` loses nothing; null and
repeated ids keep one result row per input row; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SortedArrays, pack, save, shard_bits, shard_cuts, shard_of, shared_folder, slim, unpack, write_arrays
from .common import batch, by_group, partitions, pieces, u64
from .tokens import _BYTE, _power, buffers, mix, word_hashes

LENGTH = 400
GRAM = 32
PASSAGE_WORDS = 50
WORD_GRAM = 12
HOT = 512
SEGMENT = 1 << 20
HELD_BYTES = 32 << 20
_PLACE = np.uint64((1 << 21) - 1)
NO_ID = -(2**63)


class Symbols(NamedTuple):
    """What texts are strings of: ``of(bytes, offsets)`` gives a batch's symbols and the offsets of its rows among them."""

    name: str
    of: Callable
    size: int  # bytes of a symbol
    length: int  # symbols of a window
    gram: int  # symbols of an anchor


class Windows:
    """Anchors and their windows in a stretch of bytes or word hashes (rows of a batch, or a part of a long row)."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM):
        """``ends``: for each symbol, where its row ends."""
        n, wide = len(raw), length - gram + 1
        self.raw, self.length = raw, length
        up, self.down = _power(n)
        v = _BYTE[raw] if raw.dtype == np.uint8 else raw.copy()
        v *= up[:n]
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(v, out=self.sums[1:])
        grams = self._hash(np.arange(n - gram + 1), gram)
        u = (grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64))
        padded = np.full(-(-len(u) // wide) * wide, 2**64 - 1, np.uint64)
        padded[: len(u)] = u
        blocks = padded.reshape(-1, wide)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(n - length + 1)
        starts = starts[starts + length <= ends[starts]]
        anchor = (_PLACE - (np.minimum(right[starts], left[starts + wide - 1]) & _PLACE)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))) if len(starts) else np.zeros(0, np.int64)
        #: per anchor: its place and hash, its first and last window
        # (hashed again: the least hashes of windows crowd at zero, and shards go by leading bits)
        self.at, self.hash = anchor[cut], mix(grams[anchor[cut]] + np.uint64(1)) if len(cut) else grams[:0]
        self.first = starts[cut]
        self.last = starts[np.append(cut[1:], len(starts)) - 1] if len(cut) else starts[:0]

    def _hash(self, starts: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[starts + size] - self.sums[starts]) * self.down[starts])

    def window_hashes(self, i: int) -> np.ndarray:
        return self._hash(np.arange(self.first[i], self.last[i] + 1), self.length)

    def context(self, i: int) -> bytes:
        return self.raw[self.first[i] : self.last[i] + self.length].tobytes()


def stretches(raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray, length: int, gram: int = GRAM):
    """(row of each window start, its offset in the row, Windows) over the rows, in bounded pieces."""
    group, size = [], 0

    def joined():
        parts = [raw[offsets[r] : offsets[r + 1]] for r in group]
        sizes = np.array([len(p) for p in parts])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        w = Windows(np.concatenate(parts), np.repeat(begins[1:], sizes), length, gram)
        which = np.searchsorted(begins, w.first, "right") - 1
        return np.array(group)[which], w.first - begins[which], w

    for r in rows.tolist():
        n = int(offsets[r + 1] - offsets[r])
        if n < length:
            continue
        if n > SEGMENT:
            for lo in range(0, n - length + 1, SEGMENT):
                part = raw[offsets[r] + lo : offsets[r] + min(n, lo + SEGMENT + length - 1)]
                w = Windows(part, np.full(len(part), len(part)), length, gram)
                yield np.full(len(w.at), r), w.first + lo, w
            continue
        if size + n > SEGMENT and group:
            yield joined()
            group, size = [], 0
        group.append(r)
        size += n
    if group:
        yield joined()


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def intervals(values: list[bytes], least: int):
    """Common-prefix intervals of sorted strings by a stack scan: (prefix length, first, last), children first."""
    stack = [(0, 0)]
    for i in range(1, len(values) + 1):
        shared = common_prefix(values[i - 1], values[i]) if i < len(values) else -1
        begin = i - 1
        while stack and stack[-1][0] > shared:
            size, begin = stack.pop()
            if size >= least:
                yield size, begin, i - 1
        if not stack or stack[-1][0] < shared:
            stack.append((shared, begin))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int):
    """(left bytes, right bytes, members) of every repeat of aligned contexts of at least ``length`` bytes that
    no longer repeat has with the same members. ``lefts`` are reversed; both are aligned at the anchor."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    most = max(map(len, lefts))
    for r, lo, hi in intervals([rights[i] for i in order], length - most):
        members = sorted(order[lo : hi + 1], key=lefts.__getitem__)
        for n, a, b in intervals([lefts[i] for i in members], length - r):
            yield n, r, members[a : b + 1]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("text"))


def _distinct(batches, texts: SortedArrays, unit: Symbols):
    """Per batch: symbols, offsets and the rows that stand for their text and are long enough."""
    seen: set[int] = set()
    for b in (p for whole in batches for p in pieces(whole)):
        raw, offsets = unit.of(*buffers(b.column("text")))
        ids, keys = np.asarray(b.column("id").to_numpy(zero_copy_only=False), np.int64), u64(b.column("key"))
        mine = (texts.find_any(keys, {"first": np.int64(NO_ID)})["first"] == ids) & (np.diff(offsets) >= unit.length)
        rows = [i for i in np.flatnonzero(mine).tolist() if not (keys[i].item() in seen or seen.add(keys[i].item()))]
        yield raw, offsets, np.array(rows, np.int64)


_BLOB = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_CONTEXT = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
                      ("anchor", pa.int64()), ("key", pa.int64()), ("left", pa.int32()), ("context", pa.binary()), ("n", pa.int64())])


def _blobs(hashes: list[np.ndarray], bits: int):
    keys, counts = np.unique(np.concatenate(hashes), return_counts=True)
    cuts = shard_cuts(keys, bits)
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, pack(keys[cuts[s] : cuts[s + 1]], True), pack(slim(counts[cuts[s] : cuts[s + 1]]).astype(np.uint32))


def _merge(folder: str):
    """Keep the keys counted twice or more."""

    def run(key, t):
        keys = np.concatenate([unpack(x.as_py(), np.uint64, True) for x in t["keys"]])
        counts = np.concatenate([unpack(x.as_py(), np.uint32) for x in t["counts"]]).astype(np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(counts, starts)
        save(f"{folder}/{key[0].as_py()}.n.npy", slim(total[total > 1]))
        save(f"{folder}/{key[0].as_py()}.key.npy", keys[starts][total > 1])
        return pa.table({"n": pa.array([int((total > 1).sum())], pa.int64())})

    return run


def _anchors(texts, bits, unit):
    def run(batches):
        held, size = [], 0
        for raw, offsets, rows in _distinct(batches, texts, unit):
            for _, _, w in stretches(raw, offsets, rows, unit.length, unit.gram):
                held.append(w.hash)
                size += len(w.hash)
            if size > 2_000_000:
                yield from (batch(_BLOB, {"shard": [s], "keys": [k], "counts": [c]}) for s, k, c in _blobs(held, bits))
                held, size = [], 0
        if size:
            yield from (batch(_BLOB, {"shard": [s], "keys": [k], "counts": [c]}) for s, k, c in _blobs(held, bits))

    return run


def _context_key(anchor: int, left: int, context: bytes, bits: int) -> int:
    """The anchor's shard, then a hash of the context."""
    h = xxhash.xxh3_64_intdigest(context, seed=left)
    return anchor >> (64 - bits) << (64 - bits) | h & ((1 << (64 - bits)) - 1)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _contexts(texts, anchors: SortedArrays, bits, unit):
    """Contexts of anchors that occur again, equal ones of a task once; window counts of hot anchors."""
    blank = {"kind": "", "shard": 0, "keys": None, "counts": None, "anchor": 0, "key": 0, "left": 0, "context": None, "n": 0}

    def run(batches):
        held: dict[int, list] = {}
        size, hot, n_hot = 0, [], 0

        def flush():
            items = list(held.values())
            return pa.RecordBatch.from_arrays([
                pa.array(["context"] * len(items)), pa.array([x[0] >> (64 - bits) for x in items], pa.int32()), pa.nulls(len(items), pa.binary()), pa.nulls(len(items), pa.binary()),
                pa.array([_signed(x[0]) for x in items], pa.int64()), pa.array([_signed(k) for k in held], pa.int64()), pa.array([x[1] for x in items], pa.int32()),
                pa.array([x[2] for x in items], pa.binary()), pa.array([x[3] for x in items], pa.int64())], schema=_CONTEXT)

        def flush_hot():
            return pa.RecordBatch.from_pylist([{**blank, "kind": "hot", "shard": s, "keys": k, "counts": c} for s, k, c in _blobs(hot, bits)], schema=_CONTEXT)

        for raw, offsets, rows in _distinct(batches, texts, unit):
            for _, _, w in stretches(raw, offsets, rows, unit.length, unit.gram):
                n = anchors.find_any(w.hash, {"n": np.int64(0)})["n"]
                for i in np.flatnonzero(n > HOT).tolist():
                    hot.append(w.window_hashes(i))
                    n_hot += len(hot[-1])
                for i in np.flatnonzero((n > 1) & (n <= HOT)).tolist():
                    anchor, left, context = int(w.hash[i]), int(w.at[i] - w.first[i]), w.context(i)
                    got = held.setdefault(_context_key(anchor, left, context, bits), [anchor, left, context, 0])
                    got[3] += 1
                    if got[3] == 1:
                        size += len(context) + 200
                if size > HELD_BYTES:
                    yield flush()
                    held, size = {}, 0
                if n_hot > 2_000_000:
                    yield flush_hot()
                    hot, n_hot = [], 0
        if held:
            yield flush()
        if hot:
            yield flush_hot()

    return run


def _covered_windows(contexts: list[tuple[int, bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """Per context (left, bytes, count) of one anchor: ranges of window starts that occur elsewhere."""
    whole = [(0, len(c) - length) for _, c, _ in contexts]
    out = [[w] if n > 1 else [] for w, (_, _, n) in zip(whole, contexts, strict=True)]
    if len(contexts) > 1:
        for left, right, members in maximal_repeats([c[:a][::-1] for a, c, _ in contexts], [c[a:] for a, c, _ in contexts], length):
            for i in members:
                if contexts[i][2] == 1:
                    a = contexts[i][0]
                    out[i].append((a - left, a + right - length))
    return out


def _resolve(folder: str, unit: Symbols):
    """Per shard of anchors: covered windows of every context, written as arrays by context key."""

    def run(key, t):
        order = np.lexsort((u64(t["key"]), u64(t["anchor"])))
        anchors, keys, lefts, counts = (np.asarray(t[c])[order] for c in ("anchor", "key", "left", "n"))
        texts = t["context"].combine_chunks()
        found, i = [], 0
        while i < len(order):
            j, group, own = i, [], []
            while j < len(order) and anchors[j] == anchors[i]:
                if own and own[-1] == keys[j]:
                    group[-1] = (*group[-1][:2], group[-1][2] + int(counts[j]))
                else:
                    own.append(keys[j])
                    group.append((int(lefts[j]) * unit.size, texts[int(order[j])].as_py(), int(counts[j])))
                j += 1
            for k, spans in zip(own, _covered_windows(group, unit.length * unit.size), strict=True):
                spans = {(-(-a // unit.size), b // unit.size) for a, b in spans}  # whole symbols
                spans = sorted((a, b) for a, b in spans if a <= b)
                if spans:
                    found.append((int(k) % 2**64, spans))
            i = j
        found.sort()
        s = key[0].as_py()
        sizes = [len(x) for _, x in found]
        save(f"{folder}/{s}.size.npy", np.array(sizes, np.int32))
        save(f"{folder}/{s}.start.npy", np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64))
        save(f"{folder}/{s}.spans.npy", np.array([y for _, x in found for y in x], np.int32).reshape(-1, 2))
        save(f"{folder}/{s}.key.npy", np.array([k for k, _ in found], np.uint64))
        return pa.table({"n": pa.array([len(found)], pa.int64())})

    return run


def runs(mask: np.ndarray) -> int:
    return int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0


class Repeats(NamedTuple):
    """The arrays of one search."""

    unit: Symbols
    bits: int
    most: int  # anchors that occur more often are hot
    texts: SortedArrays
    anchors: SortedArrays
    hot: SortedArrays
    resolved: SortedArrays

    def covered(self, raw: np.ndarray, offsets: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Which symbols of a batch lie in a window that occurs elsewhere."""
        length, sizes = self.unit.length, np.diff(offsets)
        gone = np.zeros(len(raw) + 1, np.int32)  # a difference array over the batch

        def cover(first, last, row):  # windows that start from first to last of a row
            np.add.at(gone, offsets[row] + first, 1)
            np.add.at(gone, offsets[row] + last + length, -1)

        full = np.flatnonzero((copies > 1) & (sizes >= length))
        cover(np.zeros(len(full), np.int64), sizes[full] - length, full)
        for rows, first, w in stretches(raw, offsets, np.flatnonzero(copies == 1), length, self.unit.gram):
            n = self.anchors.find_any(w.hash, {"n": np.int64(0)})["n"]
            at = np.flatnonzero(n > self.most)
            if len(at):
                hashes = [w.window_hashes(i) for i in at.tolist()]
                got = self.hot.find_any(np.concatenate(hashes), {})["found"]
                lengths = np.array([len(h) for h in hashes])
                window = np.concatenate([first[i] + np.arange(len(h)) for i, h in zip(at.tolist(), hashes, strict=True)])[got]
                cover(window, window, np.repeat(rows[at], lengths)[got])
            at = np.flatnonzero((n > 1) & (n <= self.most))
            if not len(at):
                continue
            keys = np.array([_context_key(int(w.hash[i]), int(w.at[i] - w.first[i]), w.context(i), self.bits) for i in at.tolist()], np.uint64)
            got = self.resolved.find_any(keys, {"start": np.int64(0), "size": np.int64(0)})
            hit = np.flatnonzero(got["found"])
            if len(hit):
                size = got["size"][hit]
                which = np.repeat(hit, size)
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(got["start"][hit], size)
                shards, spans = shard_of(keys, self.bits)[which], np.empty((len(which), 2), np.int64)
                for s in np.unique(shards).tolist():
                    spans[shards == s] = self.resolved.column(s, "spans")[place[shards == s]]
                cover(first[at[which]] + spans[:, 0], first[at[which]] + spans[:, 1], rows[at[which]])
        return np.cumsum(gone[:-1]) > 0


def _search(rows: DataFrame, texts: SortedArrays, bits: int, unit: Symbols) -> Repeats:
    spark = rows.sparkSession
    folder = {n: shared_folder(spark, f"repeats-{unit.name}-{n}") for n in ("anchors", "hot", "resolved", "contexts")}
    blobs = rows.mapInArrow(_anchors(texts, bits, unit), "shard int, keys binary, counts binary")
    by_group(blobs, "shard", _merge(folder["anchors"]), "n long").agg(F.sum("n")).first()
    anchors = SortedArrays(folder["anchors"], bits)
    schema = "shard int, keys binary, counts binary, anchor long, key long, left int, context binary, n long, kind string"
    rows.mapInArrow(_contexts(texts, anchors, bits, unit), "kind string, shard int, keys binary, counts binary, anchor long, key long, left int, context binary, n long") \
        .write.mode("overwrite").partitionBy("kind").parquet(folder["contexts"])
    contexts = spark.read.schema(schema).parquet(folder["contexts"])
    hot = contexts.where("kind = 'hot'").select("shard", "keys", "counts")
    by_group(hot, "shard", _merge(folder["hot"]), "n long").agg(F.sum("n")).first()
    groups = contexts.where("kind = 'context'").select("shard", "anchor", "key", "left", "context", "n")
    by_group(groups, "shard", _resolve(folder["resolved"], unit), "n long").agg(F.sum("n")).first()
    return Repeats(unit, bits, HOT, texts, anchors, SortedArrays(folder["hot"], bits), SortedArrays(folder["resolved"], bits))


def _remove(in_bytes: Repeats, in_words: Repeats):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("n_passage_words", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for whole in batches:
            for b in pieces(whole):
                raw, offsets = buffers(b.column("text"))
                copies = in_bytes.texts.find_any(u64(b.column("key")), {"copies": np.int64(1)})["copies"]
                mask = in_bytes.covered(raw, offsets, copies)
                words, ends = in_words.unit.of(raw, offsets)
                shared = np.concatenate([[0], np.cumsum(in_words.covered(words, ends, copies))])
                out = {n: [] for n in schema.names}
                ids, shared = b.column("id").to_pylist(), (shared[ends[1:]] - shared[ends[:-1]]).tolist()
                for r in range(b.num_rows):
                    m, text = mask[offsets[r] : offsets[r + 1]], raw[offsets[r] : offsets[r + 1]]
                    left = text[~m].tobytes()
                    for n, v in zip(schema.names, (None if ids[r] == NO_ID else ids[r], len(text), int(m.sum()), runs(m), hashlib.sha256(left).hexdigest(), shared[r], left), strict=True):
                        out[n].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int = PASSAGE_WORDS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, kept`` (the bytes that stay) of every row."""
    rows = _texts(docs, id_col, text_col)
    bits = shard_bits(2 * partitions(rows))
    folder = shared_folder(docs.sparkSession, "repeats-texts")
    write_arrays(rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies")), folder, bits, ["first", "copies"])
    texts = SortedArrays(folder, bits)
    in_bytes = _search(rows, texts, bits, Symbols("bytes", lambda raw, offsets: (raw, offsets), 1, length, GRAM))
    in_words = _search(rows, texts, bits, Symbols("words", word_hashes, 8, words, min(WORD_GRAM, words)))
    return rows.mapInArrow(_remove(in_bytes, in_words), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept binary")
