"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted arrays that workers memory-map.

Three passes over the training rows, each a map with a local combine and a merge by key range:

1. words: hash and count of every distinct token.  A word's id is its rank in hash order.
2. bigrams: the key ``left id * 2**32 + right id`` with its count, dealt to shards by the left word, so a
   left word's total and its numbers of followers seen once, twice and more often are sums over one run.
   Left words with over ``1 / HOT`` of all tokens are dealt by the whole bigram instead, and their sums merged.
3. continuations: in how many distinct bigrams a word is the right one, dealt by ranges of ids.

Then p(w|v) = max(c(vw) - D(c), 0) / c(v) + g(v) p1(w), with p1(w) likewise from continuation counts,
interpolated with the uniform distribution over the words and one unknown word; D1, D2, D3+ are the
modified Kneser-Ney discounts from counts of counts.  A left word that training never saw backs off to p1.

Texts are whole; null counts as empty; every row is its own text, repeated rows count as often as they
occur; extra columns are ignored; without training rows the model is uniform over the unknown word and
the base is log10(1 / 1) per token.  Ids are 32-bit: more than 2**32 - 2 distinct words raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SortedArrays, load, pack, save, shard_bits, shard_of, shared_folder, slim, unpack
from .common import batch, by_group, fold, partitions, pieces
from .tokens import buffers, mix, word_hashes

HOT = 1000
HELD = 2_000_000
#: the token that ends a text; no word has this hash but by a 64-bit collision
END = np.uint64(0x5BD1E995A3C59AC3)
BLOBS = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
BLOBS_SQL = "shard int, keys binary, counts binary"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's words with END after them, and the rows' offsets."""
    words, at = word_hashes(*buffers(column))
    rows = len(at) - 1
    out = np.full(len(words) + rows, END, np.uint64)
    ends = at[1:] + np.arange(rows)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = words
    return out, at + np.arange(rows + 1)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their summed counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def as_blobs(keys, counts, shards) -> list[pa.RecordBatch]:
    """One row per shard that occurs; keys ascend within each."""
    order = np.lexsort((keys, shards))
    keys, counts, shards = keys[order], counts[order], shards[order]
    starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(keys) else []
    return [batch(BLOBS, {"shard": [int(shards[a])], "keys": [pack(keys[a:b], True)], "counts": [pack(counts[a:b].astype(np.uint64))]})
            for a, b in zip(starts, np.append(starts[1:], len(keys)) if len(keys) else [], strict=True)]


def merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([unpack(x.as_py(), np.uint64, True) for x in t["keys"]]),
                  np.concatenate([unpack(x.as_py(), np.uint64) for x in t["counts"]]).astype(np.int64))


def _combine(read, shards):
    """Map side: keys of each batch, counted in blocks of HELD."""

    def run(batches):
        held, size = [], 0
        for b in (p for whole in batches for p in pieces(whole)):
            held.append(read(b.column(0)))
            size += len(held[-1])
            if size >= HELD:
                keys, counts = summed(np.concatenate(held))
                yield from as_blobs(keys, counts, shards(keys))
                held, size = [], 0
        if size:
            keys, counts = summed(np.concatenate(held))
            yield from as_blobs(keys, counts, shards(keys))

    return run


class Words:
    """Ids and counts of words, memory-mapped."""

    def __init__(self, folder: str, bits: int, starts: list[int], total: int):
        self.arrays, self.starts, self.total, self.size = SortedArrays(folder, bits), np.array(starts, np.int64), total, int(starts[-1])
        self.bits = bits

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and count of each token."""
        unique, back = np.unique(hashes, return_inverse=True)
        got = self.arrays.find(unique, {"rank": np.int64(0), "n": np.int64(0)})
        ids = np.where(got["found"], got["rank"] + self.starts[shard_of(unique, self.bits)], -1)
        return ids[back], got["n"][back]


def _bigrams(words: Words, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of every token after the one before it; a text's first follows the start, whose id is the size."""
    left = np.empty(len(ids), np.int64)
    left[1:] = ids[:-1]
    left[at[:-1]] = words.size
    return left


def _bigram_shards(left: np.ndarray, keys: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    return shard_of(mix(np.where(np.isin(left, hot), keys, left.astype(np.uint64))), bits)


def _discounts(n: np.ndarray) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen one to four times; 0.5 where these are too few to tell."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    return [float(np.clip(i - (i + 1) * y * b / a, 0.05, i)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _followers(left: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Per left id (ascending): tokens after it, and followers seen once, twice, more."""
    starts = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if len(left) else np.zeros(0, np.int64)
    add = lambda x: np.add.reduceat(x.astype(np.int64), starts) if len(left) else np.zeros(0, np.int64)
    return {"key": left[starts].astype(np.uint64), "total": add(counts), "f1": add(counts == 1), "f2": add(counts == 2), "f3": add(counts > 2)}


class Model:
    """Everything a worker needs; arrays are opened lazily and memory-mapped."""

    def __init__(self, words: Words, folder: str, bits: int, hot: np.ndarray, hot_stats: dict, d2, d1, id_bits: int, right_total: int, of_right: list[int]):
        self.words, self.folder, self.bits, self.hot, self.hot_stats = words, folder, bits, hot, hot_stats
        self.d2, self.d1, self.id_bits, self.right_total, self.of_right = np.array([0.0, *d2]), np.array([0.0, *d1]), id_bits, right_total, of_right

    def arrays(self):
        if "_open" not in self.__dict__:
            self._open = (SortedArrays(self.folder, self.bits, "bigram"), SortedArrays(self.folder, self.bits, "left"), {})
        return self._open

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def _sharded(self, arrays, shards, keys, names) -> dict[str, np.ndarray]:
        """Like ``find``, for keys whose shard is not their leading bits."""
        out = {n: np.zeros(len(keys), np.int64) for n in names}
        order = np.lexsort((keys, shards))
        cuts = np.searchsorted(shards[order], np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            rows = order[cuts[s] : cuts[s + 1]]
            held = arrays.column(s, arrays.key)
            if len(held):
                at = np.minimum(np.searchsorted(held, keys[rows]), len(held) - 1)
                hit = held[at] == keys[rows]
                for n in names:
                    out[n][rows[hit]] = arrays.column(s, n)[at[hit]]
        return out

    def followers(self, left: np.ndarray) -> dict[str, np.ndarray]:
        unique, back = np.unique(left, return_inverse=True)
        got = self._sharded(self.arrays()[1], _bigram_shards(unique, unique.astype(np.uint64), self.hot[:0], self.bits), unique.astype(np.uint64), ["total", "f1", "f2", "f3"])
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, unique), len(self.hot) - 1)
            hit = self.hot[at] == unique
            for n in got:
                got[n][hit] = self.hot_stats[n][at[hit]]
        return {n: v[back] for n, v in got.items()}

    def rights(self, ids: np.ndarray) -> np.ndarray:
        """In how many distinct bigrams each word is the right one (dense arrays by ranges of ids)."""
        out, files = np.zeros(len(ids), np.int64), self.arrays()[2]
        block = np.where(ids >= 0, ids >> self.id_bits, -1)
        for b in np.unique(block[block >= 0]).tolist():
            if b not in files:
                files[b] = load(f"{self.folder}/{b}.right.npy")
            rows = np.flatnonzero(block == b)
            if len(files[b]):
                out[rows] = files[b][ids[rows] & ((1 << self.id_bits) - 1)]
        return out

    def log10(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after the one before it."""
        left = _bigrams(self.words, ids, at)
        n_right = self.rights(ids)
        total = max(self.right_total, 1)
        backed = float(np.dot(self.d1[1:], [self.of_right[0], self.of_right[1], self.of_right[2]])) / total if self.right_total else 1.0
        p1 = np.maximum(n_right - self.d1[np.minimum(n_right, 3)], 0) / total + backed / (self.words.size + 1)
        keys = (np.maximum(left, 0).astype(np.uint64) << np.uint64(32)) | np.maximum(ids, 0).astype(np.uint64)
        both = (left >= 0) & (ids >= 0)
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        got = self._sharded(self.arrays()[0], _bigram_shards(left[first], unique, self.hot, self.bits), unique, ["n2"])["n2"][back]
        count = np.where(both, got, 0)
        after = self.followers(np.where(left >= 0, left, self.words.size + 1))
        seen = after["total"] > 0
        of = np.maximum(after["total"], 1)
        freed = (self.d2[1] * after["f1"] + self.d2[2] * after["f2"] + self.d2[3] * after["f3"]) / of
        p = np.where(seen, np.maximum(count - self.d2[np.minimum(count, 3)], 0) / of + freed * p1, p1)
        return np.log10(p)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count all rows of ``docs``; only sizes, discounts and the sums of at most HOT + 1 hot words reach the driver."""
    spark, parts = docs.sparkSession, partitions(docs)
    bits = shard_bits(2 * parts)
    texts = docs.select(F.col(text_col).alias("text"))
    folder = shared_folder(spark, "kneser-ney")

    def merge_words(key, t):
        s = key[0].as_py()
        keys, counts = merged(t)
        save(f"{folder}/{s}.n.npy", slim(counts))
        save(f"{folder}/{s}.key.npy", keys)
        return pa.table({"shard": [s], "size": [len(keys)], "total": [int(counts.sum())]})

    blobs = texts.mapInArrow(_combine(lambda c: tokens(c)[0], lambda k: shard_of(k, bits)), BLOBS_SQL)
    got = by_group(blobs, "shard", merge_words, "shard long, size long, total long").collect()  # one row per shard
    sizes, total = np.zeros(1 << bits, np.int64), sum(r["total"] for r in got)
    for r in got:
        sizes[r["shard"]] = r["size"]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    if starts[-1] > 2**32 - 2:
        raise ValueError("more distinct words than 32-bit ids")
    words = Words(folder, bits, starts.tolist(), total)
    size = words.size

    def often(rows):  # words with over 1 / HOT of all tokens: fewer than HOT of them
        for b in rows:
            for s in b.column(0).to_pylist():
                n = words.arrays.column(s, "n")
                for i in np.flatnonzero(n > max(total // HOT, 1000)).tolist():
                    yield pa.RecordBatch.from_pydict({"id": [int(starts[s]) + i]})

    hot = spark.createDataFrame([(int(s),) for s in np.flatnonzero(sizes)], "shard int").mapInArrow(often, "id long").collect() if size else []
    hot = np.array(sorted([r["id"] for r in hot] + [size]), np.int64)  # the start token too

    def keys_of(column):
        t, at = tokens(column)
        ids, _ = words.look(t)
        return (_bigrams(words, ids, at).astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)

    id_bits = max(10, int(np.ceil(np.log2(max(size, 2)))) - bits)

    def merge_bigrams(key, t):
        s = key[0].as_py()
        keys, counts = merged(t)
        left = (keys >> np.uint64(32)).astype(np.int64)
        stats = _followers(left, counts)
        held = ~np.isin(stats["key"].astype(np.int64), hot)
        for n in ("total", "f1", "f2", "f3", "key"):
            save(f"{folder}/{s}.{'left' if n == 'key' else n}.npy", stats[n][held] if n == "key" else slim(stats[n][held]))
        save(f"{folder}/{s}.n2.npy", slim(counts))
        save(f"{folder}/{s}.bigram.npy", keys)
        rights, n_rights = summed(keys & np.uint64(2**32 - 1))
        out = [pa.Table.from_batches([b]) for b in as_blobs(rights, n_rights, (rights >> np.uint64(id_bits)).astype(np.int64))]
        rows = pa.concat_tables(out) if out else BLOBS.empty_table()
        partial = np.concatenate([stats[n][~held].astype(np.int64) for n in ("key", "total", "f1", "f2", "f3")])
        mine = pa.Table.from_batches([batch(BLOBS, {"shard": [-1], "keys": [pack(np.array(_of_counts(counts), np.int64))], "counts": [pack(partial)]})])
        return pa.concat_tables([rows, mine])

    blobs = texts.mapInArrow(_combine(keys_of, lambda k: _bigram_shards((k >> np.uint64(32)).astype(np.int64), k, hot, bits)), BLOBS_SQL)
    second = shared_folder(spark, "kneser-ney-right")
    by_group(blobs, "shard", merge_bigrams, BLOBS_SQL).withColumn("own", F.col("shard") < 0).write.mode("overwrite").partitionBy("own").parquet(second)
    rows = spark.read.schema(f"{BLOBS_SQL}, own boolean").parquet(second)

    def merge_rights(key, t):
        b = key[0].as_py()
        ids, counts = merged(t)
        dense = np.zeros(1 << id_bits, np.uint32)
        dense[(ids & np.uint64((1 << id_bits) - 1)).astype(np.int64)] = counts
        save(f"{folder}/{b}.right.npy", slim(dense))
        return pa.table({"total": [int(counts.sum())], "n3up": [int((counts > 2).sum())]} | {f"n{i + 1}": [n] for i, n in enumerate(_of_counts(counts))})

    r = by_group(rows.where("NOT own"), "shard", merge_rights, "total long, n3up long, n1 long, n2 long, n3 long, n4 long").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("total", "n3up", "n1", "n2", "n3", "n4")]).first()
    of_bigrams, sums = np.zeros(4, np.int64), {n: np.zeros(len(hot), np.int64) for n in ("total", "f1", "f2", "f3")}
    for row in rows.where("own").select("keys", "counts").toLocalIterator():  # one row per shard, at most HOT + 1 sums in each
        of_bigrams += unpack(bytes(row["keys"]), np.int64)
        part = unpack(bytes(row["counts"]), np.int64).reshape(5, -1)
        at = np.searchsorted(hot, part[0])
        for n, v in zip(sums, part[1:], strict=True):
            sums[n][at] += v
    return Model(words, folder, bits, hot, sums, _discounts(of_bigrams), _discounts(np.array([r["n1"], r["n2"], r["n3"], r["n4"]])),
                 id_bits, int(r["total"]), [int(r["n1"]), int(r["n2"]), int(r["n3up"])])


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``' columns but the text, with n_tokens, n_known, train_tokens, base_score and score."""
    keep = [f for f in docs.schema.fields if f.name != text_col]
    added = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    total, size = model.words.total, model.words.size
    base_of = float(np.log10(total + size + 1))

    def run(batches):
        for whole in batches:
            for b in pieces(whole, text_col):
                t, at = tokens(b.column(text_col))
                ids, counts = model.words.look(t)
                add = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731, B023  a row has its end token at least
                base = add(np.log10(counts + 1.0) - base_of)
                columns = {f.name: b.column(f.name) for f in keep} | {
                    "n_tokens": np.diff(at), "n_known": add((ids >= 0).astype(np.int64)), "train_tokens": np.full(b.num_rows, total),
                    "base_score": base, "score": add(model.log10(ids, at))}
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{n} {'double' if k == pa.float64() else 'long'}" for n, k in added])
    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2) -> DataFrame:
    """Train on the rows whose crc32 fold is not ``held`` and score all rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold(id_col, parts) == held).alias("held_out"))
    return scored(rows, train(rows.where("NOT held_out")))
