"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Tokens are made in the scan's tasks.  A document's full windows of SIZE tokens are sequences of their own;
what is left of it (under SIZE tokens) goes to an index shard.  Rows are dealt to shards evenly by their
place in the table, so no key, source or group of copies makes a shard large, and a shard holds about
SHARD_ROWS remainders.  In a shard an inverted index of token ids with BM25 weights (document frequencies and
mean length are those of all remainders of the table) answers each seed (longest unused first) with the
unused neighbours by all terms; those that fit are taken best first, then the longest unused that still fits,
and when none fits the best neighbour is cut and its rest is the next seed.  So every sequence but a shard's
last is full.  A seed's neighbours in other shards are not looked at.

Defined results: null text counts as empty (one token, the end); every row is packed, repeated rows each;
null ids stay null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

from .common import by_group, pieces
from .tokens import buffers, word_places

SIZE = 2048
END = 1
SHARD_ROWS = 4096
CACHED_WORDS = 2_000_000
LETTERS, MARKS = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
MARKS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: BM25's usual constants
K1, B = 1.2, 0.75

_ROW = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                  ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_PIECE = pa.schema([f for f in _ROW if f.name not in ("shard", "ids")])
_ROW_SQL = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in _ROW)
_PIECE_SQL = ", ".join(f"{f.name} long" for f in _PIECE)


class WordTokens:
    """Token ids of texts, by a cache of words.

    The tokenizer drops white space, lower-cases, and parts letters from punctuation, so a text's ids are
    those of its words, parted at white space and between an ASCII letter and ASCII punctuation (but
    apostrophes, which may open a contraction).  The cache is keyed by the hash of a word's lower-cased
    bytes; new words of letters are encoded together and told apart by the tokens that end a word.
    Rows with a mark of special tokens are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) > 65535:
            raise ValueError("ids travel as 16 bits")
        self.ends = np.zeros(65536, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.empty(1 << 20, np.uint16), 0

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        plain = np.array([w.isalpha() for w in words])
        flat, sizes, order = [], [], []

        def each(rows):
            for r, e in zip(rows.tolist(), self.tokenizer.encode_batch_fast([words[r] for r in rows.tolist()], add_special_tokens=False), strict=True):
                flat.append(np.array(e.ids, np.uint16))
                sizes.append([len(e.ids)])
                order.append([r])

        letters = np.flatnonzero(plain)
        for lo in range(0, len(letters), 1000):
            some = letters[lo : lo + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[r] for r in some.tolist()])], add_special_tokens=False)[0].ids, np.uint16)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                flat.append(ids)
                sizes.append(np.diff(cuts, prepend=0))
                order.append(some)
            else:  # lower-casing made something else than letters of one
                each(some)
        each(np.flatnonzero(~plain))
        flat, sizes, order = np.concatenate(flat), np.concatenate(sizes).astype(np.int32), np.concatenate(order)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(self.pool), len(flat)), np.uint16)])
        self.pool[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.used += len(flat)
        back = np.argsort(order)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.sizes = (np.insert(x, at, y) for x, y in ((self.keys, keys), (self.starts, starts[back]), (self.sizes, sizes[back])))

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each row's with END after them, and the rows' offsets."""
        if len(self.keys) > CACHED_WORDS:
            self.clear()
        hashes, at, begins, ends = word_places(raw, offsets, apart=(LETTERS, MARKS))
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            data = raw.tobytes()
            self._learn(unique[new], [data[a:z].decode() for a, z in zip(begins[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, unique)
        which = place[back]
        sizes = self.sizes[which].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.pool[np.repeat(self.starts[which] - total[:-1], sizes) + np.arange(total[-1])] if len(which) else np.zeros(0, np.uint16)
        cuts = total[at]
        whole = self._marked(raw, offsets)
        if whole:
            rows = [whole.get(r, flat[a:z]) for r, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]
            flat, cuts = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        starts = cuts + np.arange(len(cuts))
        out = np.full(len(flat) + len(cuts) - 1, END, np.uint16)
        mask = np.ones(len(out), bool)
        mask[starts[1:] - 1] = False
        out[mask] = flat
        return out, starts

    def _marked(self, raw: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Rows that may hold a special token's string."""
        data = raw.tobytes()
        if b"<|" not in data:
            return {}
        rows = [(r, data[a:z]) for r, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]
        return {r: np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.uint16) for r, t in rows if b"<|" in t}


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process, so that its cache outlives a task."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenize(path: str, size: int):
    def run(batches):
        made, part = 0, TaskContext.get().partitionId()
        tokens = word_tokens(path)
        for whole in batches:
            for b in pieces(whole):
                ids, at = tokens.ids(*buffers(b.column("text")))
                doc_ids, shards = b.column("doc_id").to_pylist(), b.column("shard").to_pylist()
                out = {n: [] for n in _ROW.names}
                for r, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    for start in range(0, z - a, size):
                        piece = ids[a + start : min(a + start + size, z)]
                        full = len(piece) == size
                        row = (shards[r], doc_ids[r], start, len(piece), crc(piece) if full else None, z - a,
                               (1 << 62) + (part << 36) + made if full else None, 0 if full else None, None if full else piece.tobytes())
                        made += full
                        for n, v in zip(_ROW.names, row, strict=True):
                            out[n].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=_ROW)

    return run


def corpus_terms(pieces: DataFrame) -> tuple[np.ndarray, int, float]:
    """Of all remainders: the number that hold each token id, their number and mean length."""

    def count(batches):
        df, n, tokens = np.zeros(65536, np.int64), 0, 0
        for b in batches:
            for x in b.column("ids").drop_null():
                d = np.frombuffer(x.as_buffer(), np.uint16)
                df[np.unique(d)] += 1
                n, tokens = n + 1, tokens + len(d)
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*t.tolist(), -1, -2], pa.int32()), pa.array([*df[t].tolist(), n, tokens], pa.int64())], names=["term", "n"])

    got = pieces.select("ids").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most 65538 rows
    of = np.zeros(65538, np.int64)
    of[np.asarray(got["term"])] = np.asarray(got["n"])  # -1 and -2: the last two
    return of[:65536], int(of[-1]), of[-2] / max(of[-1], 1)


class Shard:
    """BM25 inverted index over the remainders of a shard; ``corpus``: as of ``corpus_terms``, by default the shard's own."""

    def __init__(self, docs: list[np.ndarray], corpus: tuple[np.ndarray, int, float] | None = None):
        n = len(docs)
        pairs = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [t for t, _ in pairs]
        sizes = np.array([len(t) for t in self.terms])
        term, tf, doc = np.concatenate(self.terms), np.concatenate([c for _, c in pairs]).astype(np.float64), np.repeat(np.arange(n), sizes)
        length = np.array([len(d) for d in docs], np.float64)
        self.df = np.bincount(term, minlength=65536)
        df, every, mean = corpus or (self.df, n, length.mean())
        idf = np.log1p((every - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.concatenate([[0], np.cumsum(self.df)])
        self.n = n
        # frequent terms: their weights in all documents
        self.dense = {}
        for t in np.flatnonzero(self.df > n // 4).tolist():
            self.dense[t] = np.zeros(n)
            self.dense[t][self.doc[self.begin[t] : self.begin[t + 1]]] = self.weight[self.begin[t] : self.begin[t + 1]]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents by all terms of the seed."""
        terms = self.terms[seed].tolist()
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in terms if t not in self.dense]
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n) if spans else np.zeros(self.n)
        for t in terms:
            if t in self.dense:
                score += self.dense[t]
        return score


def fill(docs: list[np.ndarray], size: int, corpus: tuple[np.ndarray, int, float] | None = None):
    """(document, first token, tokens, sequence, offset) of every piece; documents are shorter than ``size``."""
    index, lengths = Shard(docs, corpus), np.array([len(d) for d in docs])
    unused = np.ones(len(docs), bool)
    by_length: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        by_length.setdefault(int(lengths[i]), []).append(i)
    present = sum(1 << n for n in by_length)

    def longest(most: int) -> int | None:
        nonlocal present
        while (some := present & ((1 << (most + 1)) - 1)):
            n = some.bit_length() - 1
            while by_length[n] and not unused[by_length[n][-1]]:
                by_length[n].pop()
            if by_length[n]:
                return by_length[n][-1]
            present ^= 1 << n
        return None

    sequence, rest = 0, None  # rest: what is left of a cut document
    while True:
        seed, skip = rest if rest else (longest(size), 0)
        if seed is None:
            return
        unused[seed] = False
        offset = int(lengths[seed]) - skip
        yield seed, skip, offset, sequence, 0
        rest, score = None, np.where(unused, index.scores(seed), 0.0)  # 0: used, or no term shared
        while offset < size:  # ties: the lower number
            i = int(np.argmax(np.where(lengths <= size - offset, score, 0.0)))
            if lengths[i] > size - offset or not score[i]:
                i = longest(size - offset)
            if i is None:
                i = int(np.argmax(score))
                i = i if score[i] else longest(size)
                if i is None:
                    break
                rest = (i, size - offset)
            n = min(int(lengths[i]), size - offset)
            unused[i], score[i] = False, 0.0
            yield i, 0, n, sequence, offset
            offset += n
        sequence += 1


def _pack(size: int, corpus):
    def run(key, t: pa.Table) -> pa.Table:
        whole = t.filter(pa.compute.is_null(t["ids"])).select(_PIECE.names)
        left = t.filter(pa.compute.is_valid(t["ids"])).sort_by([("doc_id", "ascending"), ("start", "ascending")])
        docs = [np.frombuffer(x.as_py(), np.uint16) for x in left["ids"]]
        ids, starts, totals = (left[c].to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        out = {n: [] for n in _PIECE.names}
        for i, skip, n, sequence, offset in fill(docs, size, corpus.value) if docs else ():
            row = (ids[i], starts[i] + skip, n, crc(docs[i][skip : skip + n]), totals[i], ((key[0].as_py() + 1) << 32) + sequence, offset)
            for name, v in zip(_PIECE.names, row, strict=True):
                out[name].append(v)
        return pa.concat_tables([whole.cast(_PIECE), pa.table(out, schema=_PIECE)])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer``: path of a tokenizer file that drops white space, at the same path on every machine.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    ensure_checkpoint_dir(docs.sparkSession)
    pieces = rows.mapInArrow(_tokenize(tokenizer, size), _ROW_SQL).checkpoint()
    corpus = docs.sparkSession.sparkContext.broadcast(corpus_terms(pieces))
    return by_group(pieces, "shard", _pack(size, corpus), _PIECE_SQL)
