import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import packing as P
from ledgerlens.llm.queries import tokenizer_path

from .conftest import prose, rows


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def check(pieces, items, tokenizer, size=P.SIZE):
    """Every id of every row in exactly one piece; sequences gapless and at most ``size``."""
    expected = sorted((str(i), len(ids), ids) for i, t in items for ids in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]])
    by_sequence, by_doc = {}, {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append(r)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= size
    for (i, n), got in by_doc.items():
        same = [ids for x, m, ids in expected if (x, m) == (i, n)]
        assert sum(r["length"] for r in got) == n * len(same)
        ends = {}
        for r in got:
            assert any(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for ids in same)
            ends[r["start"]] = ends.get(r["start"], 0) + 1
    assert sum(n for _, n, _ in expected) == sum(length for s in by_sequence.values() for _, length in s)
    return by_sequence


def test_word_cache_equals_whole_texts(tokenizer):
    import pyarrow as pa

    from ledgerlens.llm.tokens import buffers

    texts = ["Grüße's 12 it's <|endoftext|> a<|startoftext|>b x y z q", "", "  ", "naïve é \x1c!\x1d ΟΔΟΣ ſ K", "a" * 3000, "don't 3.14 ###", "日本語 text 😀😀", "é, É! (é) ×, a÷. naïve… İx, ñ#ñ don't!", "ʼs İ ŒŒ Straße;"]
    words = P.WordTokens(tokenizer_path())
    for _ in range(2):
        ids, at = words.ids(*buffers(pa.array(texts, pa.string())))
        for t, a, z in zip(texts, at[:-1], at[1:], strict=True):
            assert ids[a:z].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
    words.clear()
    assert not len(words.keys)


def test_round_trip_and_little_padding(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 150)
    items = [(i, prose(i, 20 + (i * 131) % 900)) for i in range(300)]
    got = P.pack_documents(spark.createDataFrame(items, "doc_id long, text string").repartition(3), tokenizer_path()).collect()
    sequences = check(got, items, tokenizer)
    full = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(n < P.SIZE for n in full) <= 2  # one open sequence per shard


def test_neighbours_share_the_window():
    """Documents on one topic are packed together rather than in table order."""
    r = np.random.default_rng(1)
    own = (5000 + r.permutation(40 * 95)).reshape(40, 95)
    docs = [np.concatenate([np.full(5, 1000 + i // 5), own[i]]).astype(np.uint16) for i in range(40)]
    mixed = r.permutation(40)
    shuffled = [docs[i] for i in mixed]
    together = {}
    for i, _, _, sequence, _ in P.fill(shuffled, 500):
        together.setdefault(sequence, []).append(int(mixed[i]) // 5)
    assert sum(len(set(x)) == 1 for x in together.values()) >= 7


def test_edge_rows(documents, no_documents, tokenizer):
    check(P.pack_documents(documents, tokenizer_path()).collect(), [(r[0], r[1]) for r in rows()], tokenizer)
    assert P.pack_documents(no_documents, tokenizer_path()).count() == 0


def bm25(seed, docs, corpus):
    """Scores of all documents by all terms of the seed, one by one."""
    n, mean = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = {}
    for d in corpus:
        for x in set(d.tolist()):
            df[x] = df.get(x, 0) + 1
    out = []
    for d in docs:
        tf = {x: d.tolist().count(x) for x in set(d.tolist()) & set(seed.tolist())}
        out.append(sum(np.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * c * (P.K1 + 1) / (c + P.K1 * (1 - P.B + P.B * len(d) / mean)) for x, c in tf.items()))
    return np.array(out)


def test_neighbours_by_all_terms_and_corpus_frequencies(spark):
    r = np.random.default_rng(7)
    every = [np.append(r.zipf(1.3, r.integers(30, 120)) % 300 + 10, 1).astype(np.uint16) for _ in range(400)]
    docs = every[:40]
    assert max(len(np.unique(d)) for d in docs) > 16
    df, n, mean = P.corpus_terms(spark.createDataFrame([(d.tobytes(),) for d in every] + [(None,)], "ids binary").repartition(3))
    assert n == 400 and abs(mean - sum(map(len, every)) / 400) < 1e-9
    assert all(df[t] == sum(t in d for d in every) for t in range(400))
    for corpus, given in ((docs, ()), (every, ((df, n, mean),))):
        index = P.Shard(docs, *given)
        for seed in range(0, 40, 8):
            assert np.allclose(index.scores(seed), bm25(docs[seed], docs, corpus))
