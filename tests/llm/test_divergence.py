import re
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import divergence as D
from ledgerlens.llm.spans import padded, span_hashes
from ledgerlens.llm.tokens import buffers

from .conftest import prose


def brute_force(rows, ranks=200):
    docs = [(r["lang"] or "", r["source"] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= 3]

        def shares(words, kept=kept):
            c = Counter(words)
            n = sum(c[t] for t in kept)
            return c, {t: 1 + floor(Fraction(10**9 * (c[t] + 1), n + len(kept))) for t in kept}

        _, whole = shares([t for d in mine for t in d[2]])
        groups = {s: shares([t for d in mine if d[1] == s for t in d[2]]) for s in {d[1] for d in mine}}
        f = lambda p, q: (p - q) ** 2 // q
        for s, (c, p) in groups.items():
            pairs = [(sum(f(p[t], q[t]) for t in kept), o) for o, (_, q) in groups.items() if o != s]
            terms = [(f(p[t], whole[t]), t) for t in kept if c[t] and p[t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < ranks]
    return sorted(out)


@pytest.mark.parametrize(("shard_terms", "block", "held"), [(D.SHARD_TERMS, D.BLOCK, D.HELD), (8, 1, 16), (4, 2, 1 << 20)])
def test_equals_brute_force_on_edge_rows(spark, documents, shard_terms, block, held, monkeypatch):
    monkeypatch.setattr(D, "HELD", held)  # the driver's value; the workers keep theirs
    more = spark.createDataFrame([(100 + i, prose(i, 40) + (" Straße ÉÉ 東京" if i % 3 else ""), ["en", "de", None][i % 3], f"s{i % 5}") for i in range(40)],
                                 "doc_id long, text string, lang string, source string")
    rows = documents.select("doc_id", "text", "lang", "source").unionByName(more)
    got = D.audit(rows, shard_terms=shard_terms, block=block, ranks=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_force([r.asDict() for r in rows.collect()], 7)


def test_clashing_columns_and_empty_tables(spark, documents, no_documents):
    assert D.audit(no_documents).count() == 0
    assert sorted(map(tuple, D.audit(documents).collect())) == brute_force([r.asDict() for r in documents.select("text", "lang", "source").collect()])


def test_no_kept_terms_gives_pairs_of_value_zero(spark):
    docs = spark.createDataFrame([("only here", "en", "a"), ("123", "en", "b"), (None, "en", None)], "text string, lang string, source string")
    assert sorted((r.source, r.item, r.value, r.part) for r in D.audit(docs).collect()) == sorted(
        (a, b, 0, "pair") for a in ("a", "b", "") for b in ("a", "b", "") if a != b)


def test_task_sends_on_what_it_cannot_hold(monkeypatch):
    monkeypatch.setattr(D, "HELD", 4)
    b = pa.RecordBatch.from_pydict({"text": [prose(i, 30) for i in range(20)], "lang": ["en"] * 20, "source": ["a", "b"] * 10})
    rows = [r for out in D._frequencies([b.slice(i, 1) for i in range(20)]) for r in out.to_pylist()]
    total = Counter()
    for r in rows:
        total[r["term"]] += r["n"]
    assert total == Counter(w for i in range(20) for w in set(prose(i, 30).split())) and len(rows) > len(total)


@pytest.mark.parametrize("levels", [0, 1, 2, 32])
def test_perfect_hash_is_minimal_and_verified(levels):
    words = sorted({w for i in range(400) for w in prose(i, 30).split()} | {f"t{i}" for i in range(3000)} | {"", "x" * 3000})
    shard = D.Shard.build(pa.array(words, pa.string()), levels)
    raw, offsets = buffers(pa.array(words + ["absent", "t3001", "x" * 2999], pa.string()))
    raw, sizes = padded(raw), np.diff(offsets)
    slots = shard.find(raw, offsets[:-1], sizes, span_hashes(raw, offsets[:-1], sizes))
    assert sorted(slots[: len(words)].tolist()) == list(range(len(words))) and (slots[len(words):] == -1).all()
    assert [x.as_py().decode() for x in shard.terms(slots[: len(words)])] == words


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "span_hashes", lambda raw, starts, sizes: np.where(sizes > 2, np.uint64(7), sizes.astype(np.uint64)))
    words = ["a", "bb", "ccc", "ddd", "eee", "ffff"]
    shard = D.Shard.build(pa.array(words, pa.string()))
    raw, offsets = buffers(pa.array([*words, "ggg", "b"], pa.string()))
    raw, sizes = padded(raw), np.diff(offsets)
    slots = shard.find(raw, offsets[:-1], sizes, D.span_hashes(raw, offsets[:-1], sizes))
    assert sorted(slots[:6].tolist()) == list(range(6)) and slots[6:].tolist() == [-1, -1]


def test_shares_are_exact_for_large_counts():
    for counts, total in (([0, 5, 10**12], 10**12 + 10**7), ([3], 4), ([0], 1), ([10**15], 10**15 + 3)):
        assert D.scaled(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]
