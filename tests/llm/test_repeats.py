import hashlib
from collections import Counter

import numpy as np

from ledgerlens.llm import repeats as R

from .conftest import prose, rows


def brute(items, n):
    seen = Counter()
    for _, t in items:
        b = (t or "").encode()
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for x, t in items:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((x, len(b), int(gone.sum()), R.runs(gone), hashlib.sha256(left).hexdigest()))
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r)[:5]) for r in df.collect())


def test_against_brute_force(spark):
    shared, other = prose(1, 40), prose(2, 30)
    items = [(i, prose(100 + i, 30) + " " + (shared if i % 2 else other)[i % 7 :] + " " + prose(200 + i, 20)) for i in range(24)]
    items += [(50, shared * 3), (51, "ab" * 300), (52, "é" * 200), (53, prose(3, 100)), (54, prose(3, 100)), (55, "short"), (56, None), (57, "")]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    for n in (64, 100, 150):
        assert result(R.remove_repeats(df, length=n)) == brute(items, n)


def test_hot_anchors_give_the_same(spark, monkeypatch):
    passage = prose(7, 30)
    items = [(i, f"{prose(300 + i, 25)} {passage} {prose(400 + i, 25)}") for i in range(60)]
    monkeypatch.setattr(R, "HOT", 8)
    assert result(R.remove_repeats(spark.createDataFrame(items, "doc_id long, text string"), length=100)) == brute(items, 100)


def test_pieces_of_long_rows_give_the_same(spark, monkeypatch):
    items = [(1, prose(5, 900) + prose(6, 60) + prose(8, 900)), (2, prose(9, 500) + prose(6, 60)), (3, "x" + prose(6, 60))]
    expected = brute(items, 100)
    monkeypatch.setattr(R, "SEGMENT", 700)
    raw = [(i, t) for i, t in items]
    from ledgerlens.llm.tokens import buffers
    import pyarrow as pa

    data, at = buffers(pa.array([t for _, t in raw], pa.string()))
    assert sum(len(w.at) for _, _, w in R.stretches(data, at, np.arange(3), 100)) > 3
    assert result(R.remove_repeats(spark.createDataFrame(items, "doc_id long, text string"), length=100)) == expected


def test_repeats_of_both_scans_are_found():
    found = list(R.maximal_repeats([b"xz", b"xz", b"xy"], [b"abcd", b"abce", b"abcd"], 4))
    assert (1, 4, [0, 2]) in [(a, b, sorted(m)) for a, b, m in found]  # x|abcd in contexts 0 and 2
    assert any(a == 2 and b == 3 and sorted(m) == [0, 1] for a, b, m in found)  # zx|abc


def test_edge_rows(documents, no_documents):
    items = [(r[0], r[1]) for r in rows() if len(r[1] or "") < 5000]
    small = documents.where("text IS NULL OR length(text) < 5000")
    assert result(R.remove_repeats(small)) == brute(items, 400)
    got = {r["doc_id"]: r for r in R.remove_repeats(documents).collect()}
    assert got[10]["n_removed"] == 70_000 and got[9]["n_bytes"] > 300_000
    assert R.remove_repeats(no_documents).count() == 0


def brute_words(items, n):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [re.findall("[^\\x20\\x09-\\x0D]+", (t or "").translate(lower)) for _, t in items]
    seen = Counter(tuple(ws[i : i + n]) for ws in texts for i in range(len(ws) - n + 1))
    out = []
    for (x, _), ws in zip(items, texts, strict=True):
        gone = np.zeros(len(ws), bool)
        for i in range(len(ws) - n + 1):
            if seen[tuple(ws[i : i + n])] > 1:
                gone[i : i + n] = True
        out.append((x, int(gone.sum())))
    return sorted(map(str, out))


def passage_words(df):
    return sorted(str((r["doc_id"], r["n_passage_words"])) for r in df.collect())


def test_passages_of_many_short_words_are_found(spark):
    passage = " ".join(f"p{i}" for i in range(51))  # under 400 bytes, which stay
    items = [(i, f"{prose(500 + i, 60)} {passage if i < 4 else ''} {prose(600 + i, 60)}") for i in range(8)]
    items += [(8, passage.replace(" ", "\n").upper()), (9, passage[: passage.rindex(" p49")])]
    got = {r["doc_id"]: r for r in R.remove_repeats(spark.createDataFrame(items, "doc_id long, text string")).collect()}
    assert [got[i]["n_passage_words"] for i in range(10)] == [51] * 4 + [0] * 4 + [51, 0]
    assert all(got[i]["n_removed"] == 0 for i in range(10))


def test_passage_words_against_brute_force(spark, monkeypatch):
    shared = prose(1, 40)
    items = [(i, f"{prose(100 + i, 30)} {shared[i % 7 :]} {prose(200 + i, 20)}") for i in range(24)]
    items += [(50, shared * 3), (51, "ab " * 300), (52, "é è " * 90), (53, prose(3, 100)), (54, prose(3, 100)), (55, "short"), (56, None), (57, ""), (58, " \n ")]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    for n in (5, 20, 35):
        assert passage_words(R.remove_repeats(df, words=n)) == brute_words(items, n)
    monkeypatch.setattr(R, "HOT", 8)
    assert passage_words(R.remove_repeats(df, words=20)) == brute_words(items, 20)


def test_edge_rows_of_passage_words(documents, no_documents):
    items = [(r[0], r[1]) for r in rows()]
    assert passage_words(R.remove_repeats(documents)) == brute_words(items, R.PASSAGE_WORDS)
    assert R.remove_repeats(no_documents).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept"]
