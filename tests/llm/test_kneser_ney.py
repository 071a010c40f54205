import math
import re
import zlib
from collections import Counter

import pytest

from ledgerlens.llm import kneser_ney as K

from .conftest import prose, rows


def tokens(t):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "</s>"]


def discounts(counts):
    n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
    if min(n) <= 0:
        return [0, 0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0, *(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i) for i in (1, 2, 3))]


class Brute:
    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.words.update(w)
            self.pairs.update(zip([None, *w[:-1]], w, strict=True))
        self.right = Counter(w for _, w in self.pairs)
        self.d2, self.d1 = discounts(self.pairs.values()), discounts(self.right.values())
        self.after = Counter()
        self.kinds = {}
        for (v, _), n in self.pairs.items():
            self.after[v] += n
            self.kinds.setdefault(v, [0, 0, 0, 0])[min(n, 3)] += 1

    def p(self, v, w):
        total = sum(self.right.values())
        c = self.right[w]
        of = [0, 0, 0, 0]
        for x in self.right.values():
            of[min(x, 3)] += 1
        backed = sum(self.d1[i] * of[i] for i in (1, 2, 3)) / total if total else 1.0
        p1 = max(c - self.d1[min(c, 3)], 0) / max(total, 1) + backed / (len(self.words) + 1)
        if v not in self.after:
            return p1
        n = self.pairs[v, w]
        freed = sum(self.d2[i] * self.kinds[v][i] for i in (1, 2, 3)) / self.after[v]
        return max(n - self.d2[min(n, 3)], 0) / self.after[v] + freed * p1


@pytest.mark.parametrize("hot", [1000, 5])
def test_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(K, "HOT", hot)
    items = [(i, prose(i % 9, 10 + 7 * i) + (f" rare{i} rare{i % 5}" if i % 2 else "")) for i in range(40)] + [(100, None), (101, ""), (102, "never seen words here"), (None, "the river")]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in items}
    model = Brute([t for i, t in items if not held[i]])
    for r in K.score_documents(df).collect():
        t = next(x for i, x in items if i == r["doc_id"])
        w = tokens(t)
        total = sum(model.words.values())
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(x in model.words for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((model.words[x] + 1) / (total + len(model.words) + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(model.p(v, x)) for v, x in zip([None, *w[:-1]], w, strict=True)), rel_tol=1e-9)
    for v in (None, "the", "never-seen"):
        assert math.isclose(sum(model.p(v, w) for w in [*model.words, "unknown"]), 1, rel_tol=1e-9)


def test_hot_words_are_split_over_shards(spark, monkeypatch):
    """The same model, though the threshold makes frequent words hot."""
    items = [(i, " ".join(f"the w{(i * 37 + j) % 211}" for j in range(200))) for i in range(30)]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    one = {r["doc_id"]: r["score"] for r in K.score_documents(df).collect()}
    monkeypatch.setattr(K, "HOT", 10**9)
    model = K.train(df)
    monkeypatch.setattr(K, "HOT", 4)
    hot = K.train(df)
    assert len(model.hot) >= 1 and len(hot.hot) >= 2
    a = {r["doc_id"]: r["score"] for r in K.scored(df, model).collect()}
    b = {r["doc_id"]: r["score"] for r in K.scored(df, hot).collect()}
    assert a.keys() == b.keys() == one.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)


def test_edge_rows(documents, no_documents):
    got = K.score_documents(documents).collect()
    assert len(got) == len(rows()) and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert K.score_documents(no_documents).count() == 0
    only_held = documents.where("crc32(cast(doc_id as string)) % 7 = 2")
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in K.score_documents(only_held).collect())
