import re

from ledgerlens.llm import decontaminate as D

from .conftest import prose

ITEM = prose(11, 40)


def changed(text, every):
    w = text.split()
    return " ".join("changed" if i % every == every - 1 else x for i, x in enumerate(w))


def brute(doc, item):
    """Any diagonal whose best stretch scores enough."""
    d, w = (re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in (doc, item))
    if not w or not d:
        return False
    if len(w) < D.LEAST:
        return d == w
    for diagonal in range(-len(w) + 1, len(d)):
        equal = [d[j + diagonal] == w[j] for j in range(max(0, -diagonal), min(len(w), len(d) - diagonal))]
        if len(w) * 4 < D.SCORE * 5:
            if 5 * sum(equal) >= 4 * len(w):
                return True
            continue
        best = run = 0
        for e in equal:
            run = max(0, run + (1 if e else -2))
            best = max(best, run)
        if best >= D.SCORE:
            return True
    return False


def test_substituted_passages_against_brute_force(spark):
    docs = {1: prose(1, 50) + " " + ITEM + " " + prose(2, 30), 2: prose(1, 30) + " " + changed(ITEM, 9) + " end", 3: prose(3, 200), 4: ITEM.upper().replace(" ", ", "),
            5: " ".join(ITEM.split()[:14]), 6: "one two three four five", 7: None, 8: "", 9: "tiny item"}
    items = {1: ITEM, 2: "one two three four five", 3: None, 4: "", 5: "tiny item", 6: prose(12, 900), 7: ITEM}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(d, b).collect()}
    assert got == {(i, j) for i, x in docs.items() for j, y in items.items() if brute(x, y)}
    assert {r["doc_id"] for r in D.clean_documents(d, b).collect()} == set(docs) - {i for i, _ in got}


def test_many_blocks_give_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(i, prose(i, 60) + " " + prose(100 + i, 30)) for i in range(20)], "doc_id long, text string")
    b = spark.createDataFrame([(i, prose(100 + i, 30)) for i in range(20)], "item_id long, text string")
    one = sorted(map(tuple, D.overlaps(d, b).collect()))
    monkeypatch.setattr(D, "BLOCK", 4)
    assert sorted(map(tuple, D.overlaps(d, b).collect())) == one and {x[0] for x in one} == set(range(20))


def test_edge_rows(spark, documents, no_documents):
    b = spark.createDataFrame([(1, ITEM), (None, prose(2, 120)), (2, None)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in D.overlaps(documents, b).collect()]
    assert sorted(got) == [(3, None)] * 3
    left = D.clean_documents(documents, b)
    assert left.columns == documents.columns and left.count() == documents.count() - 3
    assert D.overlaps(no_documents, b).count() == 0 and D.overlaps(documents, b.limit(0)).count() == 0
    assert D.clean_documents(documents, b.limit(0)).count() == documents.count()
