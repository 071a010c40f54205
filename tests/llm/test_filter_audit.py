import re
from itertools import permutations

from ledgerlens.llm import filter_audit as A


def fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(k for k, v in {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                                  "D": bool(re.search(r"[#$%&*|]", text))}.items() if v)


def brute_force(docs, labels):
    out, sets = [], {}
    first = {}
    for d in docs:
        if d["doc_id"] is not None:
            first[d["text"] or ""] = min(first.get(d["text"] or "", d["doc_id"]), d["doc_id"])
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, t in labels if t == 1}
    for d in docs:
        f = fails(d["text"] or "")
        if d["doc_id"] is not None and d["doc_id"] > first[d["text"] or ""]:
            f += "E"
        sets.setdefault(d["source"] or "", []).append((f, d["doc_id"] is not None and d["doc_id"] in good, d["doc_id"] is not None and d["doc_id"] in toxic))
    for part, rows in sets.items():
        shapley = {k: 0 for k in "ABCDE"}
        mine = []
        for order in permutations("ABCDE"):
            left = rows
            for step, k in enumerate(order, 1):
                gone = [r for r in left if k in r[0]]
                left = [r for r in left if k not in r[0]]
                shapley[k] += len(gone)
                mine.append((part, "".join(order), step, k, len(left), len(gone), sum(k in r[0] for r in rows) - len(gone), sum(r[0] == k for r in rows),
                             sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*r[:3], *r[4:], shapley[r[3]]) for r in mine]
    return sorted(out)


LABELS = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (2, 1, 0), (3, 1, 0), (9, None, None), (None, 1, 1), (11, 1, 1)]


def labelled(spark):
    return spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, good string")


def test_equals_brute_force_on_edge_rows(spark, documents):
    got = A.audit(documents, labelled(spark))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [r.asDict() for r in documents.select("doc_id", "text", "source").collect()]
    assert sorted(map(tuple, got.collect())) == brute_force(rows, LABELS)


def test_empty_tables(spark, documents, no_documents):
    assert A.audit(no_documents, labelled(spark)).count() == 0
    assert A.audit(documents, labelled(spark).limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[0] == 0


def test_orders_are_all_there(spark):
    docs = spark.createDataFrame([(1, "Word", "s")], "doc_id long, text string, source string")
    rows = A.audit(docs, labelled(spark)).collect()
    assert len({(r.filter_order, r.step) for r in rows}) == 600
    assert {r.shapley for r in rows if r.filter_order[r.step - 1] in "AC"} == {60}
