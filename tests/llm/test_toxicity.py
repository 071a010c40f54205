import zlib

from ledgerlens.llm import toxicity as X

from .conftest import prose, rows


def planted(n, bad="grunzling"):
    return [(i, prose(i, 60) + (f". you {bad}{'abcdef'[i % 6]} and {prose(i + 9, 20)}" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(n)]


def test_held_out_documents(spark):
    data = planted(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in X.toxicity(docs, labels).collect()}
    for i, _, y in data:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
        assert got[i]["predicted"] == y
    flipped = spark.createDataFrame([(i, 1 - y if got[i]["held_out"] else y) for i, _, y in data], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in X.toxicity(docs, flipped).collect()}
    assert all(again[i] == got[i]["score"] for i, _, _ in data)  # held-out labels are never read


def test_clause_transducer_channels():
    g = X.Grammar({"fool ": 5.0, "grun": 3.0})
    channel = lambda t: g.clause([g.read(w) for w in X.words(t)])
    assert channel("the fool of the garden") == [5.0, 0, 0, 0]
    assert channel("you are a fool") == [0, 5.0, 0, 0]
    assert channel("you are not a fool") == [0, 0, 5.0, 0]
    assert channel("they said you fool") == [0, 0, 0, 5.0]
    assert channel("grunzling grunter foolish") == [6.0, 0, 0, 0]
    assert channel("kill the light") == [0] * 4 and channel("we will kill you")[X.TARGETED] == g.threat
    assert X.Grammar({"fool ": 5.0}).features("no. fool")[1] > 0  # a negation ends with its clause


def test_edge_rows(spark, documents, no_documents):
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    got = X.toxicity(documents, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in X.toxicity(documents, labels.limit(0)).collect())
    assert X.toxicity(no_documents, labels).count() == 0
