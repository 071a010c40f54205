from pyspark.sql import functions as F

from ledgerlens.llm import language as L

from .conftest import rows

TEXT = {"en": "the river runs through the old town and the people walk along the water in the evening ",
        "de": "der Fluss läuft durch die alte Stadt und die Leute gehen abends am Wasser entlang ",
        "fr": "la rivière traverse la vieille ville et les gens marchent le long de l'eau le soir "}


def texts(lang, i, n=3):
    w = (TEXT[lang] * n).split()
    return " ".join(w[(j * (i % 5 + 1)) % len(w)] for j in range(len(w)))


def test_text_outweighs_a_wrong_declaration(spark):
    data = [(1000 * k + i, texts(lang, i), lang, f"{lang}{i % 4}.example.org") for k, lang in enumerate(TEXT) for i in range(60)]
    data += [(9000 + i, texts("de", i), "en", "en1.example.org") for i in range(5)]
    got = {r["doc_id"]: r for r in L.of_documents(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["language"] == lang and not got[i]["rejected"] for i, _, lang, _ in data if i < 9000)
    assert all(got[i]["language"] == "de" and got[i]["rejected"] for i, *_ in data if i >= 9000)


def test_host_decides_without_text(spark):
    data = [(i, texts("en", i), "en", "a.example.org") for i in range(50)] + [(100 + i, texts("de", i), "de", "b.example.net") for i in range(50)]
    data += [(500, None, None, "b.example.net"), (501, "", None, "a.example.org"), (502, None, None, "new.example.net"), (503, "", "de", "a.example.org")]
    got = {r["doc_id"]: r for r in L.of_documents(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert [got[i]["language"] for i in (500, 501, 502)] == ["de", "en", "de"]  # the last by its domain's suffix
    assert not any(got[i]["rejected"] for i in (500, 501, 502))


def test_priors_smooth_over_the_hierarchy(spark):
    best = spark.createDataFrame([("a.x.org", 0, 80), ("b.x.org", 1, 2), ("c.y.org", 1, 40)], "_host string, _best int, _n long")
    got = {r["_host"]: r["_prior"] for r in L.host_priors(best, 2).collect()}
    root = [81 / 124, 43 / 124]
    top = [(80 + 20 * root[0]) / 142, (42 + 20 * root[1]) / 142]
    domain = [(80 + 20 * top[0]) / 102, (2 + 20 * top[1]) / 102]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got["b.x.org"], [20 * domain[0] / 22, (2 + 20 * domain[1]) / 22], strict=True))


def test_pages_use_markup_and_address(spark):
    page = lambda lang, i: f"<html lang='{lang}-XX'><head><title>x</title></head><body><p>{texts(lang, i)}</p></body></html>"
    data = [(1000 * k + i, f"http://h{i % 3}.example.com/{lang}/{i}", page(lang, i)) for k, lang in enumerate(TEXT) for i in range(30)] + [(90009, None, None), (90010, "http://q.example.com/de/1", "")]
    got = {r["page_id"]: r for r in L.of_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(got[i]["language"] == u.split("/")[3] and not got[i]["rejected"] for i, u, _ in data[:-2])
    assert got[90010]["language"] == "de"


def test_edge_rows(documents, no_documents):
    out = L.of_documents(documents)
    assert set(out.columns) == set(documents.columns) | set(L.ADDED) and out.count() == len(rows())
    assert not out.where(F.col("rejected")).count()
    assert L.of_documents(no_documents).count() == 0
    none = L.of_documents(documents.withColumn("lang", F.lit(None).cast("string")))
    assert none.count() == len(rows()) and not none.where("rejected OR language IS NOT NULL").count()


def _words(i):
    """Twenty words of an invented language."""
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñøåæ"
    return ["".join(letters[(i * 31 + 7 * w + 11 * k * (i % 13 + 1) + (i // 13) * k) % len(letters)] for k in range(6)) for w in range(20)]


def test_every_declared_language_is_learned(spark):
    """More than 64 languages, most under a thousandth of the rows; false declarations of them and of codes without text."""
    invented = {f"q{i:02d}": _words(i) for i in range(72)}
    say = lambda words, i: " ".join(words[(i + j * (i % 7 + 1)) % 20] for j in range(60))
    data = [(i, texts("en", i), "en") for i in range(12_000)]
    data += [(100_000 + 100 * k + i, say(words, i), code) for k, (code, words) in enumerate(invented.items()) for i in range(10)]
    data += [(200_000 + k, texts("en", k), code) for k, code in enumerate(invented)] + [(300_000, texts("en", 1), "zz")]
    data += [(300_001, say(["жук", "ёлка", "щука", "юла", "эхо"] * 4, 1), "zy")]
    df = spark.createDataFrame([(*r, f"h{r[0] % 5}.example.org") for r in data], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in L.of_documents(df).collect()}
    assert len(got) == len(data)
    assert all(got[i]["language"] == lang and not got[i]["rejected"] for i, _, lang in data if i < 200_000)
    assert all(got[i]["language"] == "en" and got[i]["rejected"] for i, *_ in data if 200_000 <= i <= 300_000)
    assert got[300_001]["language"] == "zy" and not got[300_001]["rejected"]


def test_rare_values_are_evidence_and_joined(spark, monkeypatch):
    """Hundreds of address suffixes, and tables too large to broadcast whole, give what broadcast ones give."""
    n = {"en": 400, "de": 200}
    data = [(1000 * k + i, texts(lang, i), lang, f"h{i % 40}.example.org", f"{lang}{i // 2}") for k, lang in enumerate(n) for i in range(n[lang])]
    data += [(5000 + i, None, None, None, f"de{i}") for i in range(100)] + [(6000, None, None, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, host string, suffix string").repartition(3)
    run = lambda: sorted(tuple(r) for r in L.identify(df, *[F.col(c) for c in ("text", "lang", "host", "suffix")]).select("doc_id", *L.ADDED).collect())
    whole = run()
    assert [r[1] for r in whole if 5000 <= r[0] < 6000] == ["de"] * 100 and len(whole) == len(data)
    monkeypatch.setattr(L, "BROADCAST_CELLS", 10)
    assert run() == whole
