import pytest
from pyspark.sql import types as T

#: names that the operators use inside or add
CLASHES = ["id", "key", "text2", "shard", "label", "n", "score", "language", "rejected", "_text", "_words", "_host", "component_id", "predicted"]

WORDS = "the and of to in that is river stone light water garden window paper silver morning letter road forest bridge music".split()


def prose(seed, n):
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if x % 3 else "ing"))
    return " ".join(out)


def rows():
    long_text = " ".join(f"{w}{i % 977}" for i, w in enumerate(prose(5, 60_000).split()))
    base = prose(1, 120)
    texts = {
        0: base, 1: base, 2: base + " extra words here", 3: prose(2, 120), 4: None, 5: "", 6: " \t\n ", 7: "one", 8: "one two three",
        9: long_text, 10: "x" * 70_000, 11: "Grüße aus Köln: " + prose(3, 60), 12: base.upper(),
    }
    out = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in texts.items()]
    out += [(3, texts[3], "en", "src0", None), (3, texts[3], "en", "src0", None), (None, prose(4, 40), None, None, None), (None, None, None, None, None), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def documents(spark):
    """Null columns, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    schema = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
                          + [T.StructField(n, T.StringType()) for n in CLASHES])
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in rows()], schema)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
