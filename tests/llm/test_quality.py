import re
from collections import Counter

import pytest

from ledgerlens.llm import quality as Q

from .conftest import prose, rows


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
    return (*n, len(w) < 20 or 100 * n[4] > 30 * n[0])


TEXTS = ["a " * 9, "a b c d e f g h i a b c d e f g h", "x\n\nx\n x\nx \n\tx", "# | <>\n\x0b\x0c\r%", "é ü ß \x1c", prose(1, 30) + " " + prose(1, 30) + " " + prose(2, 100), "\n", "a\nb\na\nb"]


def test_measures_against_brute_force(spark, documents):
    items = list(enumerate(TEXTS)) + [(100 + i, prose(i, 50 + i)) for i in range(20)]
    got = {r["doc_id"]: r for r in Q.judged(spark.createDataFrame(items, "doc_id long, text string")).collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert {i: tuple(got[i][n] for n in names) for i, _ in items} == {i: brute(t) for i, t in items}
    got = Q.judged(documents).collect()
    assert sorted(str((r["doc_id"], *(r[n] for n in names))) for r in got) == sorted(str((r[0], *brute(r[1]))) for r in rows())


def test_plan_is_native(documents):
    text = Q.measures(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", text)


def test_estimates_find_the_bad_cluster():
    patterns = [((1, 1, 1, 0), 900), ((1, 1, 0, 1), 300), ((-1, -1, 1, 0), 60), ((-1, -1, 0, 1), 40), ((-1, 1, 1, 1), 5)]
    good, p = Q.estimate(patterns, 4)
    assert 0.85 < good < 0.97
    assert Q.posterior((1, 1, 1, 0), good, p) > 0.99 and Q.posterior((-1, -1, 1, 0), good, p) < 0.05
    assert p[0][0][-1] > 0.8 > 0.1 > p[0][1][-1]
    assert Q.estimate([], 3)[0] == Q.PRIOR_GOOD


def test_junk_goes_and_clean_documents_stay(spark):
    clean = [(i, ". ".join(prose(i * 10 + k, 14).capitalize() for k in range(8)) + ".") for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(i, 120).split())) for i in range(20)] + [(2000 + i, " | ".join(prose(i, 90).upper().split())) for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in Q.judged(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in junk)


@pytest.mark.parametrize("extra", [False, True])
def test_empty_table(no_documents, extra):
    df = no_documents if extra else no_documents.select("doc_id", "text")
    assert Q.judged(df).count() == 0
