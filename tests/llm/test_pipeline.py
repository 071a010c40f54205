"""run() against brute-force versions of its stages on a small table."""

import re

import corpus_pipeline as C
from tokenizers import Tokenizer

from ledgerlens.llm.queries import ORACLES, QUERIES, tokenizer_path

from .conftest import CLASHES, prose
from .test_decontaminate import brute as overlaps
from .test_jaccard import brute as components
from .test_language import texts
from .test_packing import check
from .test_secrets import expected as secrets


def table():
    item = prose(70, 30)
    out = [(i, texts("en", i) + " " + prose(i, 60 + i), "en", f"src{i % 3}", None) for i in range(40)]
    out += [(100 + i, texts("de", i, 2) + f" wort{i} zeile{i} garten{i} " * 5, "de", "src1", None) for i in range(30)]
    out += [(200 + i, out[i][1] + f" tail{i}", "en", "src2", None) for i in range(10)]  # near copies
    out += [(300 + i, prose(400 + i, 80) + " " + item + " " + prose(500 + i, 40), "en", "src0", None) for i in range(4)]  # leaks
    out += [(400 + i, prose(600 + i, 90) + f' token = "{i:02d}ab34cd56ef78{i:02d}ab34cd56ef" end', "en", "src0", 1) for i in range(6)]
    out += [(500, texts("de", 3), "en", "src0", 1), (501, None, "en", None, None), (502, "", None, None, None), (None, prose(777, 70), None, None, None)]
    return out, item


def test_run_against_brute_force(spark, tmp_path):
    data, item = table()
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(i, t) for i, t, *_ in data if i != 500]  # German declared English
    by_component = {}
    for line in components(left):
        x, _, c = eval(line)  # noqa: S307 - our own tuples
        by_component.setdefault((c, x) if c is None or c == x else (c,), []).append(x)
    leaders = {eval(s)[2] for s in components(left)}  # noqa: S307
    left = [(i, t) for i, t in left if i in leaders or i is None or not t]
    left = [(i, t) for i, t in left if not overlaps(t, item)]

    def redacted(t):
        spans, out, end = secrets(t), [], 0
        for s, _, e in spans:
            if s >= end:
                out += [t[end:s], "[SECRET]"]
            end = max(end, e)
        return "".join([*out, (t or "")[end:]]) if spans else t

    left = [(i, redacted(t)) for i, t in left]
    assert any("[SECRET]" in (t or "") for _, t in left) and len(left) == len({str(i) for i, _ in left})
    got = C.run(spark, str(tmp_path)).collect()
    check(got, left, Tokenizer.from_file(tokenizer_path()))
    assert {str(r["doc_id"]) for r in got} == {str(i) for i, _ in left}


def test_stages_on_edge_rows(spark, documents, no_documents, tmp_path):
    spark.createDataFrame([(1, prose(70, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert 4 <= len(C.STAGES) <= 5
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, documents, str(tmp_path))
        assert out.count() > 0
        assert stage(spark, no_documents, str(tmp_path)).count() == 0
        if k < len(C.STAGES) - 1:
            assert out.columns == C.COLUMNS and not set(out.columns) & set(CLASHES)


def test_queries_are_registered():
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)
