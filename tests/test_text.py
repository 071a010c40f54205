"""Document processing: HTML, whitespace, chunking and sections against Python recomputations."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerlens.constants import SECTION_PATTERNS
from ledgerlens.functions import text as tx
from ledgerlens.operators import documents as dc


def _one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("s")).alias("o")).collect()[0].o


@pytest.mark.parametrize("html,expected", [
    ("<p>a</p><p>b</p>", "a b"),
    ("<P>Up&amp;Down</P>", "Up&Down"),
    ("x &amp y", "x & y"),
    ("it&#8217;s &#x41;", "it’s A"),
    ("a&nbsp;b", "a b"),
    ("<!-- <p>hidden</p> -->shown", "shown"),
    ("<script>var t='</p>';</script>keep<style>p{}</style>", "keep"),
    ("&amp;lt;", "&lt;"),
    (None, ""),
    ("<table><tr><td> a <b>b</b> c </td><td>d</td></tr><tr></tr></table>after", "abc | d after"),
    ("a<table><tr><td>o<table><tr><td>x</td></tr></table></td></tr></table>b", "a ox | x x b"),
    ("<table><tr><td>a<td>b &lt;i&gt;<tr><td>c &amp d</table>z", "a | b <i> c & d z"),
    ("<table><tr><td>never closed", "never closed"),
    ("it&rsquo;s &mdash; &sect;5 &bull; &#146; &#150;", "it’s — §5 • ’ –"),
    ("&#1114112; &#9999999; &#xD800;", "� � �"),
    ("EPS < 5 and margin > 3 this year", "EPS < 5 and margin > 3 this year"),
    ("<a title=\"a>b\" href='c>d'>t</a> <p title=it's>u <b>v</b> it's</p>", "t u v it's"),
])
def test_html_edges(spark, html, expected):
    assert _one(spark, tx.html_to_text, html) == expected


def test_whitespace_and_words(spark):
    s = "a b c\x1cd  e　f"
    assert _one(spark, tx.collapse_ws, s) == "a b c d e f"
    assert _one(spark, tx.split_words, s) == s.split()


@pytest.mark.parametrize("n", [0, 1, 412, 413, 512, 513, 924, 1500])
def test_chunk_counts(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    words = text.split()
    exp = [" ".join(words[i:i + 512]) for i in range(0, len(words), 412)]
    assert _one(spark, tx.chunk_words, text) == exp


def test_chunk_only_spaces_and_separators(spark):
    assert _one(spark, tx.chunk_words, "   ") == []
    assert _one(spark, tx.chunk_words, "") == []
    assert _one(spark, tx.chunk_words, "a b c\x1cd") == ["a b c d"]


# ------------------------------------------------------------------ sections: Python transcription of the rules
def py_sections(text, ftype, max_span=None, keep=None):
    out = {}
    for name, pat in SECTION_PATTERNS.get(ftype, {}).items():
        ms = list(re.finditer(pat, text, re.IGNORECASE))
        best, best_len = None, 0

        def end_of(s):
            nxt = list(re.finditer(r"ITEM\s*\d+[A-Z]?\.", text[s + 100:], re.IGNORECASE))
            return s + 100 + nxt[0].start() if nxt else min(s + (max_span or len(text)), len(text))

        for m in ms:
            if m.start() < 10000 and len(ms) > 1:
                continue
            e = end_of(m.start())
            if e - m.start() > best_len:
                best, best_len = (m.start(), e), e - m.start()
        if best is None and ms:
            best = (ms[0].start(), end_of(ms[0].start()))
        if best:
            body = text[best[0]:best[1]]
            if len(body) > 500:
                out[name] = body[:keep]
    return out


def _filler(n, seed):
    words = ["alpha", "beta", "gamma", "delta", "item", "risk", "factors", "analysis"]
    return " ".join(words[(i * 7 + seed) % len(words)] for i in range(n))


CASES = [
    ("10-K", "ITEM 1. " + _filler(300, 1) + " ITEM 1A. " + _filler(300, 2) + " ITEM 7. " + _filler(300, 3)
     + " ITEM 8. " + _filler(300, 4)),
    ("10-K", "Table of contents ITEM 7. ITEM 8. " + _filler(2500, 5) + " ITEM 7. Management's Discussion and "
     + _filler(200, 6) + " Analysis " + _filler(300, 7) + " ITEM 8. " + _filler(400, 1) + " Analysis end"),
    ("10-Q", "Management " + _filler(50, 2) + " Discussion " + _filler(50, 3) + " ITEM 2. " + _filler(200, 1)
     + " Analysis " + _filler(100, 4) + " Risk Factors " + _filler(200, 5)),
    ("10-Q", "no headings at all " + _filler(500, 3)),
    ("8-K", "ITEM 1. " + _filler(400, 1)),
    ("10-K", "ITEM 1. " + "x" * 493),
    ("10-K", "ITEM 1. " + "x" * 494),
    ("10-K", "Description of the " + _filler(200, 2) + " Business " + _filler(300, 3) + " ITEM 1. " + _filler(300, 5)),
    ("10-K", "RiskFactors " + _filler(3000, 6) + " risk  factors " + _filler(300, 6) + " ITEM 7. tail"),
    # body over 50,000 characters: whole, or cut on request
    ("10-K", _filler(2000, 1) + " ITEM 7. " + "w " * 30000 + " ITEM 8. " + _filler(200, 2)),
    # two candidate spans of equal length after the table of contents: the earlier one wins
    ("10-K", _filler(2000, 3) + " ITEM 1A. " + "x" * 700 + " ITEM 9. " + "y" * 50 + " ITEM 1A. " + "x" * 700
     + " ITEM 9. " + "z" * 50),
]


def test_sections_match_python_rules(spark):
    rows = [(i, t, txt) for i, (t, txt) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, filing_type string, text string")
    got = {}
    for r in dc.extract_sections(df).collect():
        got.setdefault(r.id, {})[r.section] = r.text
    for i, (t, txt) in enumerate(CASES):
        assert got.get(i, {}) == py_sections(txt, t), i
    cut = {}
    for r in dc.extract_sections(df, max_span=1000, keep_chars=700).collect():
        cut.setdefault(r.id, {})[r.section] = r.text
    for i, (t, txt) in enumerate(CASES):
        assert cut.get(i, {}) == py_sections(txt, t, 1000, 700), i


def test_many_matches_take_linear_time(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        df = spark.createDataFrame([("ITEM 1. x " * n,)], "s string")
        spans = df.select(F.size(tx.match_spans(F.col("s"), r"ITEM\s*\d+\.")).alias("n"))
        began = time.time()
        assert spans.first().n == n
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 4


def test_filing_without_content_keeps_an_error_row(spark):
    html = "<p>ITEM 1. " + "word " * 300 + "</p>"
    df = spark.createDataFrame([("A", "10-K", None, "a", html), ("B", "10-K", None, "b", None)], "ticker string, filing_type string, filing_date date, file_path string, html string")
    got = dc.process_filings(df).collect()
    assert [r.error for r in got if r.ticker == "A"] == [None] and [(r.error, r.text) for r in got if r.ticker == "B"] == [("no content", None)]


def test_sections_on_fixture_filings(spark):
    from tests.conftest import SF001
    from ledgerlens.plans import bindings as b

    f = b.synthetic_filings(spark, SF001).select("ticker", "filing_type", "file_path", "text")
    got = {}
    for r in dc.extract_sections(f).collect():
        got.setdefault(r.file_path, {})[r.section] = r.text
    n = 0
    for r in f.collect():
        exp = py_sections(r.text, r.filing_type)
        assert got.get(r.file_path, {}) == exp
        n += len(exp)
    assert n > 5


def test_chunk_id_key_renders_timestamp(spark):
    df = spark.createDataFrame([("A", "10-K", "2024-02-01", "MD&A", 3), ("A", "10-K", None, "MD&A", 0)],
                               "t string, ft string, d string, s string, c int")
    r = df.select(dc.chunk_id_key(F.col("t"), F.col("ft"), F.col("d").cast("date"), F.col("s"), F.col("c"))
                  .alias("k")).collect()
    assert r[0].k == "A_10-K_2024-02-01 00:00:00_MD&A_3"
    assert r[1].k == "A_10-K_NaT_MD&A_0"


def test_entities_match_html_unescape(spark):
    import html
    import random
    from html.entities import html5

    keys = sorted(html5)
    rnd = random.Random(11)
    cases = ["&amp;lt;", "x &amp y", "&copyright", "&rsquo;&mdash;&sect;", "&notit;", "&#0;&#128;&#x110000;&#xD800;",
             "&#00000065;", "&AMP &Amp;", "& alone &;", "&quot&apos &apos;"]
    for _ in range(200):
        cases.append("".join(rnd.choice(["a", " ", "&", ";", "#", "x", "1", "&" + rnd.choice(keys),
                                         "&#" + str(rnd.randint(0, 70000))]) for _ in range(10)))
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    got = {r.i: r.o for r in df.select("i", tx.decode_entities(F.col("s")).alias("o")).collect()}
    assert [got[i] for i in range(len(cases))] == [html.unescape(c) for c in cases]


def _mangled(rnd, page):
    for _ in range(rnd.randint(1, 6)):
        i, j = sorted(rnd.randrange(len(page) + 1) for _ in range(2))
        page = rnd.choice([
            page[:i] + rnd.choice(["<![", "<!x[ y", "<![CDATA[", "<![if gte]>", "<!DOCTYPE [", "<?", "</", "<!--", "&#x", "&#99999999;", "<table", "\x00", "퟿", "]]>", "<td", "&rsquo;"]) + page[i:],
            page[:i] + page[j:], page[:i] + page[i:j] * 2 + page[j:]])
    return page


def test_mangled_pages_never_raise():
    from ledgerlens.functions.text import lenient_text

    rnd = random.Random(11)
    page = "<!DOCTYPE html><p>a &rsquo; <b>b</b><table><tr><td>1<td>2<table><tr><td>3</table></table><script>x</script><![CDATA[ c ]]> d"
    for _ in range(1000):
        assert isinstance(lenient_text(_mangled(rnd, page)), str)
    assert lenient_text("<p>x &rsquo; <!x[ y <![ z").split()[:2] == ["x", "’"]
    assert lenient_text("<p>a<![if x]>b<![endif]>c").split() == ["abc"]  # as other comments, no break of the text


def test_a_page_that_cannot_be_read_is_a_row_with_an_error(spark, monkeypatch):
    def fails(page):
        raise AssertionError("expected name token")

    assert tx.read_or_error("x", fails) == (None, "AssertionError: expected name token")
    assert tx.read_or_error(None, fails) == (None, None)
    body = "ITEM 1. " + "word " * 400
    rows = [("A", "10-K", "a", f"<p>{body}</p>"), ("B", "10-K", "b", None), ("C", "10-K", "c", f"<p>x &rsquo; <!x[ y <![ z {body}"), ("D", "10-K", "d", "")]
    f = spark.createDataFrame(rows, "ticker string, filing_type string, file_path string, html string").selectExpr("*", "DATE'2020-01-01' AS filing_date")
    got = dc.process_filings(f).collect()
    assert [(r.ticker, r.error, r.text, r.metadata.file_path, r.metadata.total_chunks) for r in got if r.error] == [("B", "no content", None, "b", None)]
    assert {r.ticker for r in got} >= {"A", "B"} and "D" not in {r.ticker for r in got}


@pytest.mark.parametrize("max_span", [None, 300])
def test_best_span_equals_the_rules_and_is_linear(spark, max_span):
    from ledgerlens.constants import SECTION_SEARCH_OFFSET as OFF
    from ledgerlens.operators.documents import _best_span

    rnd = random.Random(2)
    rows = [(i, 20000, sorted(rnd.choices(range(0, 9000, 10), k=rnd.randint(0, 12))), sorted(rnd.choices(range(0, 19000, 10), k=rnd.randint(0, 12)))) for i in range(200)]

    def expected(n, starts, items):
        def end(s):
            return min([x for x in items if x >= s + OFF], default=min(s + max_span, n) if max_span else n)

        if not starts:
            return None
        best = max(((end(s) - s, -s) for s in starts if len(starts) == 1 or s >= 2000), default=(0, 0))
        return (-best[1], best[0]) if best[0] > 0 else (starts[0], end(starts[0]) - starts[0])

    schema = "id int, n int, starts array<int>, items array<int>"
    df = spark.createDataFrame(rows, schema).select("id", _best_span(F.col("n"), F.col("starts"), F.col("items"), 2000, max_span).alias("b"))
    assert {r.id: r.b and tuple(r.b) for r in df.collect()} == {i: expected(n, s, t) for i, n, s, t in rows}
    if max_span is None:
        took = {}
        for size in (2000, 8000, 32000):
            big = spark.range(1).select(F.lit(size * 100).alias("n"), F.transform(F.sequence(F.lit(1), F.lit(size)), lambda x: x * 100).alias("starts")).withColumn("items", F.col("starts"))
            run = big.select(_best_span(F.col("n"), F.col("starts"), F.col("items"), 2000, None).alias("b"))
            run.collect()
            t = time.perf_counter()
            run.collect()
            took[size] = time.perf_counter() - t
        assert took[32000] < 1 + 8 * took[8000], took
