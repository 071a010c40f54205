import numpy as np
import pytest

from ledgerlens.llm import html_blocks as H

from .conftest import prose


def page(i, tail="</body></html>"):
    return (f'<!DOCTYPE html><html lang="en"><head><title>T{i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">{prose(i, 1)}</a></li><li><a>b</a></li></ul></nav>'
            f'<!-- ad --><div class="ad">{prose(i + 50, 6)}</div><article><h1>Title {i} &amp; more</h1><p><b>{prose(i, 30)}<br><p>{prose(i + 9, 12)} &copy x</p></article><footer>&copy; {i} &middot; all</footer>{tail}')


def expected(i):
    return f"Title {i} & more\n{prose(i, 30)}\n{prose(i + 9, 12)} © x"


def test_blocks_read_lenient_html():
    read = lambda h: [(b.text, b.path[-1].split()[0] if b.path else "") for b in H.blocks(h)]
    assert read("<ul><li>a<li>b<b>c</b></ul>d") == [("a", "li"), ("bc", "li"), ("d", "")]
    assert read("<table><tr><td>1<td>2<tr><td>3</table>") == [("1", "td"), ("2", "td"), ("3", "td")]
    assert read("<p title='a>b'>x &lt; y</p> a < b and c > d") == [("x < y", "p"), ("a < b and c > d", "")]
    assert read("<script>if (a<b) '<p>'</script><p>&#8217;&#1114112;&nbsp;z  w\n") == [("’� z w", "p")]
    assert read("<div>a<p>b<div>c</div>d</p></div><!-- x") == [("a", "div"), ("b", "p"), ("c", "div"), ("d", "div")]
    assert read("") == [] and read("<p>" * 50) == [] and read("<style>x") == []


def test_gradients_are_right():
    r = np.random.default_rng(1)
    model = H.Labeller(hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, lengths = H.Labeller.padded([r.standard_normal((n, H.SIZE)) for n in (4, 2)])
    x, y = x.astype(np.float64), r.integers(0, 2, x.shape[:2]).astype(float)

    def loss():
        mask = np.arange(len(x))[:, None] < lengths
        s = model._read(x, lengths)[1]
        return (np.where(mask, np.logaddexp(0, s) - y * s, 0)).sum() / mask.sum()

    grads = model.gradients(x, lengths, y)
    for k in model.p:
        for _ in range(4):
            at = tuple(int(r.integers(n)) for n in model.p[k].shape)
            old = model.p[k][at]
            model.p[k][at] = old + 1e-3
            up = loss()
            model.p[k][at] = old - 1e-3
            down = loss()
            model.p[k][at] = old
            assert abs((up - down) / 2e-3 - grads[k][at]) < 1e-3, k


@pytest.fixture(scope="module")
def model(spark):
    return H.train(spark.createDataFrame([(i, f"http://x.org/{i}", page(i)) for i in range(80)], "page_id long, url string, html string"))


def test_held_out_pages(spark, model):
    data = [(i, f"u{i}", page(i, "" if i % 3 else "</body></html>")) for i in range(200, 260)]
    got = {r["page_id"]: r for r in H.extracted(spark.createDataFrame(data, "page_id long, url string, html string"), model).collect()}
    assert all(got[i]["text"] == expected(i) and got[i]["n_chars"] == len(expected(i)) for i, _, _ in data)


def test_foreign_blocks_in_the_article_go(spark, model):
    extra = [f'<aside class="sidebar">{prose(1, 20)}</aside>', f'<div class="comments"><p>{prose(2, 20)}</p></div>', "<form><label>mail</label><button>go</button></form>", f'<div class="cookie notice"><p>{prose(3, 9)}</p></div>']
    data = [(i, None, page(i).replace("</article>", f"{e}</article>").replace("<nav>", f"<header>{prose(4, 8)}</header><nav>")) for i, e in enumerate(extra)]
    got = {r["page_id"]: r["text"] for r in H.extracted(spark.createDataFrame(data, "page_id long, url string, html string"), model).collect()}
    assert [got[i] for i in range(len(extra))] == [expected(i) for i in range(len(extra))]


def test_edge_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    odd = [(None, None, None, "x", 1), (1, "u", "", None, None), (2, "u", "plain words only", None, None), (3, "u", page(3), "x", 5), (3, "u", page(3), "x", 5), (4, None, "<article>" + f"<p>{prose(4, 50)}</p>" * 3000, None, None)]
    df = spark.createDataFrame(odd + [(100 + i, f"v{i}", page(i), None, None) for i in range(60)], schema)
    out = H.main_text(df)
    got = out.collect()
    assert len(got) == 66 and out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    assert [r["text"] for r in got if r["page_id"] == 3] == [expected(3)] * 2
    assert next(r for r in got if r["page_id"] is None)["text"] == "" and next(r for r in got if r["page_id"] == 4)["n_main"] == 3000
    assert H.main_text(df.limit(0)).count() == 0


LAYOUTS = {  # html of a body, and its main blocks; none of the names is one that training knows
    "unframed": ('<div class="post-body"><h2>{a}</h2><p>{b}</p><ul><li>{c}</li><li>{d}</li></ul></div>', "abcd"),
    "table cell": ("<table><tr><td><h1>{a}</h1><p>{b}</p><p>{d}</p></td></tr></table>", "abd"),
    "line breaks": ("<div>{b}<br><br>{d}</div>", None),
    "lists and quotes": ("<article><h1>{a}</h1><p>{b}</p><ul><li>{c}</li><li>{d}</li></ul><blockquote>{e}</blockquote></article>", "abcde"),
    "code and terms": ("<article><p>{b}</p><pre>{c}</pre><dl><dt>{a}</dt><dd>{d}</dd></dl></article>", "bcad"),
    "figure and table": ("<main><h1>{a}</h1><p>{b}</p><figure><figcaption>{c}</figcaption></figure><table><tr><td>{d}</td><td>{e}</td></tr></table></main>", "abcde"),
    "unnamed menu": ('<ul><li><a href="x">{c}</a></li><li><a href="y">{f}</a></li></ul><section id="longread"><h1>{a}</h1><p>{b}</p><p>{d}</p></section>', "abd"),
    "with comments": ('<div class="readable"><h1>{a}</h1><p>{b}</p><p>{d}</p></div><div class="comments"><p>{e}</p><p>{c}</p></div><footer><p>{f}</p></footer>', "abd"),
    "with a sidebar": ('<div id="sidebar"><p>{e}</p></div><div class="kb"><p>{b}</p><ol><li>{c}</li><li>{d}</li></ol></div><div class="newsletter"><p>{f}</p></div>', "bcd"),
}


def test_layouts_that_training_never_saw(spark, model):
    data, want = [], []
    for body, main in LAYOUTS.values():
        for i in range(20):
            t = {k: prose(1000 + 10 * i + j, n) for j, (k, n) in enumerate(zip("abcdef", (4, 40, 3, 25, 18, 5), strict=True))}
            data.append((len(data), "u", f"<html><body>{body.format(**t)}</body></html>"))
            want.append([t[k] for k in main] if main else [f"{t['b']} {t['d']}"])
    got = {r["page_id"]: r["text"].split("\n") for r in H.extracted(spark.createDataFrame(data, "page_id long, url string, html string"), model).collect()}
    right = sum(len(set(got[i]) & set(w)) for i, w in enumerate(want))
    precision, recall = right / sum(len([x for x in g if x]) for g in got.values()), right / sum(map(len, want))
    wrong = {k: sum(got[i] != want[i] for i in range(20 * n, 20 * n + 20)) for n, k in enumerate(LAYOUTS)}
    print(precision, recall, wrong)
    assert precision >= 0.97 and recall >= 0.97, wrong
