import numpy as np
from pyspark.sql import types as T

from quern.llm import html as h

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{a>b}</style><script>var t="</p><article>";</script></head><body class="home-page">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>Head&nbsp;&lt;1&gt;</h1><p><b>One  two<br>three <p>Four &eacute;<div class='advert-box'>Ad</div>five<form>Name <input></form>
<aside>Side</aside><ul><li>item<li>next</ul><section id="comments"><p>Nice!</section><p hidden>no</p>last <a title="a>b">link</a></article><footer>&copy; me</footer></body></html>"""
SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def test_structure():
    _, article = h.page_blocks(PAGE)
    assert article == ["Head <1>", "One two three", "Four é", "five", "item", "next", "last link"]
    assert h.page_blocks(None) == ([], None) and h.page_blocks("") == ([], None)
    assert h.page_blocks("a < b & c &lt; <b>d</b> <unclosed") == (["a < b & c < d <unclosed"], None)
    assert h.page_blocks("<article>never closed <p>x")[1] == ["never closed", "x"]


def test_marks():
    text = lambda page: h.page_blocks(page)[1]
    assert text('<div class="page has-sidebar"><main class="content sidebar-right"><p>a</p></main><div class="sidebar">b</div></div>') == ["a"]
    assert text('<article><div class="article-header"><h1 class="header">T</h1></div><p>a</p></article><div class="comments"><article><p>c</p></article></div><article class="comment">d</article>') == ["T", "a"]
    assert text('<article><header><h1>T</h1></header><p class="ad">x</p><p>a</p><footer>f</footer><div class="newsletter">n</div></article>') == ["T", "a"]
    assert text("<nav><article>x</article></nav><article>a</article>") == ["a"]


def brute(streams, pages, k):
    seen = {}
    for s, p in zip(streams, pages):
        for i in range(len(s) - k + 1):
            seen.setdefault(tuple(s[i : i + k]), set()).add(p)
    return [any(len(seen[tuple(s[i : i + k])]) > 1 for i in range(max(0, j - k + 1), min(j, len(s) - k) + 1)) for s in streams for j in range(len(s))]


def test_suffix_array_equals_brute_force():
    rng = np.random.default_rng(1)
    for k in (1, 2, 4, 8):
        streams = [rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint64) for _ in range(12)]
        pages = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9])
        assert h.repeated_windows(streams, pages, k)[0].tolist() == brute(streams, pages, k)


def pages(spark, n, host="h.org"):
    boiler = "<p>All rights of this site are reserved by the owner of it.</p>"
    rows = [(i, f"http://{host}/{i}", f"<div>{boiler}<p>Page number {i} has words a{i} b{i} c{i} d{i} e{i} of its own.</p></div>") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_hosts(spark):
    for slice_tokens in (10**6, 60):
        got = h.main_text(pages(spark, 20), h.Repeats(slice_tokens=slice_tokens)).collect()
        assert len(got) == 20 and all(r.text == f"Page number {r.page_id} has words a{r.page_id} b{r.page_id} c{r.page_id} d{r.page_id} e{r.page_id} of its own." for r in got)
    alone = h.main_text(pages(spark, 1)).collect()[0]
    assert alone.text.startswith("All rights")
    copies = pages(spark, 1).union(pages(spark, 1).selectExpr("page_id + 1", "concat(url, 'x')", "html"))
    assert all(r.text == alone.text for r in h.main_text(copies).collect())


def test_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, None), (2, "", ""), (None, "x", PAGE), (3, "http://h", PAGE), (3, "http://h", PAGE), (4, "http://u@h:1/", "just text")], SCHEMA)
    for c in ("text", "host", "blocks", "settled", "slice"):
        frame = frame.selectExpr("*", f"'x' {c}")
    rows = h.main_text(frame).collect()
    assert len(rows) == 6 and sorted(r.text for r in rows)[:3] == ["", "", "Head <1>\n\nOne two three\n\nFour é\n\nfive\n\nitem\n\nnext\n\nlast link"]
    assert h.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_slices_change_nothing(spark):
    """Copies of a page in other slices don't make it boilerplate; neither do pages too short for a window."""
    text = " ".join(f"only{k}" for k in range(40))
    copies = spark.createDataFrame([(i, f"http://h.org/{i}", f"<div{' ' * i}><p>{text}</p></div>") for i in range(12)] + [(12, "http://h.org/s", "<p>too short</p>")], SCHEMA)
    frame = copies.union(pages(spark, 8).selectExpr("page_id + 20", "url", "html"))
    one, many = ({r.page_id: r.text for r in h.main_text(frame, h.Repeats(slice_tokens=n)).collect()} for n in (10**6, 60))
    assert one == many and all(many[i] == text for i in range(12)) and many[12] == "too short" and many[20].startswith("Page number 0")


def brute_articles(texts, k=8, cover=0.5, percent=90, least=10):
    """Texts of one host's articles by plain counting of windows."""
    words = [t.split() for t in texts]
    seen = {}
    for w in {tuple(w) for w in words if w}:
        for window in {w[i : i + k] for i in range(len(w) - k + 1)}:
            seen[window] = seen.get(window, 0) + 1
    n = len({tuple(w) for w in words if w})
    known, out = {w for w, c in seen.items() if c >= least and 100 * c >= percent * n}, []
    for t, w in zip(texts, words):
        covered = [any(tuple(w[i : i + k]) in known for i in range(max(0, j - k + 1), j + 1)) for j in range(len(w))]
        kept, at = [], 0
        for b in t.split("\n\n"):
            size = len(b.split())
            kept += [b] if sum(covered[at : at + size]) < cover * size else []
            at += size
        out.append("\n\n".join(kept) if 0 < 2 * sum(covered) < len(w) else t)
    return out


def test_articles_are_settled_by_the_suffix_array(spark):
    """What nearly all articles of a host repeat goes; what some of them share, or few articles or copies have, stays."""
    notice, shared = "Sign in to read all of the stories of this paper today.", "A passage that a third of all articles quote from one another word by word."
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    blocks = {"h.org": [], "few.org": [], "near.org": [], "copies.org": []}
    for i in range(60):
        blocks["h.org"].append([f"Title {i}", *[shared] * (i % 3 == 0), own(i, 30), *[notice] * (i % 20 > 0), own(-i, i % 7 + 1), *["By the same notice: " + notice] * (i % 2)])
    blocks["h.org"] += [blocks["h.org"][0]] * 30 + [[notice], ["short"], []]
    blocks["few.org"] = [[notice, own(i, 30)] for i in range(9)]
    blocks["near.org"] = [[f"Title {i}", own(0, 200)] for i in range(20)]
    blocks["copies.org"] = [[notice, own(0, 30)]] * 20
    rows = [(100 * k + i, f"http://{host}/{i}", f"<nav>{i}</nav><article>{''.join(f'<p>{b}</p>' for b in page)}</article>") for k, (host, pages_) in enumerate(blocks.items()) for i, page in enumerate(pages_)]
    want = {}
    for k, pages_ in enumerate(blocks.values()):
        want |= {100 * k + i: t for i, t in enumerate(brute_articles(["\n\n".join(p) for p in pages_]))}
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for given in ({}, {"slice_tokens": 300}, {"slice_tokens": 60, "slice_pages": 1}):
        got = h.main_text(frame, h.Repeats(**given)).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    assert notice not in want[1] and want[1].startswith("Title 1\n\nw1x0") and shared in want[3] and all(notice in want[100 + i] for i in range(9))
    assert all(want[200 + i].endswith("w0x199") for i in range(20)) and want[90] == notice and all(notice in want[300 + i] for i in range(20))
