import random
import re

from evalloom.llm.html import ARTICLE, AROUND, blocks, common_lines, extracted, lines, neighbours


def text(page):
    return [t for t, _ in lines(page)]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="nav">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
<article id=x><header><h1>Title &lt;1&gt;</h1></header><p><b>One&nbsp; two<br>three.<br><p>Four <i>f</i>ive &eacute;<div class="share">share</div>
<ul><li>x<li>y</ul><table><tr><td>1<td>2</table><form><input><p>form</p></form><p hidden>hid</p><section class="comments"><article>reader</article></section></article>
<aside>side</aside><p class='notice'>cookies</p><footer>&copy; us</footer>"""


def test_article_only():
    got = lines(PAGE)
    assert [t for t, m in got if m] == ["Title <1>", "One two three.", "Four five é", "x", "y", "1", "2"]
    assert not [t for t, m in got if not m]


def test_odd_pages():
    assert text("") == [] and text("plain  text &amp; more") == ["plain text & more"]
    assert text("<p>a<p>b</div></p>c") == ["a", "b", "c"]
    assert text("<div><p>cut off <b>he") == ["cut off he"]
    assert text("a < b and c > d <p>e") == ["a < b and c > d", "e"]
    assert text("<script>never ended <p>x") == [] and text("<p>x<script></SCRIPT>y") == ["xy"]
    assert text("<p title='a > b'>q</p>") == ["q"]
    assert len(text("<p>w" * 20000)) == 20000


def lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        got = common_lines(a, b)
        assert len(got) == lcs(a, b) and got == sorted(set(got))
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in got)


def test_neighbours_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    keys = [(i, -i, rng.choice(["h1", "h1", "h2"]) if i < 60 else "only", "/" + rng.choice("abc") + str(rng.randrange(50))) for i in range(61)]
    df = spark.createDataFrame(keys, "k1 long, k2 long, host string, path string")
    got = {r.k1: r.n1 for r in neighbours(df).collect()}
    order = sorted(keys, key=lambda k: (k[2], k[3], k[0], k[1]))
    same = lambda x, y: next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
    want = {}
    for i, k in enumerate(order):
        near = [order[j] for j in (i - 1, i + 1) if 0 <= j < len(order) and order[j][2] == k[2]]
        if near:
            want[k[0]] = max(near, key=lambda n: same(n[3], k[3]))[0]
    assert got == want and 60 not in got


def test_differencing_and_cases(spark):
    body = lambda x: f"<div>Menu of all</div><p>{x} text</p><p>Own {x}</p><div>All rights reserved</div>"
    rows = [(1, "http://h.com/a1", body("one")), (2, "http://h.com/a2", body("two")), (3, "http://z.org/", PAGE), (4, None, None), (5, "bad", body("x")), (1, "http://h.com/a1", body("one"))]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "page_id long, url string, html string, k1 int, text string")
    got = {(r.page_id): r for r in extracted(df).collect()}
    assert extracted(df).count() == 6 and got[1].text == "one text\nOwn one" and got[2].text == "two text\nOwn two"
    assert got[3].text.startswith("Title <1>\nOne two") and got[4].text == "" and got[4].n_chars == 0 and got[5].text.startswith("Menu")
    assert extracted(df.limit(0)).count() == 0


def test_wrappers_do_not_take_the_article_along():
    own = lambda page: [t for t, m in lines(page) if m]
    for open_, shut in [('<div class="content-sidebar-wrap">', "</div>"), ('<div class="has-sidebar">', "</div>"), ('<div id="no-nav">', "</div>"), ('<form id="aspnetForm">', "</form>"), ("<div class=sidebar>", "</div>"), ("<aside>", "</aside>")]:
        for tag in ("article", "main"):
            assert own(f"<body>{open_}<p>menu</p><{tag}><p>One</p><p>Two</p></{tag}>{shut}<p>x</p></body>") == ["One", "Two"], open_
    assert own("<main><form id=aspnetForm><article>One</article></form></main>") == ["One"]
    assert own("<main><form id=aspnetForm><p>One two three</p></form></main>") == ["One two three"]
    # what stands in a sidebar or among comments is not taken if the page has an article or text of its own
    assert own("<article>One</article><aside><article>teaser</article></aside>") == ["One"]
    assert text("<div>One</div><div class=comments><article>reader reader</article></div>") == ["One"]
    assert text("<form id=aspnetForm><div>One two</div></form>a") == ["One two", "a"]


def test_names_are_whole():
    page = '<article><section class="menu">Soup</section><p class="share-price">Up</p><h2 id="comments">On comments</h2><div class="x ad">buy</div><div class="share_buttons">s</div><p>b</p></article>'
    assert text(page) == ["Soup", "Up", "On comments", "b"]
    assert text('<p class="ad-hoc">a</p><p class="Banner">b</p><p class="site-footer">c</p>') == ["a"]


def test_paragraphs_of_an_article_stay_whatever_their_class():
    for name in "share social promo related respond recommended popup adv pager navigation breadcrumb advertising sharing comments".split():
        assert text(f"<div class='{name}'>x y</div><article><p>One</p><p class='{name}'>Two</p><blockquote class='{name}'>Three</blockquote></article>") == ["One", "Two", "Three"], name
        assert text(f"<article><p>One</p><div class='comments'><p class='{name}'>reader</p></div></article>") == ["One"]


def test_long_pages_are_aligned_in_bounded_memory():
    import resource
    import time

    rng = random.Random(9)
    a = list(range(40_000))
    b = [x for x in a if rng.random() < 0.9] + [rng.randrange(40_000) for _ in range(500)]
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    got = common_lines(a, b)
    assert len(got) >= 0.89 * 40_000 and got == sorted(got) and time.process_time() - began < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB; all rows at once take 200 MB


def test_raw_elements_end_where_they_end():
    for n in (1, 8, 9, 300):
        for tag in ("script", "STYLE", "svg", "button"):
            assert text(f"<p>{'İ' * n}</p><{tag}>x</{tag.title()}><p>One</p><p>Two</p>") == ["İ" * n, "One", "Two"]


def test_formulas_and_left_out_lines():
    page = "<nav>Menu</nav><article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be<section id='related-work'><h2>Related work</h2><p>It was</section></article>"
    assert text(page) == ["Let x=1 be", "Related work", "It was"] and blocks(page)[0] == ("Menu", 0)


def brute(rows):
    """Neighbours by sorting, alignment by a table of lengths, and the rule on shared lines."""
    def host_path(url):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)[^/?#]*([^#]*)", url or "")
        return (m[1].lower(), m[2]) if m else ("", url or "")

    order = sorted({(*host_path(u), i, u, h) for i, u, h in rows}, key=lambda x: (x[0], x[1], x[2]))
    start = lambda x, y: next((k for k, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
    out = {}
    for n, (host, path, i, _, h) in enumerate(order):
        near = [order[j] for j in (n - 1, n + 1) if 0 <= j < len(order) and order[j][0] == host]
        own, gone = blocks(h or ""), set()
        if near:
            other = blocks(max(near, key=lambda x: start(x[1], path))[4] or "")
            a, b = [t for t, _ in own], [t for t, _ in other]
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for x in range(len(a)):
                for y in range(len(b)):
                    table[x + 1][y + 1] = table[x][y] + 1 if a[x] == b[y] else max(table[x][y + 1], table[x + 1][y])
            x, y = len(a), len(b)
            while x and y:
                if table[x - 1][y] == table[x][y]:
                    x -= 1
                elif table[x][y - 1] == table[x][y]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    if own[x][1] != ARTICLE:
                        gone.add(x)
        least = ARTICLE if any(r == ARTICLE for _, r in own) else AROUND
        out[i] = "\n".join(t for k, (t, r) in enumerate(own) if r >= least and k not in gone)
    return out


def test_extraction_against_brute_force(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(n))
    shared = [words(6) for _ in range(8)]
    rows = []
    for i in range(120):
        body = "".join(f"<p>{rng.choice(shared) if rng.random() < 0.4 else words(9)}</p>" for _ in range(rng.randrange(0, 7)))
        around = "".join(f"<div>{rng.choice(shared)}</div>" for _ in range(2))
        tag = rng.choice(["article", "main", "div", "section"])
        rows.append((i, f"http://h{rng.randrange(4)}.com/{rng.choice('abc')}/{i}", f"<nav>{rng.choice(shared)}</nav>{around}<{tag}>{body}</{tag}><footer>{words(3)}</footer>"))
    got = {r.page_id: r for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = brute(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert sum(r.n_shared > 0 for r in got.values()) > 20
