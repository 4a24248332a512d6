import html
import re

from quillspark.llm import html_text as H


def plain(page):
    """The article of the test pages, which have one template."""
    text = re.sub(r"<(?:/?p|/?h1|br)>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    return " ".join(html.unescape(re.sub(r"</?b>", "", text)).split())


def test_pages(spark, data):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = H.op3_html(spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["text"], r["n_chars"], r["url"]) == (plain(pages[r["page_id"]]["html"]), len(r["text"]), pages[r["page_id"]]["url"])


def site(n, seed, main="div"):
    words = lambda k: " ".join(f"w{(seed * 31 + n * 7 + k * i) % 997}" for i in range(40))
    return (
        f"<html><head><title>t</title><style>p{{}}</style></head><body><div><a href=/>Home</a><a href=/x>About</a></div><div>Offer of the day</div>"
        f"<{main}><h2>Title {n}</h2><p>{words(3)}</p><p>{words(5)} &amp; <b>more</b></p><ul><li>{words(7)}</ul></{main}><div>All rights reserved</div><script>var a='<p>no</p>'</script></body></html>"
    )


def test_template_without_markup_hints(spark):
    """Nothing names the content: the parts that vary over a host's pages are it."""
    rows = [(i, f"http://one.example/{i}", site(i, 1)) for i in range(40)] + [(100 + i, f"http://two.example/{i}", site(i, 2, "section")) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, page in rows:
        want = re.search(r"<h2>(.*?)</ul>", page, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:h2|p|ul|li)>", " ", want))).split())
        assert got[i] == want


def test_sibling_headline_lead_and_body(spark):
    """Without an article, headline and lead beside a long body stay; so do paragraphs that the shorter reference lacks."""
    words = lambda i, k, n: " ".join(f"w{(i * 37 + k * j) % 991}" for j in range(n))
    story = lambda i: f"<html><body><div>Home</div><div class=story><h1>T{i}</h1><div class=lead>{words(i, 3, 12)}</div><div class=text>{words(i, 5, 200)}</div></div><div>Imprint</div></body></html>"
    grown = lambda i: "<html><body><div>Home</div><div class=story>" + "".join(f"<section>{words(i, k + 2, 20)}</section>" for k in range(1 + i % 4)) + "</div><div>Imprint</div></body></html>"
    rows = [(i, "http://one.example", story(i)) for i in range(24)] + [(100 + i, "http://two.example", grown(i)) for i in range(24)] + [(200, "http://three.example", story(200).replace("<div>Home</div>", "").replace("<div>Imprint</div>", ""))]
    got = {r["page_id"]: r["text"] for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, page in rows:
        inside = re.search(r"<div class=story>(.*?)</div>(?:<div>Imprint|</body)", page)[1]
        assert got[i] == " ".join(re.sub(r"<[^>]*>", " ", inside).split()), i


def test_copies_are_no_template(spark):
    """A host of one page's copies, or of one page, keeps its text."""
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>same words here</p></article><footer>f</footer></body></html>"
    rows = [(i, "http://copies.example/a", page) for i in range(30)] + [(99, "http://single.example", page)]
    assert {r["text"] for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"T same words here"}


def test_boilerplate_is_left_out():
    page = """<html><body><header><a href=/>Site</a></header><nav>m</nav><div class="cookie-notice">We use cookies</div><div id=content><h1>T</h1><p>One &amp; two<br>three<p>Four
      <form><input><button>Go</button></form><div class="share">Share</div></div><aside>side</aside><section class=comments><article class="comment"><p>nice</p></article></section><footer>f</footer></body></html>"""
    assert H.extract(page, None) == "T One & two three Four"
    assert H.extract("<article><h1>A</h1><p>b</p><section id='comments'><p>c</p></section><aside>d</aside></article>", None) == "A b"


def test_wrappers_named_like_boilerplate():
    for name in ("class='content has-sidebar'", "class=no-sidebar", "class=with-nav", "id=page-menu-2", "class='layout-with-sidebar'"):
        for inner in ("<article><h1>T</h1><p>body text</p></article>", "<main><h1>T</h1><p>body text</p></main>", "<div><h1>T</h1><p>body text</p></div>", "<div>T</div><p>body text</p>"):
            assert H.extract(f"<html><body><nav>m</nav><div {name}>{inner}<div class=sidebar>side</div></div><footer>f</footer></body></html>", None) == "T body text", (name, inner)
    assert H.extract("<body><div class=site-nav-wrap id=page-menu-2><div class=menu-1><article><p>deep</p></article></div></div></body>", None) == "deep"
    assert H.extract("<body><div class=story><p>a long enough story</p></div><section class=related><article>tease</article></section></body>", None) == "a long enough story"


def test_tree_matching_is_optimal(monkeypatch):
    import random

    rng = random.Random(2)
    known = H.Shapes()

    def tree(depth):
        return known.number(rng.choice("abc"), tuple(tree(depth - 1) for _ in range(rng.randrange(4))) if depth else ())

    def slow(x, y):
        if known.tag[x] != known.tag[y]:
            return 0
        a, b = known.kids[x], known.kids[y]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + slow(p, q))
        return 1 + best[-1][-1]

    for cells in (H.CELLS, 2):  # in one table, and halved
        monkeypatch.setattr(H, "CELLS", cells)
        known.matches.clear()
        for _ in range(300):
            a, b = tree(3), tree(3)
            total, pairs = known.match(a, b)
            assert total == slow(a, b)
            assert total == 0 or total == 1 + sum(known.match(known.kids[a][i], known.kids[b][j])[0] for i, j in pairs)
            assert list(pairs) == sorted(pairs)


def test_deep_wide_and_unbalanced_pages():
    """Pages of any form come through whole, in time about their size."""
    import time

    assert H.extract("<div>" * 200 + "<nav>MENU</nav><p>text</p>", None) == "text"
    assert H.extract("<div>" * 60_000 + "deep<nav>m</nav>", None) == "deep"
    assert H.extract('a <b title="x>y</b> z', None) == "a y z"
    assert H.extract("<p title='a>b' class=x>c</p><p id=\"u>v\">d", None) == "c d"
    began = time.time()
    many = "".join(f"<article><p>t{i}</p></article>" for i in range(5000))
    assert H.extract(f"<body>{many}</body>", None) == " ".join(f"t{i}" for i in range(5000))
    assert H.extract("<div class=menu>" * 3000 + "x", None) == "x"
    known = H.Shapes()
    one, two = (known.number("div", tuple(known.number("div", (known.number(t, ()),) * (i % k)) for i in range(5000))) for t, k in (("p", 7), ("b", 5)))
    assert known.match(one, two)[0] > 5000
    assert time.time() - began < 20


def test_names_mislead(spark):
    """Two layouts on a host; the content's class is ``widget``, a notice's is ``content``: alignment tells them apart."""
    words = lambda i, k, n: " ".join(f"w{(i * 37 + k * j) % 991}" for j in range(n))
    one = lambda i: f"<html><body><div class=top>Home</div><div class=content>This site is for testing only.</div><div class=widget><p>{words(i, 3, 40)}</p><p>{words(i, 7, 30)}</p></div><div>Imprint</div></body></html>"
    two = lambda i: f"<html><body><section class=grid><section class=left>Topics</section><section class=story><h2>H{i}</h2><p>{words(i, 5, 50)}</p></section></section></body></html>"
    rows = [(2 * i, "http://one.example", one(i)) for i in range(12)] + [(2 * i + 1, "http://one.example", two(i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[2 * i] == f"{words(i, 3, 40)} {words(i, 7, 30)}"
        assert got[2 * i + 1] == f"H{i} {words(i, 5, 50)}"


def test_templates_by_join(spark, data, monkeypatch):
    """Where templates are too many to broadcast, a join gives the same texts."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    want = sorted(map(tuple, H.main_texts(pages).collect()))
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, H.main_texts(pages).collect())) == want


def test_odd_rows(spark):
    long = "<p>" + "long words " * 200_000 + "</p>"
    rows = [(1, None, None), (1, None, None), (2, "", ""), (3, "no url", "just &lt;text&gt;"), (4, "http://x.example", long), (5, "http://x.example", "<div>" * 3000 + "deep"), (6, "http://x.example", "<!-- never ends"), (None, "http://x.example", "a < b <3 &nbsp; c")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, tree int")
    got = {(r["page_id"], r["text"]) for r in H.main_texts(df).collect()}
    assert {(1, ""), (2, ""), (3, "just <text>"), (5, "deep"), (6, ""), (None, "a < b <3 c"), (4, " ".join(["long words"] * 200_000))} == got
    assert H.main_texts(df.limit(0)).collect() == []
