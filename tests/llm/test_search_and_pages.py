"""Main text, URL rules and top-k against plain versions."""

import math
import random
from html.parser import HTMLParser

from oracle import same_as_oracle

from tidemark.llm import htmlextract, topk, urlfilter, vectors
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_oracles(spark):
    for name, sql in ORACLES.items():
        same_as_oracle(spark, QUERIES[name], sql, SF)


def test_extract_cases():
    x = htmlextract.extract
    assert x(None) == x("") == x("<nav><a>x</a></nav>") == ""
    assert x("plain words") == "plain words"
    assert x("<p>a &amp b &lt;c&gt; &copy</p>") == "a & b <c> ©"
    page = (
        "<head><title>t</title><style>p{}</style></head><body><nav><ul><li><a>menu</a></li></ul></nav><div class=ad>Buy it now, it is cheap.</div><article><h1>A\n title</h1><p><b>One.<br><p>Two <i>parts</i>.</p>"
        '<div class="comments"><p>nice one</p></div><aside>side words</aside><p>Three.</p><script>var a="</p>";</script></article><footer>&copy; a long line of words of the footer which is longer than all</footer>'
    )
    assert x(page) == "A title\nOne.\nTwo parts.\nThree."
    assert x("<article><p>Short.</p></article><footer>many more words than the article itself has</footer>") == "Short."
    assert len(x("<p>" + "word " * 200_000 + "</p>")) == 999_999


def test_furniture_and_articles():
    x = htmlextract.extract
    words = "Some words of an article that is long enough to be found."
    assert x(f'<article><p>{words}</p><p class="ad">Buy now.</p><p>More of it.</p></article>') == f"{words}\nMore of it."
    assert x("<article><p><a href=1>All of this paragraph</a> <a href=2>is made of links</a></p></article>") == "All of this paragraph is made of links"
    assert x(f'<article><header class="post-header"><h1>The title</h1></header><p>{words}</p></article>') == f"The title\n{words}"
    assert x(f'<div class="search-results-study"><p>{words}</p></div><div class="search"><p>find it</p></div>') == words


def test_bad_markup_is_linear():
    import time

    x, start = htmlextract.extract, time.process_time()
    for page in ("<a " * 300_000, "<div>" * 100_000, "<b>" * 100_000 + "<hr>" * 100_000, '<a "> " ' * 100_000 + "'>", "<!--" * 200_000, "<script>" * 100_000, "<p><td>" + "<b>" * 50_000 + "<hr>" * 50_000, "</x>" * 200_000):
        assert x(page + "<p>the end") is not None
    assert time.process_time() - start < 30
    assert x("<div>" * 30_000 + "<p>deep words</p>").endswith("deep words")


def test_pages(spark):
    rows = [(1, None, None), (2, "u", "<p>x y</p>"), (2, "u", "<p>x y</p>"), (3, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as main_text")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmlextract.page_texts(df).collect())
    assert got == [(1, "", 0), (2, "x y", 3), (2, "x y", 3), (3, "", 0)]
    assert htmlextract.page_texts(df.limit(0)).count() == 0


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h) + len(p), len(h), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[4] if best else None, best[3] if best else urlfilter.DEFAULT


def test_urls(spark):
    r = random.Random(2)
    hosts = ["org", "example.org", "A.example.org", "b.a.example.org", "xexample.org", "com", "x.com", "net", "", "org.com"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/12?q=/es/", "/fr/#a", "/de/x", "?x", "#/", "/ES/"]
    urls = [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)] + [None, "", "example.org/es/", "a://b://c/", "x\n://example.org/es/\n"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as host", "2 as rule").repartition(3)
    more = urlfilter.RULES + [("block", "a.example.org", "/"), ("allow", "a.example.org", "/en/"), ("block", "a.example.org", "/")]
    for rules in (urlfilter.RULES, more, []):
        want = {i: plain_verdict(u, rules) for i, u in enumerate(urls)}
        for limit in (1000, 0):
            if not rules and limit == 0:
                continue
            got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in urlfilter.judge_urls(df, rules, max_broadcast=limit).collect()}
            assert got == want
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_top_k(spark, monkeypatch):
    import numpy as np

    r = random.Random(3)
    vecs = [(i, [r.choice([r.gauss(0, 0.2), 0.0, 0.1]) for _ in range(8)]) for i in range(400)]
    vecs += [(400, None), (600, [math.nan] * 8), (700, [None] * 8), (800, [math.inf] * 8), (900, [0.1] * 8), (901, [0.1] * 8), (None, [0.1] * 8)]
    # other lengths have queries and candidates of their own, and ids may repeat
    vecs += [(500, [1.0] * 3), (501, [0.5, -1.0, 0.25]), (1000, [2.0, 0.0, 0.0]), (902, []), (1100, []), (100, [0.3] * 8), (100, [0.3] * 8), (7, [0.2] * 8)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as query_id", "3 as tile").repartition(4)
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vecs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, a) in enumerate(ok):
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(ok) if m != n and len(b) == len(a))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    for tile, block in ((2048, 512), (16, 2)):
        monkeypatch.setattr(vectors, "TILE", tile)
        monkeypatch.setattr(vectors, "BLOCK", block)
        assert sorted(tuple(x) for x in topk.exact_top_k(df).collect()) == sorted(want)
    assert {q for q, *_ in want} >= {0, 100, 500, 900, 1000, 1100}
    few = topk.exact_top_k(df.where("vec_id in (100, 101, 102) and size(embedding) = 8")).collect()
    assert len(few) == 3 * 4 and topk.exact_top_k(df.limit(0)).count() == 0


def test_cutoff_leaves_tiles_closed(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng, opened = np.random.default_rng(1), []
    near, far = rng.integers(50, 90, (300, 16)), rng.integers(-90, -50, (300, 16))
    tiles = pa.Table.from_pylist([{"width": 16, "tile": t, "n": 300, "ids": list(range(t * 300, t * 300 + 300)), "part": 0, "body": vectors.body_of(v)} for t, v in enumerate((near, far))])
    asked = [{"width": 16, "part": 0, "q_tile": 0, "q_place": i, "q_id": i, "q_body": vectors.body_of(near[i])} for i in range(20)]
    lists = topk.local_lists(pa.Table.from_pylist(asked), tiles, 5, 4).to_pylist()
    cut = {i: min(r["score"] for r in lists if r["query_id"] == i and r["vec_id"] is not None) for i in range(20)}
    tops = {r["query_id"]: r for r in lists if r["vec_id"] is None}
    armed = [a | {"cut": cut[a["q_id"]], "tiles": tops[a["q_id"]]["tiles"], "tops": tops[a["q_id"]]["tops"]} for a in asked]
    exact = topk._exact
    monkeypatch.setattr(topk, "_exact", lambda q, c: opened.append(len(c)) or exact(q, c))
    found = topk.collected(pa.Table.from_pylist(armed), tiles, 5, 4).to_pylist()
    assert len(opened) == 4 and {r["vec_id"] < 300 for r in found} == {True}  # the four nodes of the first tile only


def test_pages_without_an_article():
    x = htmlextract.extract
    words = "Some words of a text that is long enough to be found by the scan, with a few more."
    for name in ("side-effects", "form-and-function", "social-history", "searchResultsStudy"):
        assert x(f'<article><p>{words}</p><section class="{name}"><p>About {name}.</p></section></article>') == f"{words}\nAbout {name}."
    for name in ("newsletter", "related-posts", "ad-slot", "adSlot", "cookie_notice", "share-buttons"):
        ad = f"<div class='{name}'><p>Please sign up to our letter now, and read on and on and on with all of us.</p><a href=1>go</a></div>"
        assert x(f"<body><div><p>{words}</p></div>{ad}<div><p>{words} Two.</p></div><div class=footer>Foot words.</div></body>") == f"{words}\n{words} Two."
    rows = "<ul><li>one</li><li>two words</li></ul><table><tr><th>term</th><th>meaning</th></tr><tr><td>a</td><td>b</td></tr></table>"
    assert x(f"<main><h1>Heading</h1>{rows}</main>") == "Heading\none\ntwo words\nterm\nmeaning\na\nb"
    assert x("<body><h1>Heading</h1><ul><li>one thing to bring</li><li>two words here</li></ul><p>And a closing line of words.</p></body>").startswith("Heading\none thing to bring\n")
    assert x(f"<body><ul><li><a href=1>Home</a></li><li><a href=2>All pages</a></li></ul><p>{words}</p></body>") == words
    assert x(f"<body><div>Before all.</div><article><p>{words}</p></article><p>{words} Outside.</p></body>") == words


class Plain(HTMLParser):
    """An extractor of another kind: the blocks of the first article, by the element stack alone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.held = [], [], []

    def end_block(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "article", "h1", "h2", "h3", "div", "li", "ul", "blockquote", "nav", "footer", "header", "aside", "form", "section", "table", "tr", "td", "pre"):
            self.end_block()
            while self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
        if tag == "br":
            self.held.append(" ")
        elif tag not in ("img", "hr", "input", "meta", "link", "wbr"):
            self.stack.append((tag, dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            if tag not in ("b", "i", "em", "strong", "a", "span", "code"):
                self.end_block()
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        names = [t for t, _ in self.stack]
        out = {"nav", "footer", "aside", "form", "script", "style", "button"} & set(names) or any(c in ("ad", "comments", "share", "related", "newsletter") for _, c in self.stack)
        if "article" in names and not out:
            self.held.append(data)


def test_pages_of_the_table_against_another_extractor(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    same = 0
    for r in rows:
        p = Plain()
        p.feed(r["html"] or "")
        p.close()
        p.end_block()
        same += htmlextract.extract(r["html"]).split("\n") == p.blocks
    assert same >= 0.99 * len(rows) > 0
