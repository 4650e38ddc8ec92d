"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags negative,
with weights from labelled pages; one linear scan (Kadane's) finds the
contiguous region with the highest sum.  The text is that region's blocks
without those that lie in page furniture.

Weights are log-odds, fitted on the labelled pages below: of each word's nearest
telling ancestor (paragraph, link, menu, footer, ...), and of each tag, apart for
what lies within an article and outside the articles of a page.  A run of
furniture outside an article has a bounded cost, so it doesn't part a text.

Results for unusual input: null or empty html gives an empty text; html without
tags is one block; unclosed tags, comments and cut-off character references are
read as browsers read them; a page with no word of positive weight has an empty
text; of equally good regions the first counts; very long, deeply nested and
unfinished markup costs time in proportion; repeated rows are extracted row by
row; an empty table gives an empty result.  Extra columns are ignored, or kept
by ``main_text``, which replaces a column of that name.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the page.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "head", "title", "textarea", "select", "canvas", "audio", "video"}
#: Elements that are page furniture by their name.
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "figcaption"}
#: Words of a class, id or role that tell furniture, and words that say nothing beside one.
TELLING_NAMES = re.compile(
    r"(?:ad|ads|adv|advert\w*|banners?|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|sidebars?|side|footers?|header|masthead|comments?|disqus\w*|reply|replies|cookies?|consent|gdpr|notices?|popups?|modals?|"
    r"newsletters?|subscri\w*|share|sharing|socials?|related|recommend\w*|widgets?|toolbars?|login|signup|pager|pagination|copyright|complementary|contentinfo|form|alerts?|search)"
)
PLAIN_NAMES = re.compile(
    r"(?:area|articles?|banner|bar|block|blocks|bottom|box|btn|buttons?|card|cards|col|container|content|count|cta|feed|field|fixed|global|group|holder|icons?|inner|input|item|items|layer|left|links?|list|lists|"
    r"main|mobile|more|name|outer|overlay|page|panel|placeholder|policy|post|posts|primary|rail|right|row|secondary|section|site|slot|small|stack|stories|story|sub|tags?|text|thread|title|toggle|top|unit|us|wrap|wrapper|\d+)"
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\dA-Za-z_]+")


def tells_furniture(names: str) -> str | None:
    """The telling word of a class, id or role list: of a name of which every part tells or says nothing."""
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        told = [p for p in parts if TELLING_NAMES.fullmatch(p)]
        if told and all(TELLING_NAMES.fullmatch(p) or PLAIN_NAMES.fullmatch(p) for p in parts):
            return told[0]
    return None


BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Start tags that end an open paragraph or a sibling of their own kind.
_ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "nav", "aside", "header", "footer", "form"}

_WHOLE = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
_STOP = re.compile("[>\"']")
_TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_COMMENT_END = re.compile(r"--!?>")
_NAMED = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

#: Labelled pages: what ``<main-text>`` holds is main text.  The weights come from them.
LABELLED = [
    '<html><head><title>t</title></head><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two words</a></li></ul></nav><div class="ad">Buy this now please.</div>'
    "<main-text><article><h1>The tide came in early</h1><p>Water rose <b>over</b> the stones, and the gulls left the shore.</p><p>By noon the beach was gone.<br>Nobody had seen it.</p></article></main-text>"
    "<footer>Site name and a line of words about the site.</footer></body></html>",
    '<body><header><h1>Site</h1><p>A slogan of the site</p></header><div id="content"><main-text><h2>How sand moves</h2><p>Sand moves with every wave that breaks, a little at a time.</p>'
    "<ul><li>Fine grains travel far</li><li>Coarse grains stay near</li></ul><blockquote>So it has always been on this coast.</blockquote><p>Storms move most of it.</p></main-text></div>"
    '<aside><h3>More</h3><ul><li><a href="x">Other page</a></li><li><a href="y">Next page</a></li></ul></aside><form><label>Your name</label><input><button>Send it</button></form>'
    '<div class="comments"><p>I liked this very much.</p><p>So did I, thank you.</p></div><footer><p>All rights reserved by us.</p><a href="z">Terms</a></footer></body>',
    '<body><div class="cookie-notice"><p>We use cookies on this site, do you agree?</p><button>Yes</button></div><div class="menu"><a href="1">Home</a> <a href="2">News</a> <a href="3">About</a></div>'
    '<main><main-text><h1>Cliffs</h1><div>The cliff is made of soft stone. <i>Rain</i> cuts it, and <a href="q">waves</a> take what falls.</div><p>It moves back a metre a year.</p>'
    "<table><tr><td>Year</td><td>Metres</td></tr></table><pre>as measured by hand</pre></main-text></main>"
    '<div class="sidebar"><h4>Popular</h4><p>Read these as well.</p><a href="u">A long link text here</a></div><div class="footer">Contact and imprint of the site</div></body>',
    '<body><div class="top"><a href="/">Start</a> | <a href="/m">Map</a></div><main-text><div><div>Water finds the cracks in the rock and freezes there.</div><div>In <b>spring</b> the rock falls.<br><br>'
    '<span>It takes the path with it, as it did the year before.</span></div></div></main-text><div id="footer"><span>Legal lines and <a href="/c">contact</a></span></div></body>',
    "<main-text>A few words without any markup at all.</main-text>",
    "<body><main><main-text><h1>What to bring</h1><ul><li>A coat</li><li>Two maps of the coast</li><li>Bread</li></ul><table><tr><th>Tide</th><th>Hour</th></tr><tr><td>High</td><td>Six</td></tr></table></main-text></main>"
    '<p>Written by the harbour office.</p><ul><li><a href="/1">Before</a></li><li><a href="/2">After</a></li></ul></body>',
    '<body><div id="page"><ul class="links"><li><a href="/">Home</a></li><li><a href="/old">Old pages</a></li></ul><main-text><p>The pier was built of oak, and it stood for a hundred years.</p><ol><li>The first storm took the rail</li>'
    "<li>The second took the planks</li></ol><p>What is left can be seen at low water.</p></main-text><p><a href='/a'>More on piers</a> <a href='/b'>More on storms</a></p></div></body>",
    '<body><article><main-text><h2>A walk</h2><dl><dt>Start</dt><dd>at the old lighthouse</dd><dt>End</dt><dd>where the road meets the sea</dd></dl><pre>north, then east</pre></main-text></article><div>Page one of nine</div></body>',
    '<body><table><tr><td><a href="/1">Index</a></td><td><a href="/2">Letters</a></td></tr></table><main-text><div>Letters from the coast, the third: we have had no rain since May, and the wells are low.</div><div>They say it will come with the moon.</div></main-text><hr><small>Set in type by hand.</small></body>',
    "<body><main-text><h1>Notes</h1><p>Stones sort by size along the beach.</p><h2>Why</h2><p>Large ones roll back with every wave, small ones stay.</p></main-text><address>Write to us at the museum.</address></body>",
    '<body><center><a href="/up">Up</a> <a href="/next">Next</a></center><main-text><p>Of the seven caves four can be entered.</p><p>The <a href="/cave">deepest</a> of them fills at every tide, so go with a guide.</p></main-text><center><a href="/up">Up</a> <a href="/next">Next</a></center></body>',
]


def _pieces(page: str):
    """(text run, None, False, "") and (None, tag name, is an end, attributes) in order, in one pass.

    What a script, style or the like holds is passed over with its tag.  A quote
    that never closes ends the reading of quotes up to its place, so no part of
    a page is read over and over.
    """
    at, size, lower = 0, len(page), page.lower()
    last = {q: page.rfind(q) for q in ">\"'"}
    unquoted = -1  # up to here quotes mean nothing
    missing: set[str] = set()  # end tags that don't occur any more
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            yield page[at:end], None, False, ""
            at = end
            continue
        m = _TAG_NAME.match(page, at + 1)
        if m is None:
            if page.startswith("<!--", at):
                short = next((k for k in (">", "->") if page.startswith(k, at + 4)), None)
                found = _COMMENT_END.search(page, at + 4) if short is None else None
                at = at + 4 + len(short) if short else found.end() if found else size
            elif page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            else:
                yield "<", None, False, ""
                at += 1
            continue
        place = m.end()
        while True:
            stop = _STOP.search(page, place) if place <= last[">"] else None
            if stop is None or stop[0] == ">":
                break
            if place <= unquoted:
                place = stop.end()
            elif stop.start() == last[stop[0]]:
                unquoted, place = stop.start(), m.end()
            else:
                place = page.index(stop[0], stop.end()) + 1
        if stop is None:  # a tag that is cut off ends at the next one
            end = page.find("<", m.end())
            at = size if end < 0 else end
            continue
        name, at = m[2].lower(), stop.end()
        yield None, name, m[1] == "/", page[m.end() : stop.start()]
        if name in _WHOLE and not m[1]:
            end = -1 if name in missing else lower.find(f"</{name}", at)
            if end < 0:
                missing.add(name)
                at = size
            else:
                close = page.find(">", end)
                at = size if close < 0 else close + 1


class _Reader:
    """Words and tags of a page, in order; each open element carries what its content inherits."""

    TELLING = {"a", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "pre", "article", "main", "dd", "dt", "label"}

    def __init__(self):
        #: (name, inside an article, furniture outside it, furniture inside it, silent, context, place of the nearest scope)
        self.open: list[tuple[str, bool, bool, bool, bool, str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.articles = 0

    def state(self) -> tuple[bool, bool, bool, bool, str, int]:
        return self.open[-1][1:] if self.open else (False, False, False, False, "plain", -1)

    def muted(self) -> bool:
        """Inside furniture that lies within an article: it is left out, but doesn't end the article."""
        _, outer, inner, _, _, _ = self.state()
        return inner and not outer

    def context(self) -> str:
        """The nearest telling ancestor of what comes next."""
        _, outer, inner, _, context, _ = self.state()
        return "furniture" if outer or inner else context

    def whole(self, page: str) -> list[tuple]:
        """All tokens; where a page has an article, each says whether it lies within one."""
        tokens = list(self.tokens(page))
        return [(k, ("in " if within else "out ") + v if k == "tag" and self.articles else v, ("in " if within else "out ") + m if k == "word" and m != "furniture" and self.articles else m, muted) for k, v, m, muted, within in tokens]

    def tokens(self, page: str):
        """("word", text run, context, muted) and ("tag", name, is an end, muted); contexts and tags within an article start with ``in ``."""
        for text, name, end, rest in _pieces(page):
            if name is None:
                if not self.state()[3]:
                    yield "word", text, self.context(), self.muted(), self.state()[0]
            elif end:
                muted, within = self.muted(), self.state()[0]
                if self.places.get(name):
                    self._cut(self.places[name][-1])
                yield "tag", name, True, muted, within
            else:
                if name in _WHOLE:
                    yield "tag", name, False, self.muted(), self.state()[0]
                    continue
                self._start(name, rest)
                yield "tag", name, False, self.muted(), self.state()[0]

    def _cut(self, size: int) -> None:
        while len(self.open) > size:
            self.places[self.open.pop()[0]].pop()

    def _start(self, name: str, rest: str) -> None:
        ended = (("p",) if name in _ENDS_P else (), _SIBLINGS.get(name, ()))
        for names in ended:
            at = max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)
            scope = self.state()[5]
            if at > scope or at == scope >= 0:
                self._cut(at)
        if name in VOID or rest.rstrip().endswith("/") and name not in BLOCKS:
            return
        inside, outer, inner, silent, context, scope = self.state()
        # A header within an article holds its title, a caption belongs to its figure.
        furniture = name in FURNITURE and not (inside and name in ("figcaption", "header"))
        if not furniture and "=" in rest and name not in ("html", "body", "article", "main", "a"):
            for v in _NAMED.findall(rest):
                found = tells_furniture(v[0] or v[1] or v[2])
                furniture |= found is not None and not (inside and found == "header")
        if name in self.TELLING and not (name == "a" and context in ("p", "heading", "blockquote", "article", "main")):
            context = "heading" if name[0] == "h" and name[1:].isdigit() else name
        inside = inside or name in ("article", "main") and not (outer or inner)
        self.articles += inside
        place = len(self.open)
        self.places.setdefault(name, []).append(place)
        self.open.append((name, inside, outer or furniture and not inside, inner or furniture and inside, silent or name in SILENT, context, place if name in _SCOPE else scope))


#: What a run of furniture outside an article costs at most: text on both sides of it stays together if each side has more.
FURNITURE_COST = 12.0


@lru_cache(maxsize=1)
def weights() -> tuple[dict[str, float], dict[str, float], float]:
    """(by word context, by tag, of other tags): smoothed log-odds over LABELLED."""
    words, tags = [Counter(), Counter()], [Counter(), Counter()]
    for page in LABELLED:
        inside = 0
        for kind, value, more, _ in _Reader().whole(page):
            if kind == "tag" and value.endswith("main-text"):
                inside = 0 if more else 1
            elif kind == "word":
                words[inside][more] += len(value.split())
            else:
                tags[inside][value] += 1
    scale = lambda c, k: math.log((c[1][k] + 0.5) / (c[0][k] + 0.5))
    by_context = {k: scale(words, k) for k in words[0] | words[1]}
    cost = {k: min(-0.1, scale(tags, k) - 1.0) for k in tags[0] | tags[1]}
    inner = {k: max(v, -0.5) if tags[1][k] > tags[0][k] else v for k, v in cost.items()}
    return by_context, inner, -0.5


def _value(kind: str, value: str, more, by_context: dict, by_tag: dict, other: float) -> float:
    if kind == "tag":
        return by_tag.get(value, -0.1 if value.startswith("in ") else other)
    default = by_context.get("plain", 0.1)
    if more.startswith("in "):
        default = max(default, 1.0)
    elif more.startswith("out "):
        default = -1.0
    return by_context.get(more, default) * len(value.split())


def _clean(runs: list[str]) -> str:
    return " ".join(entities.unescape("".join(runs)).split())


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    learned = weights()
    tokens = _Reader().whole(page)
    best, best_from, best_to = 0.0, 0, 0
    run, start, spent = 0.0, 0, 0.0
    for i, (kind, value, more, muted) in enumerate(tokens):
        if muted:
            continue
        gain = _value(kind, value, more, *learned)
        if kind == "word" and more == "furniture":
            gain = max(gain, -FURNITURE_COST - spent)  # of what the run of furniture may cost yet
            spent += gain
        elif kind == "word" and value.strip():
            spent = 0.0
        run += gain
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, best_from, best_to = run, start, i + 1
    at = best_from  # a heading right before the region belongs to it
    while best_to and at and (tokens[at - 1][0] == "tag" or tokens[at - 1][2].endswith("heading") or tokens[at - 1][3] or not tokens[at - 1][1].strip()):
        at -= 1
        if tokens[at][0] == "word" and tokens[at][1].strip() and not tokens[at][3]:
            best_from = at
    blocks: list[str] = []
    held: list[str] = []
    for kind, value, more, _ in tokens[best_from:best_to]:
        if kind == "word":
            if more != "furniture":
                held.append(value)
        else:
            name = value.removeprefix("in ").removeprefix("out ")
            if name == "br":
                held.append(" ")
            elif name in BLOCKS:
                blocks.append(_clean(held))
                held = []
    blocks.append(_clean(held))
    return "\n".join(b for b in blocks if b)


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Append ``main_text`` to every page.  A row's text depends on that row alone: no shuffle."""

    @F.arrow_udf("string")
    def text_of(values: pa.Array) -> pa.Array:
        return pa.array([extract(v) for v in values.to_pylist()], pa.string())

    return pages.withColumn("main_text", text_of(F.col(html).cast("string")))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = main_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
