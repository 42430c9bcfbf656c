"""HTML extraction as a maximum-scoring subsequence: words score positive, tags negative, one scan finds the best region.

A page is read as a sequence of tags and words. What stands around a word gives it features: the furniture elements it is in
(navigation, advert, notice, side bar, comments, footer, header, sharing, form, hidden; from element names, classes, ids and
roles), whether it is in an article or a container named as content, and whether it is in a link. Each feature, the plain word
and each tag has a weight, the logarithm of how much likelier it is inside the content of labelled pages than outside; a word's
score is the sum over its features. The contiguous run of tokens with the highest sum is the content
region; it is widened to whole blocks, and words in it whose own score is below 0 because of furniture are left out. Furniture
inside an article or a content container counts neither way, so that a long advert there does not cut the article in two.
Weights come from labelled_pages(), or from any (html, content flags) the caller gives.

Names of some families (side, notice, form, head) stand for parts of an article as often as for what surrounds it. Inside an
article or a content container such an element is weighed by what it holds: sentences, links, form controls, words of offers,
hardly any words. Each of these and each family has a weight, learned from the elements of the same labelled pages, in which such
names stand on both sides; at a sum above 0 the name says nothing. Names of navigation, adverts, comments, sharing and footers are
furniture everywhere: the labelled pages have them on one side only.

Where no name helps, a section's own heading does ("Comments", "Readers say", "Most read"), as a name of the element around it
would; and a short block of copyright is left out. A header named after the article (class "article-header") is content.

A hint says nothing where it can't be about a part of the page: in names such as "has-sidebar", "with-sidebar", "no-comments" or
"share-enabled", in names of more than three words, and on an element that holds half of the page's words and all its
articles, or three quarters of its words while no article or content container stands outside. Inside articles, ids of headings
are no hints, and those of sections only where they can't be topics.

Block elements end a block; white space in a block becomes one space; blocks are joined by a line feed. Text inside scripts,
styles, titles and the like is never text. Character references are decoded once, after tags are found.

A null, empty or tagless page works like any other: plain text is one block. A page without a word of content gives "". Pages of
any length are read whole, in time that grows with their length, in one pass over the pages, without a shuffle. Repeated pages
get equal texts. An empty table gives an empty result. Added columns replace those of the same name.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML and words that name parts of a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = {
    "nav": "nav", "menu": "nav", "footer": "foot", "header": "head", "aside": "side", "dialog": "notice", "form": "form", "button": "form", "select": "form",
    "datalist": "form", "search": "form", "label": "form", "fieldset": "form", "output": "form",
}
FURNITURE_WORDS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc topbar toolbar skip",
    "ad": "ad ads adv advert advertisement adverts advertising adbox banner sponsor sponsored promo promotion",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay",
    "side": "sidebar aside widget widgets related recommended recommendations complementary",
    "comments": "comment comments commentlist disqus respond reply replies discussion",
    "foot": "footer foot copyright contentinfo",
    "head": "header masthead",
    "share": "share sharing social follow",
    "form": "newsletter subscribe subscription signup login search searchbox form",
}
CONTENT_WORDS = frozenset("article content body post entry story main text".split())
#: Words of a name that tell a state or a layout, not what the element is.
STATE_WORDS = frozenset("has with without no not is enabled disabled open closed layout".split())
#: Hints that hold for single paragraphs, headings and phrases too, and those that hold inside an article.
CLEAR = frozenset(("ad", "share", "comments", "foot", "nav", "form"))
IN_ARTICLE = CLEAR | {"notice", "side"}
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 span a b i em strong small cite q code blockquote pre td th tr tbody li dd dt figure figcaption".split())
HEADED = frozenset("section h1 h2 h3 h4 h5 h6 p li dt dd td th".split())
#: Words that are topics of an article as well: as ids of sections they are no hints.
TOPICS = frozenset("discussion related recommended recommendations notice notices alert follow social reply replies form search overlay foot promotion".split())
#: Families that are weighed by what an element holds inside an article.
SOFT = frozenset(("side", "notice", "form", "head"))
#: Words that name the article itself: a header so named is its head.
ARTICLE_WORDS = frozenset("article post entry story".split())
# Headings of sections that are not the article, words of offers, and lines of copyright.
HEADINGS = {
    "comments": r"(?:\d+ |all |reader |readers' |user )?comments?(?: \(?\d+\)?)?|(?:our |what )?readers? (?:say|said|write)|leave a (?:reply|comment)|(?:\d+ )?(?:replies|responses)|join the (?:discussion|conversation)|your comments",
    "side": r"popular|most (?:read|popular|viewed|shared)|(?:popular|related|recommended|recent|latest|top) (?:posts?|stories|articles|news|reading)|related|recommended(?: for you)?|you (?:may|might) also like|more (?:stories|news|articles)|"
    r"more (?:from|in|on) [\w ]{1,30}|read (?:also|next|more)|trending(?: now)?|editor'?s picks",
    "share": r"share(?: this(?: [a-z]+)?)?|follow us|share on",
    "ad": r"advertisements?|sponsored(?: content| links)?|promoted",
    "form": r"(?:subscribe|newsletter|sign up|log ?in|search)(?: [a-z]+){0,3}",
}
OFFER = re.compile(r"\b(?:cookies?|subscrib\w+|newsletter|sign(?:ed)? up|log ?in|advertis\w+|sponsored|buy now|free trial|read (?:also|next)|see also|follow us|share this|click here|special offer)\b", re.I)
LEGAL = re.compile(r"\s*(?:©|\(c\) ?\d{4}|copyright (?:©|\(c\)|\d{4})|copyright by\b)|.*\ball rights reserved\b", re.I | re.S)
LEGAL_WORDS = 20
#: A piece of text of so many words, or that ends a sentence and has so many, is prose; an element with fewer words is short.
PROSE_WORDS, SENTENCE_WORDS, SHORT_WORDS = 12, 5, 6
_HEADING = {family: re.compile(rf"\s*(?:{pattern})\s*[:…]?\s*", re.I) for family, pattern in HEADINGS.items()}
_MAY_HEAD = frozenset("h1 h2 h3 h4 h5 h6 p strong b legend summary dt".split())
_SENTENCE_END = re.compile(r"[.!?…][\"'”’)]*\s*\Z")
_CONTROLS = frozenset("input button select textarea".split())
#: Shares of a page's words (those in links left out) from which an element is taken for the page.
MOST_OF_PAGE, HALF_OF_PAGE = 0.75, 0.5

_FEATURES = ("nav", "ad", "notice", "side", "comments", "foot", "head", "share", "form", "hidden", "article", "content", "link")
BIT = {name: 1 << k for k, name in enumerate(_FEATURES)}
_FAMILY = {word: family for family, words in FURNITURE_WORDS.items() for word in words.split()}
_INSIDE = BIT["article"] | BIT["content"]
_FURNITURE = BIT["article"] - 1
_SOFT = sum(BIT[f] for f in SOFT)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
#: End tags of these do not close elements around the nearest of those.
_INLINE = frozenset(("p", "a", "b", "i", "span", "li"))
_BARRIER = frozenset(("article", "nav", "footer", "main", "body", "form", "aside"))


@lru_cache(4096)
def _hints(name: str, attributes: str, in_article: bool) -> int:
    """Features that an element's own name and attributes give, as bits."""
    if name in ("html", "body"):
        return 0
    out = BIT["article"] if name in ("article", "main") else 0
    about_article = False
    family = FURNITURE_TAGS.get(name)
    if family and not (family == "head" and in_article):
        out |= BIT[family]
    if name == "main" or "=" not in attributes and "hidden" not in attributes:
        return out
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            if key == "id" and in_article and name in HEADED and (name != "section" or not TOPICS.isdisjoint(_SPLIT.split(value.lower()))):
                continue
            for label in value.split():
                words = [w for w in _SPLIT.split(_CAMEL.sub("-", label).lower()) if w and not w.isdigit()]
                if len(words) > 3 or not STATE_WORDS.isdisjoint(words):
                    continue
                about_article = about_article or not ARTICLE_WORDS.isdisjoint(words)
                found = {_FAMILY[w] for w in words if w in _FAMILY}
                allowed = (CLEAR if name in FLOW else IN_ARTICLE if in_article else BIT.keys()) if found else ()
                for f in found:
                    if f in allowed and not (f == "head" and in_article):
                        out |= BIT[f]
                if not found and words and words[-1] in CONTENT_WORDS and name not in FLOW:
                    out |= BIT["content"]
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDING.search(value):
            out |= BIT["hidden"]
    return out & ~BIT["head"] | BIT["content"] if about_article and out & BIT["head"] else out


class Element:
    """An element with hints: its features, the one around it, and what had been read when it began and ended: words outside links,
    articles, words in articles, words in links, words of prose, form controls, offers."""

    __slots__ = ("around", "began", "ended", "mask")

    def __init__(self, around: int, mask: int, began: tuple[int, ...]):
        self.around, self.mask, self.began, self.ended = around, mask, began, began

    def held(self) -> list[int]:
        return [b - a for a, b in zip(self.began, self.ended, strict=True)]

    def evidence(self) -> list[str]:
        """What an element of a soft family says for and against being part of an article."""
        words, _, _, linked, prose, controls, offers = self.held()
        every = max(words + linked, 1)
        told = {"links": linked > 0.4 * every, "prose": prose >= 0.5 * every, "controls": controls > 0, "offer": offers > 0, "short": words + linked < SHORT_WORDS}
        return [f"held:{k if on else 'no ' + k}" for k, on in told.items()] + [f"held:{f}" for f in SOFT if self.mask & BIT[f]]


class Token:
    """A tag (text "" or, for br, " ") or the text between two tags, with the innermost hinted element around it."""

    __slots__ = ("at", "block", "element", "kind", "legal", "linked", "text", "words")

    def __init__(self, kind: str, at: int, element: int, text: str = "", words: int = 0, linked: bool = False, block: bool = False):
        self.kind, self.at, self.element, self.text, self.words, self.linked, self.block, self.legal = kind, at, element, text, words, linked, block, False


def read(page: str) -> tuple[list[Token], list[Element]]:
    """Tokens in order, and the hinted elements (the first stands for the page itself).

    An element stays open up to its end tag or that of one around it. Open elements are counted by name, so that an end tag
    without a start costs nothing, however many there are.
    """
    tokens: list[Token] = []
    elements = [Element(0, 0, (0,) * 7)]
    stack: list[tuple[str, int]] = []  # name, hinted element that it is or 0
    places: dict[str, list[int]] = defaultdict(list)
    barriers: list[int] = []
    inner = [0]  # hinted elements open now
    read_words = read_articles = read_content = articles = link_words = prose_words = controls = offers = 0
    at, n = 0, len(page)

    def close(depth: int) -> None:
        nonlocal articles
        while len(stack) > depth:
            name, element = stack.pop()
            places[name].pop()
            if name in _BARRIER:
                barriers.pop()
            articles -= name in ("article", "main")
            if element:
                elements[element].ended = (read_words, read_articles, read_content, link_words, prose_words, controls, offers)
                inner.pop()

    def text(a: int, b: int) -> None:
        nonlocal read_words, read_content, link_words, prose_words, offers
        piece = entities.unescape(page[a:b])
        if piece:
            words, linked = len(piece.split()), bool(places["a"])
            if words <= 6 and not linked and len(stack) > 1 and stack[-1][0] in _MAY_HEAD and not stack[-1][1]:
                heads(piece)
            tokens.append(Token("word", a, inner[-1], piece, words, linked))
            tokens[-1].legal = 0 < words <= LEGAL_WORDS and LEGAL.match(piece) is not None
            if linked:
                link_words += words
            else:
                read_words += words
                if words >= PROSE_WORDS or words >= SENTENCE_WORDS and _SENTENCE_END.search(piece):
                    prose_words += words
                if elements[inner[-1]].mask & _INSIDE:
                    read_content += words
            if words and OFFER.search(piece):
                offers += 1

    def heads(piece: str) -> None:
        """Gives the element around a heading the features that its words name, unless it is the page or an article."""
        name, element = stack[-2]
        if name in ("html", "body", "article", "main"):
            return
        for family, pattern in _HEADING.items():
            if pattern.fullmatch(piece):
                if element:
                    elements[element].mask |= BIT[family]
                else:
                    stack[-2] = (name, len(elements))
                    inner.append(len(elements))
                    elements.append(Element(inner[-2], BIT[family], (read_words, read_articles, read_content, link_words, prose_words, controls, offers)))
                return

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            break
        if m.start() > at:
            text(at, m.start())
        began, at = at, m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        block = name in BLOCKS
        if m[1]:
            depths = places.get(name)
            if depths and not (name in _INLINE and barriers and barriers[-1] > depths[-1]):
                tokens.append(Token(name, began, inner[-1], block=block))
                close(depths[-1])
                continue
        else:
            top = stack[-1][0] if stack else ""
            if block and top == "p" or name == top and name in ("li", "tr", "td", "th", "option", "dt", "dd"):
                close(len(stack) - 1)
            if name == "a" and places["a"]:
                close(places["a"][-1])
            alone = m[3].rstrip().endswith("/")
            controls += name in _CONTROLS
            if name in RAW:
                if not alone:
                    end = _RAW_END[name].search(page, at)
                    at = end.end() if end else n
            elif name not in VOID and not alone:
                mask, element = (_hints if len(m[3]) < 1000 else _hints.__wrapped__)(name, m[3], articles > 0), 0  # long ones are not remembered
                if name in ("article", "main"):
                    articles += 1
                    read_articles += 1
                if mask:
                    element = len(elements)
                    elements.append(Element(inner[-1], mask, (read_words, read_articles - (name in ("article", "main")), read_content, link_words, prose_words, controls, offers)))
                    inner.append(element)
                if name in _BARRIER:
                    barriers.append(len(stack))
                places[name].append(len(stack))
                stack.append((name, element))
        tokens.append(Token(name, began, inner[-1], " " if name == "br" else "", block=block))
    if at < n:
        text(at, n)
    close(0)
    elements[0].ended = (read_words, read_articles, read_content, link_words, prose_words, controls, offers)
    return tokens, elements


def weighed(e: Element, around: int) -> bool:
    """Whether an element's names are weighed by what it holds: soft ones in an article or a content container."""
    return bool(e.mask & _SOFT) and not e.mask & _FURNITURE & ~_SOFT and bool(around & _INSIDE) and not around & _FURNITURE


def features(elements: list[Element], weights: dict[str, float]) -> list[int]:
    """The features of each hinted element, those of the elements around it included."""
    read_words, read_articles, read_content = elements[0].ended[:3]
    masks = [0]
    for e in elements[1:]:
        mask, around = e.mask, masks[e.around]
        if mask & _FURNITURE:
            words, held, content = e.held()[:3]
            outside = read_articles - held
            if held and not outside and words >= HALF_OF_PAGE * read_words and not mask & BIT["article"] or words >= MOST_OF_PAGE * read_words and not outside and read_content == content:
                mask &= ~_FURNITURE
            elif weighed(e, around) and sum(weights.get(x, 0.0) for x in e.evidence()) > 0:
                mask &= ~_SOFT
        masks.append(around | mask)
    return masks


def labelled_pages() -> Iterator[tuple[tuple[str, int], ...]]:
    """Labelled pages in some dozens of layouts: pieces of html, each with 1 (content) or 0."""
    wrappers = (
        ("<article>", "</article>"), ("<main>", "</main>"), ("<div class=post>", "</div>"), ("<div id=content>", "</div>"), ('<div class="entry-content">', "</div>"), ("<div>", "</div>"), ("<section>", "</section>"),
        ('<table><tr><td class="story">', "</td></tr></table>"),
    )
    bodies = (
        "<h1>Harbour works begin</h1><p>Work on the old harbour wall began on Monday, the town council said in a short statement to the paper.</p><p>It will take two years, and <a href=c>the plan</a> was shown to all who live there.</p>",
        "<h2>Bread without haste</h2><p>Mix the flour with water and leave it for a night.<br>In the morning <b>fold</b> it twice, wait, and bake it hot.</p><ul><li>five cups of flour</li><li>two cups of water</li></ul><p>That is all there is to it.</p>",
        "<p>The survey of the upper valley lists forty farms, of which nine were empty by the end of the war.</p><blockquote><p>Nobody stayed there.</p></blockquote><p>Most had two rooms and a barn; <a href=f>the register</a> names their owners.</p>",
    )
    links = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("News", "Sport", "Town", "Shop"))
    tops = (
        f"<header><a href=/>Home</a></header><nav><ul>{links}</ul></nav>", f'<div class="header">Valley Times</div><div class=menu><ul>{links}</ul></div>',
        '<div id=cookie-notice>We use cookies on this site <button>Accept</button></div><div><a href=x>Index</a> | <a href=y>About</a> | <a href=z>Contact</a></div>',
        f'<ul class="navbar">{links}</ul><div class=ad>Buy two pans today and save</div>',
    )
    tails = (
        "<aside><a href=d>More from the coast</a></aside><footer>Copyright <a href=e>Imprint</a></footer>",
        '<div class=comments><p>Lovely, thank you so much for this one</p><p>Mine did not work at all</p></div><form><label>Name</label><input><button>Send</button></form><div class=footer>All rights reserved</div>',
        '<div class="share-buttons">Share: <a href=i>Mail</a> <a href=j>Print</a></div><div class="related sidebar"><p>Ten walks for the summer</p></div><div hidden>Loading</div>',
        "<div><a href=g>Previous</a> <a href=h>Next</a></div><p class=copyright>All rights reserved by us</p>",
    )
    # Parts of articles whose names could be those of furniture, and furniture of the same names that stands in an article.
    parts = (
        '<section class="related-work"><h2>Earlier studies</h2><p>Two earlier surveys of the valley came to other numbers, as they counted barns as farms.</p></section>',
        '<div class="widget"><p>The table shows how many people lived in each house before the war.</p><p>None of them came back.</p></div>',
        '<div class="alert">Never leave the hot pan alone while the oil is on the fire, not even for a moment.</div>', "<aside><p>We had nothing but the walls and the land, said the last farmer of the valley.</p></aside>",
        "<fieldset><legend>Facts</legend><p>The wall is two miles long and was built in nine years.</p></fieldset>", '<div class="notice">The names of two people in this story have been changed at their own wish.</div>',
    )
    intruders = (
        f'<aside class="related"><h3>More stories</h3><ul>{links}</ul></aside>', '<div class="widget"><a href=k>Ten walks</a> <a href=l>Five lakes</a></div>', '<div class="notice">This site uses cookies. <a href=m>Accept</a></div>',
        '<aside>Subscribe to our newsletter and never miss a story again.</aside>', "<fieldset><label>Mail</label><input><button>Sign up</button></fieldset>", '<div class="alert">Subscribe now</div>',
        '<div class="sidebar"><p>Weather</p><p>Sunny, 21</p></div>', "<aside>Advertisement</aside>", '<form class="search"><label>Find</label><input><button>Go</button></form>', f'<div class="recommended">{links}</div>',
        '<div class="widget">Sign up now for our weekly letter, it is free for all who read us.</div>', '<div class="notice">We use cookies to make this site better for you and for our partners.</div>',
        "<aside>Read also how the old harbour was built.</aside>",
    )
    count = 0
    for k, (begin, end) in enumerate(wrappers):
        for j, top in enumerate(tops):
            body, tail = bodies[(k + j) % len(bodies)], tails[(k // 2 + j) % len(tails)]
            count += 1
            inside = begin not in ("<div>", "<section>") and "<td" not in begin  # where names are weighed
            part, intruder = (parts[count % len(parts)], intruders[count % len(intruders)]) if inside else ("", "")
            cut = body.index("</p>") + 4
            yield (f"<html><head><title>Page</title><style>p{{}}</style></head><body>{top}", 0), (begin + body[:cut] + part, 1), (intruder, 0), (body[cut:] + end, 1), (f"{tail}</body></html>", 0)


def learn_weights(pages: Iterable[tuple[tuple[str, int], ...]] | None = None) -> dict[str, float]:
    """Weights of the plain word ("word"), of each feature, of each tag ("tag:<name>") and of unknown tags ("tag", their mean).

    Furniture, links and tags are held below 0, the plain word and the two kinds of content container above it.
    """
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    totals, tag_totals, held_totals = [0, 0], [0, 0], [0, 0]
    held: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    ready = []
    for page in labelled_pages() if pages is None else pages:
        whole, edge, edges = "".join(p for p, _ in page), 0, []
        for piece, flag in page:
            edge += len(piece)
            edges.append((edge, flag))
        found, elements = read(whole)
        ready.append((found, elements, edges))
        # Which side the words of an element stand on, for elements that are weighed by what they hold.
        masks, sides = features(elements, {}), defaultdict(lambda: [0, 0])
        for t in found:
            if t.kind == "word":
                sides[t.element][next(flag for edge, flag in edges if t.at < edge)] += t.words
        for k, e in enumerate(elements):
            if k and weighed(e, masks[e.around]) and sum(sides[k]):
                side = int(sides[k][1] > sides[k][0])
                held_totals[side] += 1
                for x in e.evidence():
                    held[x][side] += 1
    evidence = {x: math.log((c[1] + 0.5) / (held_totals[1] + 1)) - math.log((c[0] + 0.5) / (held_totals[0] + 1)) for x, c in held.items()}
    for found, elements, edges in ready:
        masks = features(elements, evidence)
        for t in found:
            flag = next(flag for edge, flag in edges if t.at < edge)
            if t.kind != "word":
                counts[f"tag:{t.kind}"][flag] += 1
                tag_totals[flag] += 1
            else:
                mask = masks[t.element] | (BIT["link"] if t.linked else 0)
                totals[flag] += t.words
                for name in [f for f in _FEATURES if mask & BIT[f]] or ["word"]:
                    counts[name][flag] += t.words
    odds = lambda c, of: math.log((c[1] + 0.5) / (of[1] + 1)) - math.log((c[0] + 0.5) / (of[0] + 1))
    weights = {"word": max(0.5, odds(counts["word"], totals))}
    for f in _FEATURES:
        w = odds(counts[f], totals) if f in counts else 0.0
        weights[f] = max(0.0, w) if BIT[f] & _INSIDE else min(-0.5, w)
    tags: Counter = Counter({k: min(-0.05, odds(c, tag_totals)) for k, c in counts.items() if k.startswith("tag:")})
    return weights | evidence | dict(tags) | {"tag": min(-0.05, sum(tags.values()) / max(1, len(tags)))}


def scores(tokens: list[Token], masks: list[int], weights: dict[str, float]) -> tuple[list[float], list[bool]]:
    """Score of each token, and whether it stands in furniture: in an element whose words score below 0 without their links."""
    known: dict[int, tuple[float, float, bool]] = {}
    for mask in set(masks):
        total = weights["word"] + sum(weights[f] for f in _FEATURES if mask & BIT[f])
        # An article counts for what is furniture inside it no more than a plain page does.
        furniture = bool(mask & _FURNITURE) and weights["word"] + sum(weights[f] for f in _FEATURES if mask & BIT[f] & _FURNITURE) < 0
        hole = furniture and bool(mask & _INSIDE)
        known[mask] = (0.0 if hole else min(total, -0.5) if furniture else total, 0.0 if hole else 1.0, furniture)
    out, marked = [], []
    link, unknown = weights["link"], weights["tag"]
    for t in tokens:
        word, tag, furniture = known[masks[t.element]]
        legal = t.legal and not masks[t.element] & _INSIDE  # in an article such a line is its own
        marked.append(furniture or legal)
        if legal:
            out.append(min(-0.5, word) * t.words)
        elif t.kind == "word":
            out.append(t.words * (min(-0.05, weights["word"] + link) if t.linked and word > 0 else word))
        else:
            out.append(tag * weights.get(f"tag:{t.kind}", unknown))
    return out, marked


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and one past the last of the contiguous run with the highest sum; (0, 0) if none is above 0."""
    best, total, first, out = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, k
        total += s
        if total > best:
            best, out = total, (first, k + 1)
    return out


def extract_text(page: str | None, weights: dict[str, float]) -> str:
    """Main text of a page."""
    if not page:
        return ""
    found, elements = read(page)
    values, marked = scores(found, features(elements, weights), weights)
    a, b = best_run(values)
    if a == b:
        return ""
    while a > 0 and not found[a - 1].block:
        a -= 1
    while b < len(found) and not found[b].block:
        b += 1
    blocks, part = [], []
    for t, out in zip(found[a:b], marked[a:b], strict=True):
        if t.block:
            blocks.append("".join(part))
            part = []
        elif not out:
            part.append(t.text)
    blocks.append("".join(part))
    return "\n".join(x for x in (" ".join(p.split()) for p in blocks) if x)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """pages with the main text of html_col and n_chars (its code points)."""
    pages = pages.drop(*[c for c in (out, "n_chars") if c != html_col])
    place, held = pages.columns.index(html_col), weights or learn_weights()

    def kernel(batches):
        for batch in batches:
            texts = [extract_text(x, held) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*batch.schema.names, out, "n_chars"])

    return pages.mapInArrow(kernel, T.StructType([*pages.schema.fields, T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())]))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(pages.select("page_id", "url", F.col("html"))).drop("html")
