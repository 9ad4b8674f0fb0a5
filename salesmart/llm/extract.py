"""Main text of web pages by a tree-structured graphical model.

The nodes are the elements of the page, each content or not. Potentials of a node depend on
its tag, its class and id words, and its text; potentials of an edge tie a child to its
parent. Sum-product messages, up the tree and down again, give each element's probability of
being content. The weights are trained here, by gradient steps on the likelihood of labelled
pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from salesmart.llm.common import map_rows

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
HIDDEN = frozenset("head script style noscript iframe template select option button input textarea title annotation annotation-xml defs desc metadata canvas audio video map datalist".split())
MATH = frozenset("math semantics annotation annotation-xml mrow mi mo mn ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mstyle merror mpadded mphantom menclose mtable mtr mlabeledtr mtd maction".split())
SHAPES_DRAWN = frozenset("path rect circle ellipse line polyline polygon use stop".split())
VOID |= SHAPES_DRAWN
INLINE = MATH | SHAPES_DRAWN | {"svg", "g", "tspan"} | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Elements whose end tags close what is still open inside them.
SCOPES = frozenset("html body article aside div footer form header main nav section table td th ul ol dl blockquote figure".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    # Attributes. A quote opens a string only right after '=', and only if another closes it.
    r"(?P<rest>(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))?+)*+)"
    r"(?P<close>>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"[ \t\n\r\f\v\xa0  -     　\x85]+")
NAME_PART = re.compile(r"[a-z]+")


class Page(NamedTuple):
    """Elements in page order: tags, parents (-1 above the root), class and id words, and
    the runs of text between block borders as (element, text, linked characters)."""
    tags: list[str]
    parents: list[int]
    words: list[frozenset[str]]
    runs: list[tuple[int, str, int]]


def parse(source: str) -> Page:
    """Read a page leniently: open, unclosed and cut elements end where their parent does."""
    tags, parents, words = ["#page"], [-1], [frozenset()]
    runs: list[tuple[int, str, int]] = []
    open_elements = [0]
    parts: list[tuple[str, bool]] = []
    hidden = links = 0

    def holder() -> int:
        """The innermost open element that is not inline."""
        return next(e for e in reversed(open_elements) if tags[e] not in INLINE)

    def finish() -> None:
        nonlocal parts
        text = SPACE.sub(" ", html.unescape("".join(part for part, _ in parts))).strip(" ")
        if text:
            runs.append((holder(), text, sum(len(part) for part, linked in parts if linked)))
        parts = []

    def close(element_at: int) -> None:
        nonlocal hidden, links
        for element in open_elements[element_at:]:
            hidden -= tags[element] in HIDDEN
            links -= tags[element] == "a"
        del open_elements[element_at:]

    def text(part: str) -> None:
        if part and not hidden:
            parts.append((part, links > 0))

    at = 0
    while at < len(source):
        found = TOKEN.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at:found.start()])
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag or not found["close"]:
            continue
        if tag not in INLINE:
            finish()
        elif tag in ("br", "wbr"):
            text(" " if tag == "br" else "")
        if found["end"]:
            floor = 0
            if tag not in SCOPES:
                floor = max((i for i, e in enumerate(open_elements) if tags[e] in SCOPES), default=0)
            for i in range(len(open_elements) - 1, floor, -1):
                if tags[open_elements[i]] == tag:
                    close(i)
                    break
            continue
        if tag in CLOSES_PARAGRAPH:
            for i in range(len(open_elements) - 1, 0, -1):
                if tags[open_elements[i]] == "p":
                    close(i)
                    break
                if tags[open_elements[i]] in SCOPES:
                    break
        if tag in ENDS_SIBLING:
            ended, bound = ENDS_SIBLING[tag]
            for i in range(len(open_elements) - 1, 0, -1):
                if tags[open_elements[i]] in bound:
                    break
                if tags[open_elements[i]] in ended:
                    close(i)
                    break
        named = frozenset(
            part for name, value in ATTRIBUTE.findall(found["rest"])
            if name.lower() in ("class", "id", "role")
            for part in NAME_PART.findall(value.lower()))
        tags.append(tag)
        parents.append(holder() if tag not in INLINE else open_elements[-1])
        words.append(named)
        if tag in VOID or found["rest"].endswith("/") and tag not in INLINE | CLOSES_PARAGRAPH:
            continue
        open_elements.append(len(tags) - 1)
        hidden += tag in HIDDEN
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            stop = end.start() if end else len(source)
            text(source[at:stop])
            at = stop
    finish()
    return Page(tags, parents, words, runs)


# Words of class, id and role names, by what they say of an element.
CLUTTER = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related reply replies share sharing sidebar signup social sponsor sponsored subscribe tags toolbar tracking widget contentinfo complementary search dialog alert legal copyright reactions discussion".split())
CONTENT = frozenset("article body content entry main post story text".split())
TAGS = "#page html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th blockquote pre figure figcaption nav header footer aside form fieldset menu address details summary hr dialog".split()
_TAG_NUMBER = {tag: number for number, tag in enumerate(TAGS)}
SHAPES = ["other tag", "clutter name", "content name", "no text", "short text", "long text",
          "mostly links", "ends a sentence", "bias", "text where nothing is named as content"]
NODE_FEATURES = len(TAGS) + len(SHAPES)
#: An edge has one of four states, parent content or not by child content or not, and two
#: kinds: what stands on the page itself is tied less to it than what stands in a part of it.
EDGE_KINDS, EDGE_STATES = 2, 4
WHOLE_PAGE = frozenset(["#page", "html", "body"])


def edge_kinds(page: Page) -> list[int]:
    return [int(page.tags[max(parent, 0)] in WHOLE_PAGE) for parent in page.parents]


def node_features(page: Page) -> list[list[int]]:
    """The features of every element that is not inline; each has the value 1."""
    lengths, linked = [0] * len(page.tags), [0] * len(page.tags)
    sentences = [False] * len(page.tags)
    for element, text, links in page.runs:
        lengths[element] += len(text)
        linked[element] += links
        sentences[element] |= text[-1] in ".!?…。"
    first = len(TAGS)
    unnamed = not any(tag in ("article", "main") or words & CONTENT
                      for tag, words in zip(page.tags, page.words, strict=True))
    out = []
    for number, tag in enumerate(page.tags):
        found = [_TAG_NUMBER.get(tag, first), first + 8]
        if page.words[number] & CLUTTER:
            found.append(first + 1)
        elif page.words[number] & CONTENT:
            found.append(first + 2)
        length = lengths[number]
        found.append(first + (3 if not length else 4 if length < 80 else 5))
        if linked[number] * 2 > length:
            found.append(first + 6)
        if sentences[number]:
            found.append(first + 7)
        if unnamed and length:
            found.append(first + 9)
        out.append(found)
    return out


class Model(NamedTuple):
    nodes: np.ndarray
    edges: np.ndarray


def marginals(nodes: list[float], edges: np.ndarray, parents: list[int],
              kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on a tree: the probability of content of each element, and of each edge's
    four states. ``nodes`` are log odds, ``edges`` log potentials by kind and state; parents
    come first."""
    size = len(parents)
    potentials = np.exp(edges).tolist()
    own = np.exp(np.clip(nodes, -40, 40)).tolist()
    up0, up1 = [1.0] * size, own[:]  # what comes from below, with the element's own potential
    message0, message1 = [1.0] * size, [1.0] * size
    for number in range(size - 1, 0, -1):
        total = up0[number] + up1[number]
        x0, x1 = up0[number] / total, up1[number] / total
        up0[number], up1[number] = x0, x1
        aa, ab, ba, bb = potentials[kinds[number]]
        m0, m1 = aa * x0 + ab * x1, ba * x0 + bb * x1
        message0[number], message1[number] = m0, m1
        parent = parents[number]
        u0, u1 = up0[parent] * m0, up1[parent] * m1
        total = u0 + u1
        up0[parent], up1[parent] = u0 / total, u1 / total
    belief = np.empty(size)
    pairs = np.zeros((size, 4))
    b0, b1 = [0.0] * size, [0.0] * size
    for number in range(size):
        if number == 0:
            x0, x1 = up0[0], up1[0]
        else:
            parent = parents[number]
            aa, ab, ba, bb = potentials[kinds[number]]
            # What the parent knows without this child.
            p0, p1 = b0[parent] / message0[number], b1[parent] / message1[number]
            four = (p0 * aa * up0[number], p0 * ab * up1[number],
                    p1 * ba * up0[number], p1 * bb * up1[number])
            total = sum(four)
            pairs[number] = [value / total for value in four]
            x0, x1 = four[0] + four[2], four[1] + four[3]
        total = x0 + x1
        b0[number], b1[number] = x0 / total, x1 / total
        belief[number] = b1[number]
    return belief, pairs


def content(page: Page, model: Model) -> np.ndarray:
    """Each element's probability of being content; inline elements follow their parent."""
    scores = [float(model.nodes[found].sum()) if tag not in INLINE else 0.0
              for found, tag in zip(node_features(page), page.tags, strict=True)]
    return marginals(scores, model.edges, page.parents, edge_kinds(page))[0]


def extract(source: str | None, model: Model) -> str:
    """The runs of content, in page order, one to a line."""
    page = parse(source or "")
    if not page.runs:
        return ""
    likely = content(page, model)
    return "\n".join(text for element, text, _ in page.runs if likely[element] > 0.5)


def train(labelled: Iterable[tuple[str, frozenset[str]]], steps: int = 80, rate: float = 0.5,
          decay: float = 2e-3) -> Model:
    """Gradient ascent on the likelihood of labelled pages.

    A page comes with the ids of the elements that hold content; the elements inside are
    content too, unless their class says ``not``.
    """
    pages = []
    for source, ids in labelled:
        page = parse(source)
        truth = np.zeros(len(page.tags), int)
        for number in range(1, len(page.tags)):
            inside = truth[page.parents[number]] or bool(page.words[number] & ids)
            truth[number] = inside and "not" not in page.words[number]
        # The marks that carry the labels are no features.
        words = [found - ids - {"not"} for found in page.words]
        page = page._replace(words=words)
        states = np.zeros((len(page.tags), EDGE_STATES))
        states[np.arange(len(truth)), 2 * truth[page.parents] + truth] = 1
        states[0] = 0
        pages.append((page.parents, edge_kinds(page), node_features(page), truth, states))
    model = Model(np.zeros(NODE_FEATURES), np.zeros((EDGE_KINDS, EDGE_STATES)))
    squares = Model(np.full(NODE_FEATURES, 1e-6), np.full((EDGE_KINDS, EDGE_STATES), 1e-6))
    for _ in range(steps):
        node_slope, edge_slope = -decay * model.nodes, -decay * model.edges
        for parents, kinds, found, truth, states in pages:
            belief, pairs = marginals(
                [float(model.nodes[f].sum()) for f in found], model.edges, parents, kinds)
            for features, error in zip(found, truth - belief, strict=True):
                node_slope[features] += error / len(pages)
            np.add.at(edge_slope, kinds, (states - pairs) / len(pages))
        for values, slope, square in zip(model, (node_slope, edge_slope), squares, strict=True):
            square += slope * slope
            values += rate * slope / np.sqrt(square)
    return model


# Labelled pages: elements of class "yes" hold content, those of class "not" inside do not.
_TEXT = "Long ago the river changed its bed, and the people of the valley moved their houses up the hill."
_SHORT = "Then it rained."
_LINKS = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>Contact</a></li></ul>"
_STORY = f"<h1>The river</h1><p>{_TEXT}</p><p>{_SHORT}</p><h2>Later</h2><p>{_TEXT} {_TEXT}</p>"
_RICH = (f"<h1>Two hills</h1><p><b>{_SHORT}</b></p><ul><li>one stone</li><li>two stones</li></ul>"
         f"<blockquote><p>{_TEXT}</p></blockquote><table><tr><td>year</td><td>rain</td></tr></table>"
         f"<figure><figcaption>The hill</figcaption></figure><pre>{_SHORT}</pre><ol><li>{_TEXT}</li></ol>"
         "<h3>More</h3><h4>Yet more</h4><dl><dt>bed</dt><dd>where it flows</dd></dl><p>word</p>")
_COMMENTS = f"<div class='comments'><h3>Comments</h3><div class='comment'><p>{_TEXT}</p></div><ul><li><p>{_SHORT}</p></li></ul></div>"
_FORM = "<form><p>Sign up for our letter.</p><fieldset>Name <input></fieldset></form>"
LABELLED = [
    f"<body><nav>{_LINKS}</nav><div class='ad'>Buy a boat today.</div><article class='yes'>{_STORY}</article><footer>&copy; valley. {_TEXT}</footer></body>",
    f"<body><header><h1>The Valley</h1><nav>{_LINKS}</nav></header><main class='yes'><article>{_RICH}</article></main><aside><h2>Related</h2>{_LINKS}<p>{_TEXT}</p></aside><footer><p>{_TEXT}</p></footer></body>",
    f"<body><div class='header'><p>The Valley</p></div><div class='menu'>{_LINKS}</div><div class='content yes'>{_STORY}</div><div class='sidebar'><p>{_TEXT}</p>{_LINKS}</div><div class='footer'><p>{_TEXT}</p></div></body>",
    f"<body><div class='cookie'><p>We use cookies. {_TEXT}</p></div><article class='yes'><header><h1>The river</h1></header>{_STORY}<aside class='not'><p>{_TEXT}</p></aside>{_COMMENTS.replace(chr(39) + 'comments', chr(39) + 'not comments')}</article>{_FORM}</body>",
    f"<body><nav>{_LINKS}</nav><article class='yes'><h1>word</h1><p>{_SHORT}</p></article><div class='ad'>{_TEXT}</div><footer>{_SHORT}</footer></body>",
    f"<body><article class='yes'><section>{_RICH}</section><section><h2>End</h2><div><p>{_TEXT}</p></div></section><form class='not'><p>{_TEXT}</p></form><nav class='not'>{_LINKS}</nav><div class='not ad'>{_TEXT}</div><footer class='not'><p>{_SHORT}</p></footer></article>{_COMMENTS}</body>",
    f"<body><div class='page'><div class='post yes'>{_STORY}<div>{_TEXT}</div></div><section class='comments'><h2>Replies</h2><article><p>{_TEXT}</p></article></section></div><footer>{_LINKS}</footer></body>",
    f"<body><article class='yes'>{_TEXT}<p>{_SHORT}</p>{_TEXT}</article><nav>{_LINKS}</nav><dialog><p>{_TEXT}</p></dialog></body>",
    f"<body><h1>The Valley</h1><div class='banner'>{_TEXT}</div><main class='yes'>{_STORY}<p>word word</p></main><menu><li>Up</li></menu><address>{_SHORT}</address></body>",
    f"<body><nav>{_LINKS}</nav><footer>{_TEXT}</footer></body>",
    f"<body><article class='yes'><h1>x</h1><p><a href='/x'>a linked line</a></p><p>x</p><div>x</div><p>{_TEXT}</p></article><aside>{_SHORT}</aside></body>",
    f"<p class='yes'>{_SHORT}</p>",
    f"<body><nav>{_LINKS}</nav><h1 class='yes'>The river</h1><p class='yes'>{_TEXT}</p><p class='yes'>{_SHORT}</p><footer><p>{_SHORT}</p></footer></body>",
    f"<body><div class='yes'><h1>word</h1><p>{_SHORT}</p><p>{_TEXT}</p></div></body>",
    f"<body><p class='yes'>{_TEXT}</p><p class='yes'>{_TEXT} {_TEXT}</p></body>",
]
_KINDS = [("nav", ""), ("header", ""), ("aside", ""), ("form", ""), ("footer", ""), ("div", "ad"),
          ("div", "cookie notice"), ("div", "sidebar"), ("section", "comments"), ("div", "newsletter"),
          ("div", "share"), ("div", "menu")]
_INNER = [_SHORT, _TEXT, f"<p>{_SHORT}</p>", f"<h2>More</h2><p>{_TEXT}</p>{_LINKS}"]
_PIECES = [(tag, name, inner) for tag, name in _KINDS for inner in _INNER]
# Every kind of clutter inside an article and beside one, and beside text without an article.
for _tag, _name, _inner in _PIECES:
    _inside = f"<{_tag} class='not {_name}'>{_inner}</{_tag}>"
    _beside = f"<{_tag} class='{_name}'>{_inner}</{_tag}>"
    if _tag == "header":  # an article's own header may be part of it
        _inside = ""
    LABELLED += [
        f"<body>{_beside}<article class='yes'><h1>The river</h1><p>{_TEXT}</p>{_inside}<p>{_SHORT}</p><div><p>x</p></div></article>{_beside}</body>",
        f"<body>{_beside}<h1 class='yes'>The river</h1><p class='yes'>{_TEXT}</p><p class='yes'>{_SHORT}</p>{_beside}</body>",
    ]


@lru_cache(maxsize=1)
def default_model() -> Model:
    """Trained on LABELLED; the same weights wherever it is called."""
    return train((page, frozenset(["yes"])) for page in LABELLED)


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, main text and its length in code points for every row of ``pages``.

    Null or empty html, or a page without content, gives an empty text of length 0. Pages
    cut short end where they end; what a cut tag holds is markup. Repeated rows are read
    each; other columns are ignored.
    """
    model = model or default_model()

    def make():
        def work(rows):
            for page_id, url, source in rows:
                text = extract(source, model)
                yield page_id, url, text, len(text)
        return work

    return map_rows(pages.select("page_id", "url", "html"),
                    "page_id bigint, url string, text string, n_chars bigint", make)
