"""Main text of web pages: boosted trees score every block of the DOM, a tree decoder chooses.

Each block element is described by its subtree's density, its attribute tokens, its depth
and its siblings, and scored by gradient-boosted trees. The decoder then gives every block
one of three states, with the highest total score among the consistent ones: a *container*
gives no text itself and may hold anything; *content* gives its own text, and what is below
it is content or dropped; whatever lies below a *dropped* block is dropped. No choice below
a block can contradict the choice above it.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm.boosting import Boosted
from hopline.llm.bpe import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not page text.
SILENT = frozenset("script style head template svg iframe noscript select button textarea object canvas audio video map math datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "html body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "form fieldset figure figcaption blockquote pre address details summary center dialog hgroup menu caption legend".split()
)
#: Elements that an opening tag of the key closes, up to the next scope.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"},
}
SCOPE = frozenset("ul ol dl table body html div article section main nav aside header footer form td th".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section table ul li dd dt".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[a-z]+")

GOOD = frozenset("article content main body post entry text story page blog detail prose read".split())
BAD = {
    "nav": frozenset("nav menu navbar navigation breadcrumb breadcrumbs toolbar pagination pager tabs skip toc".split()),
    "edge": frozenset("header footer masthead topbar bottom copyright legal imprint head foot logo brand".split()),
    "side": frozenset("sidebar aside side widget related recommended more popular trending tags rail teaser".split()),
    "ad": frozenset("ad ads advert advertisement sponsor sponsored promo promotion banner adsense outbrain commercial".split()),
    "note": frozenset("notice cookie consent gdpr alert warning popup modal overlay toast disclaimer subscribe newsletter signup".split()),
    "talk": frozenset("comment comments reply replies discussion disqus respond feedback reader forum thread reviews".split()),
    "form": frozenset("form search login share social follow rating vote poll contact".split()),
}
TAGS = ("article", "main", "section", "div", "p", "heading", "list", "li", "nav", "aside", "header", "footer", "form", "table", "cell", "quote", "figure", "other")
_GROUP = {
    **{f"h{k}": "heading" for k in range(1, 7)}, **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"), **dict.fromkeys(("li", "dt", "dd"), "li"),
    **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr"), "table"), **dict.fromkeys(("td", "th"), "cell"), **dict.fromkeys(("blockquote", "pre"), "quote"),
    **dict.fromkeys(("figure", "figcaption"), "figure"), **dict.fromkeys(("form", "fieldset"), "form"),
}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset
    hidden: bool
    children: list[int] = field(default_factory=list)
    own: int = 0  # characters of text directly here or in inline elements
    linked: int = 0
    words: int = 0
    marks: int = 0  # sentence marks
    inputs: int = 0
    links: int = 0


@dataclass
class Page:
    """Block nodes in page order, and events: (block, text) or (-1, '') where a block or line ends."""

    nodes: list[Node]
    events: list[tuple[int, str]]


def _tokens(attributes: str) -> tuple[frozenset, bool]:
    names, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            names += NAME_PART.findall(value.lower())
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return frozenset(names), hidden


def parse(source: str) -> Page:
    """A tolerant reading: unknown, unclosed and crossed tags never fail."""
    nodes = [Node("html", -1, 0, frozenset(), False)]
    events: list[tuple[int, str]] = []
    # open elements: (tag, block index, whether text is silent, whether in a link)
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    at = 0

    def say(raw: str) -> None:
        _, block, silent, link = stack[-1]
        if silent or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if size := len(text.strip()):
            n = nodes[block]
            n.own += size
            n.words += text.count(" ") + 1
            n.marks += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            n.linked += size * link
        events.append((block, text))

    def close(to: int) -> None:
        if any(t in BLOCK for t, *_ in stack[to:]):
            events.append((-1, ""))
        del stack[to:]

    while m := TOKEN.search(source, at):
        say(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:-3]))
            continue
        tag = m[2].lower()
        if m[1]:  # closing
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("table", "td", "th") and tag not in ("table", "body", "html", "div", "article", "main", "section", "tr", "tbody"):
                    break
            if tag == "p" or tag == "br":
                events.append((-1, ""))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                events.append((-1, ""))
            elif tag == "input":
                nodes[stack[-1][1]].inputs += 1
            if tag == "hr" or tag not in CLOSES_P:
                continue
        if tag in ("html", "body") and any(t == tag for t, *_ in stack):
            continue
        if tag == "body":
            for k in range(1, len(stack)):
                if stack[k][0] == "head":
                    close(k)
                    break
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                    break
                if stack[k][0] in SCOPE and stack[k][0] not in ("td", "th"):
                    break
        _, block, silent, link = stack[-1]
        quiet = silent or tag in SILENT
        if tag in BLOCK:
            events.append((-1, ""))
            if not quiet:
                tokens, hidden = _tokens(m[3] or "")
                nodes.append(Node(tag, block, nodes[block].depth + 1, tokens, hidden))
                nodes[block].children.append(len(nodes) - 1)
                block = len(nodes) - 1
        elif tag == "a":
            nodes[block].links += 1
            link = True
        elif tag in ("select", "button", "textarea"):
            nodes[block].inputs += 1
        if not (m[3] or "").rstrip().endswith("/") or tag not in ("svg", "path"):
            stack.append((tag, block, quiet, link))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if tag not in SILENT:
                say(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
            stack.pop()
    say(source[at:])
    return Page(nodes, events)


def features(page: Page) -> np.ndarray:
    """One row per block: see ``FEATURES``."""
    nodes = page.nodes
    n = len(nodes)
    total = np.array([[x.own, x.linked, x.words, x.marks, x.inputs, x.links, 1] for x in nodes], float)
    for i in range(n - 1, 0, -1):
        total[nodes[i].parent] += total[i]
    before = np.concatenate(([0], np.cumsum([x.own for x in nodes])[:-1]))
    whole = max(total[0, 0], 1)
    places, alike = [0] * n, [1] * n  # of each block among its siblings, counted once per parent
    for x in nodes:
        tags = Counter(nodes[k].tag for k in x.children)
        for place, k in enumerate(x.children):
            places[k], alike[k] = place, tags[nodes[k].tag]
    out = np.zeros((n, len(FEATURES)))
    above: list[tuple] = []
    for i, x in enumerate(nodes):
        chars, linked, words, marks, inputs, links, blocks = total[i]
        up = nodes[x.parent] if x.parent >= 0 else x
        beside = len(up.children) if x.parent >= 0 else 1
        bad = [bool(x.tokens & b) for b in BAD.values()]
        inherited = above[x.parent] if x.parent >= 0 else (False,) * (len(BAD) + 4)
        flags = (
            *(a or b for a, b in zip(inherited, bad, strict=False)),
            inherited[-4] or x.tag in ("article", "main") or x.tag not in ("html", "body") and bool(x.tokens & GOOD),
            inherited[-3] or x.tag in ("nav", "footer", "aside"),
            inherited[-2] or x.tag in ("form", "header") and "article" not in up.tag,
            inherited[-1] or x.hidden,
        )
        above.append(flags)
        parent_chars = max(total[x.parent][0], 1) if x.parent >= 0 else whole
        sibling_chars = total[x.parent][0] - up.own if x.parent >= 0 else chars
        out[i] = [
            x.depth, len(x.children), beside, places[i] / max(beside - 1, 1), alike[i] / beside,
            chars, x.own, words, chars / whole, chars / parent_chars, chars / max(blocks, 1), chars / max(sibling_chars / beside, 1),
            linked / max(chars, 1), links / max(words, 1), marks / max(words, 1), words / max(marks + 1, 1), inputs, before[i] / whole,
            *flags, *bad, bool(x.tokens & GOOD), *(_GROUP.get(x.tag, x.tag) == t for t in TAGS[:-1]), *(_GROUP.get(up.tag, up.tag) == t for t in TAGS[:-1]),
        ]
    return out


FEATURES = (
    "depth", "children", "siblings", "place", "alike", "chars", "own", "words", "page_share", "parent_share", "density", "over_siblings",
    "link_share", "link_rate", "mark_rate", "sentence", "inputs", "before",
    *(f"in_{b}" for b in BAD), "in_good", "in_edge_tag", "in_form_tag", "in_hidden",
    *(f"is_{b}" for b in BAD), "is_good", *(f"tag_{t}" for t in TAGS[:-1]), *(f"up_{t}" for t in TAGS[:-1]),
)

CONTAINER, CONTENT, DROPPED = 0, 1, 2


def decode(page: Page, log_odds: np.ndarray) -> list[int]:
    """The best consistent states. Blocks without text of their own weigh little."""
    nodes = page.nodes
    weight = [1.0 if x.own else 0.25 for x in nodes]
    yes = [-np.logaddexp(0, -s) * w for s, w in zip(log_odds, weight, strict=True)]
    no = [-np.logaddexp(0, s) * w for s, w in zip(log_odds, weight, strict=True)]
    drop, content, container = list(no), list(yes), list(no)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        drop[p] += drop[i]
        content[p] += max(content[i], drop[i])
        container[p] += max(content[i], drop[i], container[i])
    states = [0] * len(nodes)
    for i, x in enumerate(nodes):
        above = CONTAINER if i == 0 else states[x.parent]
        if above == DROPPED:
            states[i] = DROPPED
        elif above == CONTENT:
            states[i] = CONTENT if content[i] >= drop[i] else DROPPED
        else:
            states[i] = max((CONTENT, DROPPED, CONTAINER), key=lambda s, i=i: (container[i], content[i], drop[i])[s])
    return states


def text_of_states(page: Page, states: list[int]) -> str:
    parts = [text if block >= 0 and states[block] == CONTENT else " " for block, text in page.events if block < 0 or states[block] == CONTENT]
    return " ".join("".join(parts).split())


# --- labelled pages -------------------------------------------------------------------


def _sentence(r: random.Random, least: int = 4, most: int = 16) -> str:
    words = ["".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(1, 9))) for _ in range(r.randint(least, most))]
    return " ".join(words).capitalize() + r.choice([".", ".", ".", "!", "?"])


def _prose(r: random.Random, least: int = 1, most: int = 6) -> str:
    out = " ".join(_sentence(r) for _ in range(r.randint(least, most)))
    if r.random() < 0.15:
        a, _, b = out.partition(" ")
        out = f'{a} <a href="/x">{_sentence(r, 1, 3)[:-1]}</a> {b}'
    return out if r.random() < 0.9 else f"<b>{out}</b>"


def _links(r: random.Random, least: int = 3, most: int = 9) -> str:
    items = [f'<a href="/{k}">{_sentence(r, 1, 4)[:-1]}</a>' for k in range(r.randint(least, most))]
    return r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<p>{x}</p>" for x in items)])()


def _attr(r: random.Random, names: str) -> str:
    name = r.choice(names.split())
    return r.choice([f' class="{name}"', f' id="{name}"', f' class="x-{name} w{r.randint(1, 9)}"', f' class="{name}-box"'])


def _noise(r: random.Random, where: str) -> str:
    """A block that is not main text; ``data-x`` marks it for the labels."""
    kinds = {
        "top": ["nav", "header", "notice", "ad", "search", "crumbs"],
        "in": ["ad", "share", "form", "related", "notice", "comments"],
        "bottom": ["footer", "comments", "related", "aside", "ad", "notice", "share", "form"],
    }[where]
    kind = r.choice(kinds)
    prose = lambda a, b: "".join(f"<p>{_prose(r, 1, 3)}</p>" for _ in range(r.randint(a, b)))
    made = {
        "nav": lambda: r.choice([f"<nav data-x>{_links(r)}</nav>", f"<div data-x{_attr(r, 'nav menu navbar navigation')}>{_links(r)}</div>"]),
        "header": lambda: r.choice([f"<header data-x><h1>{_sentence(r, 1, 4)}</h1>{_links(r)}</header>", f"<div data-x{_attr(r, 'header masthead top topbar')}><h2>{_sentence(r, 1, 4)}</h2><p>{_sentence(r)}</p></div>"]),
        "notice": lambda: f"<{(t := r.choice(['div', 'section', 'aside']))} data-x{_attr(r, 'cookie notice consent alert banner newsletter disclaimer')}>{prose(1, 2)}</{t}>",
        "ad": lambda: f"<{(t := r.choice(['div', 'aside', 'section']))} data-x{_attr(r, 'ad ads advert sponsor promo advertisement')}>{r.choice([_sentence(r), prose(1, 2), _links(r, 1, 3)])}</{t}>",
        "search": lambda: f'<form data-x{_attr(r, "search searchform")}><label>{_sentence(r, 1, 2)}</label><input name="q"><button>Go</button></form>',
        "crumbs": lambda: f"<div data-x{_attr(r, 'breadcrumb breadcrumbs')}>{' &gt; '.join(_sentence(r, 1, 2)[:-1] for _ in range(3))}</div>",
        "share": lambda: f"<div data-x{_attr(r, 'share social follow')}>{_links(r, 2, 5)}</div>",
        "form": lambda: f"<form data-x><p>{_sentence(r)}</p><label>{_sentence(r, 1, 3)}</label><input type=text><textarea>{_sentence(r)}</textarea><button>Send</button></form>",
        "related": lambda: f"<{(t := r.choice(['div', 'aside', 'section']))} data-x{_attr(r, 'related recommended more popular')}><h3>{_sentence(r, 1, 3)}</h3>{_links(r)}</{t}>",
        "comments": lambda: f"<{(t := r.choice(['div', 'section', 'ol']))} data-x{_attr(r, 'comments comment-list discussion responses replies')}>" + "".join(r.choice([f"<div class=comment><b>{_sentence(r, 1, 2)}</b><p>{_prose(r, 1, 4)}</p></div>", f"<li>{_prose(r, 1, 3)}</li>", f"<p>{_prose(r, 1, 4)}</p>"]) for _ in range(r.randint(1, 8))) + f"</{t}>",
        "footer": lambda: r.choice([f"<footer data-x>&copy; {_sentence(r)} &middot; {_sentence(r)}</footer>", f"<div data-x{_attr(r, 'footer copyright legal')}><p>{_prose(r, 1, 3)}</p>{_links(r, 1, 5)}</div>", f"<footer data-x>{prose(1, 2)}</footer>"]),
        "aside": lambda: r.choice([f"<aside data-x>{prose(1, 4)}{_links(r, 1, 4)}</aside>", f"<div data-x{_attr(r, 'sidebar side widget rail')}>{prose(1, 4)}</div>"]),
    }
    return made[kind]()


def _crowd(r: random.Random) -> str:
    """A long list of links or of comments, marked like other noise."""
    n = r.randint(65, 200)
    if r.random() < 0.5:
        links = [f'<a href="/{k}">{_sentence(r, 1, 4)[:-1]}</a>' for k in range(n)]
        t, (item, outer) = r.choice(["nav", "div"]), r.choice([("li", "ul"), ("p", "div"), ("div", "div")])
        inner = "".join(f"<{item}>{x}</{item}>" for x in links)
        return f"<{t} data-x{_attr(r, 'nav menu related tags popular')}><{outer}>{inner}</{outer}></{t}>"
    comment = r.choice([lambda: f"<div class=comment><p>{_prose(r, 1, 3)}</p></div>", lambda: f"<li>{_prose(r, 1, 3)}</li>", lambda: f"<p>{_prose(r, 1, 3)}</p>"])
    return f"<{(t := r.choice(['div', 'section', 'ol']))} data-x{_attr(r, 'comments comment-list discussion replies')}>{''.join(comment() for _ in range(n))}</{t}>"


def long_page(r: random.Random) -> str:
    """A labelled page in which some block has 65 children or more: its main part, noise or both."""
    kind = r.choice(["main", "noise", "both"])
    return labelled_page(r, r.randint(65, 200) if kind != "noise" else 0, _crowd(r) if kind != "main" else "")


def labelled_page(r: random.Random, items: int = 0, noise: str = "") -> str:
    """A page whose noise is marked ``data-x`` and whose main part is marked ``data-main``.

    The main part has ``items`` parts (0: a few); ``noise`` follows it.
    """
    body = [f"<h{(k := r.choice([1, 1, 2]))}>{_sentence(r, 2, 10)[:-1]}</h{k}>"] if r.random() < 0.8 else []
    for _ in range(items or r.choice([1, 2, 3, 5, 8, 14])):
        body.append(
            r.choices(
                [
                    lambda: f"<p>{_prose(r)}</p>", lambda: f"<p>{_prose(r)}", lambda: f"<p><b>{_prose(r)}<br>", lambda: f"<h2>{_sentence(r, 2, 6)[:-1]}</h2><p>{_prose(r)}</p>",
                    lambda: "<ul>" + "".join(f"<li>{_sentence(r)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", lambda: f"<blockquote>{_prose(r)}</blockquote>",
                    lambda: f"<pre>{_sentence(r)}\n{_sentence(r)}</pre>", lambda: f"<table><tr><td>{_sentence(r, 1, 3)}</td><td>{_sentence(r, 1, 3)}</td></tr></table>",
                    lambda: f"<div>{_prose(r)}</div>", lambda: f"<figure><img src=a><figcaption>{_sentence(r)}</figcaption></figure>",
                ],
                [12, 3, 1, 2, 1, 1, 1, 1, 2, 1],
            )[0]()
        )
    for _ in range(r.choice([0, 0, 0, 1, 2])):
        body.insert(r.randint(1, len(body)), _noise(r, "in"))
    inner = "".join(body)
    main = r.choice([
        lambda: f"<article data-main>{inner}</article>", lambda: f"<article data-main>{inner}</article>", lambda: f"<main data-main>{inner}</main>",
        lambda: f"<main><article data-main>{inner}</article></main>", lambda: f"<div data-main{_attr(r, 'content article post entry story main')}>{inner}</div>",
        lambda: f"<div data-main>{inner}</div>", lambda: f"<section data-main{_attr(r, 'content post article text')}>{inner}</section>",
    ])()
    if r.random() < 0.3:
        main = f"<div{_attr(r, 'wrapper container page row')}>{main}{_noise(r, 'bottom') if r.random() < 0.5 else ''}</div>"
    top = "".join(_noise(r, "top") for _ in range(r.randint(0, 3)))
    bottom = noise + "".join(_noise(r, "bottom") for _ in range(r.randint(0, 3)))
    end = r.choice(["</body></html>", ""])
    return f"<!DOCTYPE html><html><head><title>{_sentence(r)}</title><style>p{{a:b}}</style></head><body>{top}{main}{bottom}<script>var a='<p>';</script>{end}"


def _labels(source: str) -> tuple[Page, np.ndarray]:
    """Whether each block lies in the main part and outside all noise."""
    marked = re.sub(r"<(\w+) data-(x|main)", lambda m: f'<{m[1]} data-mark role="zz{m[2]}zz"', source)
    page = parse(marked)
    inside, noise = [], []
    for i, x in enumerate(page.nodes):
        up = x.parent if i else None
        inside.append("zzmainzz" in x.tokens or up is not None and inside[up])
        noise.append("zzxzz" in x.tokens or up is not None and noise[up])
        x.tokens = x.tokens - {"zzmainzz", "zzxzz"}
    return page, np.array([a and not b for a, b in zip(inside, noise, strict=True)], float)


def fit(pages: int = 500, trees: int = 50, seed: int = 5, long_pages: int = 30) -> Boosted:
    """Trees from generated pages of mixed layouts, ``long_pages`` of them beside ``pages``; some kilobytes."""
    r = random.Random(seed)
    made = [_labels(labelled_page(r)) for _ in range(pages)] + [_labels(long_page(r)) for _ in range(long_pages)]
    return Boosted.fit(np.concatenate([features(p) for p, _ in made]), np.concatenate([y for _, y in made]), trees)


def extract(sources: list[str | None], model: Boosted) -> list[str]:
    parsed = [parse(s or "") for s in sources]
    if not parsed:
        return []
    scores = model.log_odds(np.concatenate([features(p) for p in parsed]))
    ends = np.cumsum([0] + [len(p.nodes) for p in parsed])
    return [text_of_states(p, decode(p, scores[i:j])) for p, i, j in zip(parsed, ends, ends[1:], strict=False)]


def main_text(pages: DataFrame, model: Boosted | None = None, chars: int = 2_000_000) -> DataFrame:
    """One row (page_id, url, text) per page; pages are read whole, row by row, without a shuffle.

    Null, empty and textless html give the empty text. White space is collapsed
    across the page, blocks and line breaks part words. Repeated rows each give a
    row; other columns are not read. Without a model one is trained on the driver
    from generated pages and sent with the task.
    """
    trained = model or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("html").to_pylist()
            for i, j in slices([s or "" for s in sources], chars):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(i, j - i), batch.column("url").slice(i, j - i), pa.array(extract(sources[i:j], trained), pa.string())],
                    names=["page_id", "url", "text"],
                )

    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return given.mapInArrow(run, "page_id long, url string, text string")
