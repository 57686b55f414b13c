"""Main text of web pages by scoring the containers of paragraphs."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from granary.llm.common import map_rows

#: Elements that never belong to the text, that have no content, and that end a block.
DROPPED = frozenset("script style noscript template head title svg canvas iframe object embed audio video map form button select option textarea input nav aside footer dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address header hr center details summary hgroup fieldset legend".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: What a start tag closes when it stands open (HTML lets these end tags out).
CLOSES_P = BLOCKS - {"html", "body"}
SIBLING = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}
#: Words of a class or id that name what is not the article. WEAK ones also stand on articles.
NOISE = "ad ads adsense banner cookie cookies consent gdpr notice notices popup modal newsletter newsletters signup sidebar sidebars nav navbar navigation breadcrumb breadcrumbs footer masthead siteheader pageheader menu menus pagination pager toolbar disclaimer copyright alert toc".split()
NOISE_STARTS = ("advert", "sponsor", "promo", "subscri", "recommend")
COMMENTS = "comment comments commentlist disqus respond replies reply".split()
WEAK = "related share sharing social tags widget widgets search login skip".split()
#: Words that turn a name into a state or a variant of the element that bears it (has-comments, share-enabled).
STATE_BEFORE = frozenset("no has have with without is show hide when not".split())
STATE_AFTER = frozenset("enabled disabled required visible hidden active open closed on off allowed free less layout template".split())
_KIND = dict.fromkeys(NOISE, 2) | dict.fromkeys(COMMENTS, 3) | dict.fromkeys(WEAK, 1)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"&#0*([0-9]{8,});?")
#: Scans for a tag's end beyond unclosed quotes, after which quotes are read as ordinary characters.
BROKEN_QUOTES = 16


class Node:
    """An element: what it holds, whether it is left out, and what its place tells (``block``: the nearest block around it)."""

    __slots__ = ("tag", "parent", "kids", "skip", "hint", "score", "chars", "linked", "commas", "block", "inside", "good", "found")

    def __init__(self, tag: str, parent: Node | None, hint: int = 0):
        self.tag, self.parent, self.kids, self.score, self.hint = tag, parent, [], 0.0, hint
        self.chars = self.linked = self.commas = self.good = self.found = 0
        self.block = self.inside = None
        if parent is not None:
            self.block = parent if parent.tag in BLOCKS or parent.parent is None else parent.block
            self.inside = parent.inside or parent.tag in ("article", "main")
        self.skip = tag in DROPPED or hint == 9 or (tag == "header" and not self.inside)


class _Open:
    """The open elements, with the places of each tag, so that the nearest one is found at once."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {}, []

    def push(self, x: Node) -> None:
        self.places.setdefault(x.tag, []).append(len(self.stack))
        if x.tag in BLOCKS or x.tag in DROPPED:
            self.blocks.append(len(self.stack))
        self.stack.append(x)

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.stack) > place:
            x = self.stack.pop()
            self.places[x.tag].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


def parse(page: str) -> Node:
    """A tree of elements and strings, with the end tags that HTML lets out put in, in one pass forward."""
    root = Node("#root", None)
    now = _Open(root)
    pos = text = broken = 0
    n = len(page)
    while (at := page.find("<", pos)) >= 0:
        after = page[at + 1 : at + 2]
        end_tag = after == "/"
        m = None if after in ("!", "?") else NAME.match(page, at + 1 + end_tag)
        if m is None and after not in ("!", "?"):
            pos = at + 1  # a lone < is text
            continue
        if at > text:
            now.stack[-1].kids.append(page[text:at])
        if m is None:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                pos = text = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                now.stack[-1].kids.append(page[at + 9 : n if end < 0 else end])
                pos = text = n if end < 0 else end + 3
            else:
                end = page.find(">", at)
                pos = text = n if end < 0 else end + 1
            continue
        end = -1
        if broken < BROKEN_QUOTES:
            got = QUOTED.match(page, m.end())
            end = got.end() if got else -1
            broken += got is None
        if end < 0:
            end = page.find(">", m.end()) + 1
        if end <= 0:
            pos = text = n  # a tag cut off by the end of the page is no text
            break
        attrs, pos, text = page[m.end() : end - 1], end, end
        tag = m[0].lower()
        if end_tag:
            place = now.last((tag,))
            if place and (tag in BLOCKS or tag in ("table", "html", "body") or place > now.last(("table", "td", "th"))):
                now.close(place)
            elif tag == "p":
                now.stack[-1].kids.append(Node("p", now.stack[-1]))
            continue
        if tag in CLOSES_P and now.blocks and now.stack[now.blocks[-1]].tag == "p":
            now.close(now.blocks[-1])
        if tag in SIBLING:
            shut, stop = SIBLING[tag]
            place = now.last(shut.split())
            if place > now.last(stop):
                now.close(place)
        node = Node(tag, now.stack[-1], _hint(tag, attrs) if "=" in attrs or " " in attrs else 0)
        node.parent.kids.append(node)
        if tag in RAW:
            got = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos)
            node.kids.append(page[pos : got.start() if got else n])
            end = page.find(">", got.end()) if got else -1
            pos = text = n if end < 0 else end + 1
        elif tag not in VOID and (not attrs.endswith("/") or tag in BLOCKS):
            now.push(node)
    if text < n:
        now.stack[-1].kids.append(page[text:])
    return root


def _hint(tag: str, attrs: str) -> int:
    """What class, id, role and visibility say: 9 never shown, 3 comments, 2 other noise, 1 perhaps noise, 0 nothing."""
    most = 0
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return 9
        if name == "role" and value.lower() in ROLES:
            return 9
        if name in ("class", "id") and tag not in ("html", "body", "main", "article"):
            for token in value.split():
                words = [w.lower() for w in WORDS.findall(token)]
                if not words or words[-1] in STATE_AFTER:
                    continue
                for k, w in enumerate(words):
                    if not k or words[k - 1] not in STATE_BEFORE:
                        most = max(most, _KIND.get(w, 0), _KIND.get(w + "".join(words[k + 1 : k + 2]), 0), 2 * w.startswith(NOISE_STARTS))
    return most


def _plain(x: Node) -> int:
    return x.chars - x.linked


def _reads_like_article(x: Node) -> bool:
    """Two blocks of 50 characters with few links, or one long text."""
    return x.good >= 2 or (x.good == 1 and _plain(x) >= 200)


def _leave_out(root: Node) -> None:
    """Decide which elements with a hint are left out: names are evidence, and the text decides.

    Perhaps noise: goes if it loses to the rest in plain text, or is mostly links. Noise: goes,
    unless it reads like an article, has few links, and the page without it has less than a third of its text and
    no other article or main element; then all such elements with a fifth of the greatest's text
    stay. Comments always go.
    """
    order = _measure(root)
    hinted = [x for x in order if x.hint]
    if not hinted:
        return
    inside, weak, strong = set(), [], []  # what is inside stronger noise goes or stays with it
    for x in order:
        if x.parent is not None and (id(x.parent) in inside or x.parent.hint >= 2):
            inside.add(id(x))
        elif x.hint:
            (strong if x.hint >= 2 else weak).append(x)
    rest = _plain(root) - sum(map(_plain, strong))
    gone, left = set(), rest
    for x in weak:
        x.skip = _density(x) >= 0.5 or 2 * _plain(x) <= rest
    for x in order:
        if x.parent is not None and id(x.parent) in gone:
            gone.add(id(x))
        elif x.skip:
            gone.add(id(x))
            left -= _plain(x)
    ids = {id(x) for x in strong}
    for x in order:
        x.found = x.good * (id(x) in ids)
    for x in reversed(order):
        if x.parent is not None:
            x.parent.found += x.found
    named = any(x.tag in ("article", "main") and id(x) not in inside and id(x) not in gone and x.good > x.found for x in order)
    like = [] if named else [x for x in strong if x.hint == 2 and _density(x) < 0.25 and _reads_like_article(x)]
    most = max(map(_plain, like), default=0)
    stay = {id(x) for x in like if most > 3 * left and 5 * _plain(x) >= most}
    for x in strong:
        x.skip = id(x) not in stay


def _measure(root: Node) -> list[Node]:
    """Characters, linked characters and commas below every kept node; nodes in page order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        x.score = 0.0
        x.chars = x.linked = x.commas = x.good = 0
        stack += [k for k in reversed(x.kids) if isinstance(k, Node) and not k.skip]
    for x in reversed(order):
        for k in x.kids:
            if isinstance(k, str):
                t = k.strip()
                x.chars += len(t)
                x.commas += t.count(",") + t.count("，") + t.count("、")
        if x.tag == "a":
            x.linked = x.chars
        x.good += x.tag in BLOCKS and _plain(x) >= 50 and _density(x) < 0.2 and _text_block(x)
        if x.parent is not None:
            up = x.parent
            up.good += x.good
            up.chars += x.chars
            up.linked += x.linked
            up.commas += x.commas
    return order


def _density(x: Node) -> float:
    return x.linked / x.chars if x.chars else 0.0


def _text_block(x: Node) -> bool:
    """A block that holds text itself, not only other blocks."""
    return any((isinstance(k, str) and not k.isspace() and k) or (isinstance(k, Node) and k.tag not in BLOCKS and not k.skip and k.chars) for k in x.kids)


def choose(root: Node) -> list[Node | str]:
    """The best container with all that belongs to it.

    Each text block gives 1 point, its commas and up to 3 points for its length to its parent,
    half of that to the grandparent and a quarter to the next; a container's points are
    discounted by its link density. Where the best container lies inside an article or main
    element, that element is it, with sibling articles of a fifth of its points. Otherwise
    an article may be spread over several containers: those with a fifth of the best points that
    read like an article are its parts, and their lowest common ancestor, or a higher one below
    body that has more such text, gives its children: the ones with parts, paragraphs and headings, what has
    text with few links, and what stands between; so do the ancestor's own siblings. Without further parts the ancestor is the
    best container, whose children are looked at where its text stands in containers in it.
    """
    _leave_out(root)
    order = _measure(root)
    for x in order:
        if x.tag in BLOCKS and x.tag not in ("html", "body") and x.chars and x.parent is not None and _text_block(x):
            points = (1 + x.commas + min(3.0, x.chars / 100)) * (1 - _density(x))
            up, share = x.block, 1.0
            while up is not None and share >= 0.25:
                up.score += points * share
                up, share = up.parent, share / 2
    best = max(order, key=lambda x: x.score * (1 - _density(x)), default=root)
    if best.score <= 0:
        return [root]
    least = 0.2 * best.score * (1 - _density(best))
    x = best
    while x is not None:
        if x.tag in ("article", "main"):
            best = x
            if x.tag == "article":
                break
        x = x.parent
    if best.parent is None or best.tag == "main":
        return [best]
    if best.tag == "article":
        return [k for k in best.parent.kids if k is best or (isinstance(k, Node) and not k.skip and k.tag == "article" and k.chars and _density(k) < 0.25 and k.score * (1 - _density(k)) >= least)]
    return _spread(order, best, least)


def _spread(order: list[Node], best: Node, least: float) -> list[Node | str]:
    """The children of the lowest element that holds ``best`` and all other parts of the article."""
    above = set()
    x = best
    while x is not None:
        above.add(id(x))
        x = x.parent
    below = {id(best)}
    for x in order:  # parents before children
        if x.parent is not None and id(x.parent) in below:
            below.add(id(x))
        x.found = int(id(x) not in above and id(x) not in below and x.score * (1 - _density(x)) >= least and _density(x) < 0.25 and _reads_like_article(x))
    total = sum(x.found for x in order)
    for x in reversed(order):
        if x.parent is not None:
            x.parent.found += x.found
    top = best
    while top.found < total:
        top = top.parent
    # below body, text with few links beside the article belongs to it, however short it is
    high = top
    while high.parent is not None and high.parent.tag not in ("body", "html") and high.parent.parent is not None:
        high = high.parent
    while top.good < high.good:
        top = top.parent
    parts = above
    if top is best:
        own = sum(k.good for k in best.kids if isinstance(k, Node) and not k.skip and k.tag in PARAGRAPHS)
        if best.tag not in ("body", "html") and 2 * own >= best.good:
            return _children(best.parent, above, least)
        parts = {id(k) for k in best.kids if isinstance(k, Node) and k.good and _density(k) < 0.25}  # its text is that of containers in it
    inside = _children(top, parts, least)
    if top.parent is None or top.tag in ("body", "html"):
        return inside
    return [y for k in _children(top.parent, above, least) for y in (inside if k is top else [k])]


def _children(top: Node, parts: set[int], least: float) -> list[Node | str]:
    """The children of ``top`` that belong to an article: its parts, what stands between them, and other text with few links."""
    must = [i for i, k in enumerate(top.kids) if isinstance(k, Node) and not k.skip and (k.found or id(k) in parts)]
    if not must:
        return [top]
    kept, run = [], []

    def end():
        # text that stands bare between elements, with the inline elements in it
        chars = sum(len(k.strip()) if isinstance(k, str) else k.chars for k in run)
        linked = sum(k.linked for k in run if isinstance(k, Node))
        if chars - linked >= 40 and linked < 0.25 * chars:
            kept.extend(run)
        run.clear()

    needed = set(must)
    for i, k in enumerate(top.kids):
        if isinstance(k, str) or (k.tag not in BLOCKS and not k.skip and i not in needed and not k.good):
            run.append(k)
            continue
        end()
        if k.skip or not k.chars:
            continue
        inner = must[0] < i < must[-1]
        own = k.tag in PARAGRAPHS or k.good or k.score * (1 - _density(k)) >= least
        if i in needed or (_density(k) < (0.5 if inner else 0.25) and (own or inner)):
            kept.append(k)
    end()
    return kept


def blocks(nodes: list[Node | str]) -> list[str]:
    """The texts of blocks in page order; white space is one space, character references are decoded."""
    out: list[str] = []
    now: list[str] = []

    def end():
        # a reference to a number of eight digits is no character; int() would refuse very long ones
        text = SPACE.sub(" ", html.unescape(DIGITS.sub("\ufffd", "".join(now)))).strip()
        if text:
            out.append(text)
        now.clear()

    stack: list = [x for x in reversed(nodes)]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br" or x.tag == "wbr":
            now.append(" " if x.tag == "br" else "")
        elif not x.skip:
            if x.tag in BLOCKS or x.tag == "#root":
                end()
                stack.append(None)
            stack += reversed(x.kids)
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n\n".join(blocks(choose(parse(page))))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every whole page; one row per input row.

    Null or empty html, and pages without text, give an empty text. Unclosed, stray and cut-off
    tags are handled as browsers do for the elements used here. Ids may be null or repeated.
    """

    def start():
        def step(cols):
            texts = [main_text(h) for h in cols["html"]]
            return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    rows = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", f"`{html_col}` AS html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return map_rows(rows, start, f"page_id {kind}, url string, text string, n_chars long", chunk=64)
