"""Main text of web pages by tree scoring.

A page is scanned once into a tree of block elements; inline markup only adds text to its block.
Paragraphs pass points for their length and commas to their ancestors (all to the parent, half to
the grandparent, less further up); a container's points are discounted by its link density.  The
best container is kept with what is prose beside it and beside its wrappers, and with the headings
and pieces in between.

Class and id words only cast suspicion on a block.  An id says nothing on a text block, nor where it
is the slug of the block's own heading; a suspect inside an article stays where it looks like a
section of it (``_stays``: a heading, prose, no form, few links, no list of similar blocks).  What
else is suspected must hold a share of the page's paragraph points to be kept (``KEEP_SHARE``).
Names inside code mark nothing.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never hold main text; fixed values.
DROPPED = frozenset("head script style noscript template nav footer aside form button input select textarea label iframe object embed svg canvas audio video menu dialog title".split())
#: Elements whose end tag alone ends them (their content is not markup).
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start a block of their own; all others are inline.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = frozenset("html p pre blockquote td th li dd dt figcaption caption summary div section article main body".split())
#: A start of these ends an open element of the second kind (optional end tags).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Words of class, id and role values that mark what is not the article; fixed values.
NEGATIVE = frozenset(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus dialog footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Of these, the words that leave no doubt in any name, and those that do as whole names; fixed values.
CERTAIN = frozenset("advert advertisement adverts comment comments consent cookie cookies disqus gdpr shoutbox".split())
CERTAIN_ALONE = frozenset("ad ads hidden replies respond".split())
#: Ids that platforms give to what readers wrote, whatever its heading; fixed values.
READERS = frozenset("comment comments disqus replies respond shoutbox".split())
#: Parts of a name that turn its meaning round, and whole names of article bodies; fixed values.
NEGATED = frozenset("has no not non with without free less is hide".split())
POSITIVE = frozenset("article articlebody body content entry main page post story text".split())
#: Parts of the names of page-level headers; fixed values.
SITE = frozenset("site page global top masthead".split())
#: How sure a mark is -> the share of the page's points that a block must exceed to be kept.
UNSURE, PART, WHOLE, SURE = 1, 2, 3, 4
KEEP_SHARE = {UNSURE: 0.2, PART: 0.5, WHOLE: 0.8, SURE: 1.0}
#: Deeper elements become siblings, as in browsers, so that climbing is bounded.
MAX_DEPTH = 512
_NEVER_NEGATIVE = frozenset("html body article main".split())
#: Elements whose ids are anchors into the text; inline elements that hold code.
ANCHORS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption table thead tbody tr td th dl dt dd caption summary details".split())
CODE = frozenset("code kbd samp".split())
#: Elements that readers fill in or press; textareas leave no node, as their content is not markup.
CONTROLS = frozenset("form button input select".split())

#: How a block of prose ends, however short; and how a notice that ends so begins.
_SENTENCE = re.compile(r"[.!?:;…。！？؟।][\"'”’»)\]]*\Z")
_NOTICE = re.compile(r"©|\(c\)|copyright\b", re.I)
#: Blocks of more characters are prose, however they end.
LONG_BLOCK = 80

#: Containers that are menus where most of their text is links and no prose or heading leads to them.
_LINK_LISTS = frozenset("ul ol dl table div section".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "mark", "id_mark", "name", "ident", "depth", "points", "chars", "link_chars", "share", "size", "linked", "prose", "paragraphs", "controls")

    def __init__(self, tag: str, parent: Node | None, drop: bool, marks: tuple[int, int, str, str] = (0, 0, "", "")):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.mark, self.id_mark, self.name, self.ident = marks
        self.size = self.linked = self.prose = self.paragraphs = self.controls = 0  # of the whole block
        self.depth = 0 if parent is None else parent.depth + 1
        self.children: list = []  # nodes and (text, in a link)
        self.points, self.chars, self.link_chars, self.share = 0.0, 0, 0, 0.0


def _name_mark(name: str) -> int:
    """How sure one class name, id or role is that its element is not the article."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
    bad = [x for x in parts if x in NEGATIVE]
    if not bad or not NEGATED.isdisjoint(parts):
        return 0
    if not CERTAIN.isdisjoint(bad):
        return SURE
    if len(bad) < len(parts):
        return PART
    return WHOLE if CERTAIN_ALONE.isdisjoint(bad) else SURE


def _marks(tag: str, attributes: str, open_: Counter, at: Node) -> tuple[int, int, str, str]:
    """How sure an element's class or role, and its id, are that it is not the article, and its class and id.

    SURE also if it isn't shown.
    """
    names: list[str] = []
    ident = kind = ""
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = value.strip("\"'").lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return SURE, 0, "", ""
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return SURE, 0, "", ""
        elif name == "id":
            ident = ident or value.strip()
        else:
            names += value.split()
            kind = kind or value.strip()
    everything = [*names, *ident.split()]
    if tag == "header" and not open_["article"] and not open_["main"]:
        at_top = at.tag in ("body", "html")
        return (SURE if at_top or any(not SITE.isdisjoint(re.split(r"[^a-z0-9]+", x)) for x in everything) else 0), 0, kind, ident
    if tag in _NEVER_NEGATIVE:
        return 0, 0, kind, ident
    mark = max((_name_mark(x) for x in names), default=0)
    by_id = 0 if tag in ANCHORS else max((_name_mark(x) for x in ident.split()), default=0)
    if not POSITIVE.isdisjoint(everything):
        mark, by_id = min(mark, UNSURE), min(by_id, UNSURE)
    return mark, by_id, kind, ident


def parse(page: str) -> Node:
    """The tree of block elements; unclosed and crossed tags are settled as browsers do."""
    root = Node("html", None, False)
    at, links, pos, n = root, 0, 0, len(page)
    open_ = Counter({"html": 1})  # open elements by tag: an end tag without a start costs nothing
    dropped_inline: list[tuple[str, int]] = []
    code = 0  # open inline elements that hold code

    def text(piece: str) -> None:
        if piece and not at.drop and not dropped_inline:
            at.children.append((piece, links > 0))

    def close(until: Node) -> None:
        """End the open elements up to and with ``until``, which isn't the root."""
        nonlocal at
        while at is not until:
            open_[at.tag] -= 1
            at = at.parent
        open_[at.tag] -= 1
        at = at.parent

    while pos < n:
        m = _MARKUP.search(page, pos)
        if m is None:
            text(entities.unescape(page[pos:]))
            break
        text(entities.unescape(page[pos : m.start()]))
        pos = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            if not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, pos)
                pos = end.end() if end else n
            continue
        if tag in BLOCKS:
            if closing:
                if open_[tag] > (tag == "html"):
                    up = at
                    while up.tag != tag:
                        up = up.parent
                    close(up)
                    links = code = 0
                    dropped_inline.clear()
                continue
            if at.tag == "p" or at.tag in HEADINGS and tag in HEADINGS:
                close(at)
                links = 0
            elif tag in CLOSES and any(open_[t] for t in CLOSES[tag]):
                scope = at
                while scope.parent is not None and scope.tag not in CLOSES[tag] and scope.tag not in SCOPES[tag]:
                    scope = scope.parent
                if scope.tag in CLOSES[tag]:
                    close(scope)
                    while at.tag in CLOSES[tag] and at.parent is not None:
                        close(at)
            if tag == "html" and at is root:
                continue
            if tag in VOID:
                at.children.append(Node(tag, at, True))
                continue
            if at.depth >= MAX_DEPTH:
                close(at)
            node = Node(tag, at, at.drop or tag in DROPPED, _marks(tag, m[3], open_, at))
            at.children.append(node)
            open_[tag] += 1
            at = node
        elif tag == "a":
            links = max(0, links - 1) if closing else links + 1
        elif tag == "br":
            text(" ")
        elif closing:
            if tag in CODE:
                code = max(0, code - 1)
            if dropped_inline and dropped_inline[-1][0] == tag:
                name, depth = dropped_inline.pop()
                if depth > 1:
                    dropped_inline.append((name, depth - 1))
        elif tag not in VOID and not m[3].endswith("/"):
            if tag in DROPPED:
                at.controls += tag in CONTROLS
            if dropped_inline:
                if dropped_inline[-1][0] == tag:
                    dropped_inline[-1] = (tag, dropped_inline[-1][1] + 1)
            elif tag in DROPPED or _inline_mark(tag, m[3], open_, at, code) >= WHOLE:
                dropped_inline.append((tag, 1))
            code += tag in CODE
        elif tag in CONTROLS:
            at.controls += 1
    _settle(root)
    return root


def _inline_mark(tag: str, attributes: str, open_: Counter, at: Node, code: int) -> int:
    mark, _, kind, ident = _marks(tag, attributes, open_, at)
    return 0 if (code or open_["pre"]) and (kind or ident) else mark


def _first_heading(node: Node) -> str:
    """The text of the heading that a block starts with, or nothing."""
    at = node
    while at is not None:
        for c in at.children:
            if isinstance(c, Node):
                if not c.drop and (c.size or c.tag in HEADINGS):
                    break
            elif c[0].strip():
                return ""
        else:
            return ""
        if c.tag in HEADINGS:
            return " ".join(_own_text(x)[0] for x in _walk(c)).strip()
        at = c
    return ""


def _is_slug(ident: str, heading: str) -> bool:
    """Whether an id is made from (some consecutive words of) a heading."""
    words = [x for x in re.split(r"\W+", heading.lower()) if x]
    slug = [x for x in re.split(r"[^\w]+|_", ident) if x]
    while slug and slug[-1].isdigit() and slug[-1] not in words:
        slug.pop()
    return bool(slug) and any(words[i : i + len(slug)] == slug for i in range(len(words) - len(slug) + 1))


def _similar_blocks(node: Node) -> bool:
    """Whether most of a block is a list of blocks of one kind: comments, teasers, cards."""
    at = node
    while True:
        inner = [c for c in at.children if isinstance(c, Node) and not c.drop and c.size and c.tag not in HEADINGS]
        most = max(inner, key=lambda c: c.size, default=None)
        if most is None or 2 * most.size <= at.size or most.tag in ANCHORS:
            break
        at = most
    kinds: Counter = Counter()
    sizes: Counter = Counter()
    for c in inner:
        if c.tag in ("div", "li", "article", "section") and (c.name or c.ident or c.tag in ("li", "article")):
            kind = (c.tag, c.name or re.sub(r"\d+", "0", c.ident) if c.name or any(x.isdigit() for x in c.ident) else "" if c.tag in ("li", "article") else c.ident)
            kinds[kind] += 1
            sizes[kind] += c.size
    return any(kinds[k] > 1 and 2 * sizes[k] > at.size for k in kinds)


def _is_clutter(node: Node) -> bool:
    """By its own measures: controls, many links, little prose, or a list of similar blocks."""
    return bool(node.controls) or 3 * node.linked > node.size or 2 * node.prose < node.size or _similar_blocks(node)


def _stays(node: Node, inside: bool) -> bool:
    """Whether a suspect is a section of the article by its own measures.

    A class that is nothing but a mark, and hidden blocks, never stay; an id does no harm where it
    is the slug of the heading, and in an article neither on a ``section`` nor as part of a longer
    name, if two paragraphs or more follow.
    """
    if node.mark >= WHOLE or node.ident in READERS or not (heading := _first_heading(node)) or _is_clutter(node):
        return False
    if not node.mark and _is_slug(node.ident, heading) and (inside or node.id_mark < SURE):
        return True
    return inside and node.paragraphs > 1 and (node.id_mark <= PART or not node.mark and node.tag == "section")


def _settle(root: Node) -> None:
    """Drop the suspected blocks that are no section of an article and don't hold their KEEP_SHARE of the page's paragraph points.

    Outside an article, a suspect is dropped as well where the page has one that is above suspicion.
    """
    nodes = _walk(root)
    for node in reversed(nodes):
        text, own, own_links = _own_text(node)
        node.size, node.linked = node.size + own, node.linked + own_links
        if text and node.tag not in HEADINGS and (_is_prose(text, own_links) or node.tag == "pre"):
            node.prose, node.paragraphs = node.prose + own, node.paragraphs + 1
        node.controls += sum(isinstance(c, Node) and c.tag in CONTROLS for c in node.children)
        if (up := node.parent) is not None:
            up.size, up.linked, up.controls = up.size + node.size, up.linked + node.linked, up.controls + node.controls
            up.prose, up.paragraphs = up.prose + node.prose, up.paragraphs + node.paragraphs
        if max(node.mark, node.id_mark) != SURE:
            node.share += _text_points(node, text, own, own_links)
            if node.parent is not None:
                node.parent.share += node.share
    articles = 0.0  # points of articles that nothing casts suspicion on
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    suspects = []
    while todo:
        node, inside, suspected = todo.pop()
        if node.drop:
            continue
        suspect = max(node.mark, node.id_mark) > 0 and not _stays(node, inside)
        if suspect:
            suspects.append((node, inside))
        if not inside and node.tag in ("article", "main"):
            inside, articles = True, articles + node.share * (not suspected)
        todo.extend((c, inside, suspected or suspect) for c in node.children if isinstance(c, Node))
    for node, inside in suspects:
        mark = max(node.mark, node.id_mark)
        holds = node.share if mark != SURE else 0.0
        elsewhere = 0.0 if inside else articles
        if holds <= KEEP_SHARE[mark] * root.share or elsewhere > (holds if mark == UNSURE else 0):
            for x in _walk(node):
                x.drop = True


def _walk(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.drop:
            out.append(node)
            todo.extend(c for c in node.children if isinstance(c, Node))
    return out


def _own_text(node: Node) -> tuple[str, int, int]:
    """The element's own text, its characters, and how many of them are in links."""
    own = [c for c in node.children if not isinstance(c, Node)]
    text = _SPACE.sub(" ", "".join(t for t, _ in own)).strip()
    linked = sum(len(t.strip()) for t, link in own if link)
    return text, len(text), min(linked, len(text))


def _text_points(node: Node, text: str, own: int, own_links: int) -> float:
    """Points of an element's own text: length and commas; none for links and for other elements."""
    if not own or node.tag not in TEXT_BLOCKS or own_links * 2 > own:
        return 0.0
    return min(1.0, own / 25) + text.count(",") + text.count("，") + text.count("、") + min(own / 100, 3.0)


def score(root: Node) -> Node | None:
    """Pass points up the tree; the container with the most (of equals the first on the page), or None."""
    nodes = _walk(root)
    for node in reversed(nodes):
        text, own, own_links = _own_text(node)
        node.chars += own
        node.link_chars += own_links
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
        if points := _text_points(node, text, own, own_links):
            up, level = (node.parent if node.tag not in ("div", "section", "article", "main", "body", "html") else node), 1
            while up is not None and level <= 6:
                up.points += points if level == 1 else points / 2 if level == 2 else points / (3 * level)
                up, level = up.parent, level + 1
        elif own and node.tag in HEADINGS and node.parent is not None:
            node.parent.points += 0.1
    best, most = None, 0.0
    for node in nodes:
        value = node.points * (1 - node.link_chars / node.chars) if node.chars else 0.0
        if value > most:
            best, most = node, value
    if best is None:
        return None
    # wrappers around several equal parts: an article that holds the best container wins over it
    up = best.parent
    while up is not None:
        if up.tag == "article" and not up.drop:
            best = up
        up = up.parent
    return best


def _blocks(top: Node) -> list[str]:
    """Text blocks below ``top`` in page order (cells of a row are one block).

    A list of links stays where a heading (not the page's first), a colon or, after prose, a short
    block that is no mark itself leads to it, or where it stands between other blocks; one that
    starts or ends the article is a menu.
    """
    if top.drop:
        return []
    found: list[tuple[str, str, int]] = []  # text, tag, number of the list of links around it

    def flush(held: list[str], node: Node) -> None:
        if text := _SPACE.sub(" ", "".join(held)).strip():
            found.append((text, node.tag, listed))
        held.clear()

    stack, listed, lists, outer = [(top, iter(top.children), [])], 0, 0, None
    while stack:
        node, rest, held = stack[-1]
        c = next(rest, None)
        if c is None:
            stack.pop()
            if node.tag in ("td", "th") and stack and stack[-1][2] is held:
                held.append(" ")
            else:
                flush(held, node)
            if node is outer:
                listed, outer = 0, None
        elif not isinstance(c, Node):
            held.append(c[0])
        elif c.drop:
            flush(held, node)
        elif node.tag == "tr" and c.tag in ("td", "th"):
            held.append(" ")
            stack.append((c, iter(c.children), held))
        else:
            flush(held, node)
            if not listed and c.tag in _LINK_LISTS and c.chars and c.link_chars * 2 > c.chars:
                lists += 1
                listed, outer = lists, c
            stack.append((c, iter(c.children), []))
    last = max((i for i, x in enumerate(found) if not x[2]), default=-1)
    out: list[str] = []
    before, begun, stays = ("", ""), False, {0: True}
    for i, (text, tag, group) in enumerate(found):
        if group not in stays:
            led = before[1] in HEADINGS - {"h1"} or before[0].endswith((":", "：")) or begun and _leads(before[0])
            stays[group] = led or begun and i < last
        if stays[group]:
            out.append(text)
            before, begun = (text, tag), begun or tag not in HEADINGS
    return out


def _leads(text: str) -> bool:
    """Whether a block is a short label, not of a menu."""
    first = re.split(r"\W+", text.lower().strip(), maxsplit=1)[0]
    return len(text) <= LONG_BLOCK and not _SENTENCE.search(text) and first not in NEGATIVE


def _is_prose(text: str, links: int) -> bool:
    return links * 2 <= len(text) and (len(text) > LONG_BLOCK or bool(_SENTENCE.search(text))) and not _NOTICE.match(text)


def _has_prose(node: Node) -> bool:
    """Whether a node that is not mostly links holds a block of prose."""
    if node.drop or not node.chars or node.link_chars * 2 > node.chars:
        return False
    return any(n.tag not in HEADINGS and _is_prose(text, links) for n in _walk(node) for text, _, links in [_own_text(n)] if text)


def _keep_level(parent: Node, at: Node) -> None:
    """Leave in ``parent`` only ``at``, prose beside it, and what stands between or heads them."""
    runs: list[list] = []  # single nodes, and runs of the parent's own text
    for c in parent.children:
        if not isinstance(c, Node) and runs and not isinstance(runs[-1][0], Node):
            runs[-1].append(c)
        else:
            runs.append([c])

    def prose(run: list) -> bool:
        if isinstance(run[0], Node):
            return run[0] is at or run[0].tag == "p" and bool(run[0].chars) and run[0].link_chars * 4 < run[0].chars or _has_prose(run[0])
        text = _SPACE.sub(" ", "".join(t for t, _ in run)).strip()
        return bool(text) and _is_prose(text, sum(len(t.strip()) for t, link in run if link))

    good = [prose(r) for r in runs]
    first, last = good.index(True), len(good) - 1 - good[::-1].index(True)
    kept = []
    for i, run in enumerate(runs):
        node = run[0] if isinstance(run[0], Node) else None
        heads = node is not None and node.tag in HEADINGS | {"hgroup", "header"} and (i > first or node.link_chars * 2 <= node.chars)
        between = first < i < last and (node is None or node.link_chars * 2 <= node.chars)
        if good[i] or i < last and heads or between:
            kept += run
    parent.children = kept
    at.link_chars = 0  # the links beside it are gone; it is no list of links


def _widen(best: Node) -> Node:
    """The topmost wrapper of the article, with all that is not the article taken out."""
    at = best
    while at.parent is not None and at.tag not in ("body", "html", "main"):
        up = at.parent
        if up.tag != "main" or at.tag == "article":
            _keep_level(up, at)
        else:
            at.link_chars = 0
        if at.tag == "article":
            return up
        at = up
    return at


def main_text(page: str | None) -> str:
    """The article of a page: blocks joined by blank lines, white space inside a block as one space."""
    if not page:
        return ""
    root = parse(page)
    best = score(root)
    if best is None:
        return ""
    return "\n\n".join(_blocks(_widen(best)))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per page, from its whole html.

    A null or empty html, or one without text, gives an empty text.  Pages are handled row by row,
    so one long page costs its own length only, however broken its markup.  Of containers with equal
    points the first on the page is the article.  Repeated rows stay, other columns don't; an empty
    table gives none.
    """

    def scan(batches):
        for batch in batches:
            ids, urls, pages_ = batch.columns
            texts = [main_text(h.as_py()) for h in pages_]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return cols.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
