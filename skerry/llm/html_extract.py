"""Main text of web pages by tree scoring.

The page is parsed into a tree; menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are cut from it, by element and by the words of
class, id and role. Within an article or main element, and for paragraphs and headings, a mark
has to be the whole name (``comments-list``, not ``discussion-paper``) unless what it names is
links; ids of paragraphs and headings, and ids that repeat an element's heading, name places
and mark nothing. Elsewhere a part of a name is enough, but for what holds most of the page's
text. Every paragraph that is left passes points for its length and its commas to its parent,
half of them to the grandparent, a sixth one further up and two thirds of that with each step
from there, in one pass from the leaves; a container's points are
discounted by the share of its text that is in links. The best container is kept, raised to
the article or main element around it, with those of its siblings that are text: paragraphs,
headings, lists, tables and bare text of few links at any length, and other containers that
score well beside it. A form that wraps the page's text (an article, main element or several
paragraphs) is no form to cut; its controls are.

Blocks are joined in page order by one line feed; white space in a block becomes one space.

Defined results: null or empty html, or a page without text, gives an empty text; markup that
is never closed ends with the page; elements may be nested to any depth, and the time is linear
in a page's length; of containers with equal points the first stays; rows with null or repeated ids are extracted like any other; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

#: Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption summary address".split())
CUT = frozenset("nav header footer aside form script style noscript iframe button select textarea input dialog menu svg canvas object embed template title head audio video fieldset search noembed noframes".split())
#: Children of the best container's parent that are text by themselves.
TEXTUAL = PARAGRAPHS | frozenset("ul ol dl table figure hgroup a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: A share of text in links that is too much for a text beside the article.
LINKED = 0.25
FORM_PARAGRAPHS = 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening element closes: itself, up to the element that bounds it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Words of class, id and role that mark what isn't the article.
MARKS = frozenset(
    """ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices alert alerts alertdialog popup modal overlay newsletter subscribe subscription signup sidebar sidebars complementary menu menus
    nav navbar navigation breadcrumb breadcrumbs header masthead footer contentinfo comment comments disqus discussion replies
    reply respond share sharing social related recommended recommendations widget widgets login pagination pager toolbar search
    skip""".split()
)
#: Words that only say what shape or whose a marked box is: a name of marks and these is a mark as a whole.
SHAPES = frozenset(
    """area article bar block blog body bottom box btn button buttons center col column container content desktop entry float form group head
    icon icons inline inner item items layer left link links list main mobile module outer page panel post reader right row section site
    slot text the thread title top unit user wrap wrapper""".split()
)
#: Marks that are also headings of articles' sections.
HEADED = frozenset("advertising alert alerts banner consent cookie cookies discussion header menu menus navigation notice notices pagination promotion related recommended recommendations search sharing widget widgets".split())
_NOT_BEFORE = frozenset(("has", "no", "with", "without", "not"))
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_CLEAR = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


_SCOPED = frozenset().union(*(same | bound for same, bound in CLOSES.values()))


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "depth", "block", "scope", "letters", "link_letters", "paragraphs", "article", "given", "below", "far", "chars", "linked")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list = []
        #: The nearest block, itself included, and by name of a new element the open one that it would end.
        self.block: Node = self if parent is None or tag in BLOCKS else parent.block
        self.scope: dict[str, Node] = parent.scope if parent else {}
        if tag in _SCOPED:
            self.scope = {name: self if tag in same else self.scope.get(name) for name, (same, bound) in CLOSES.items() if tag not in bound}
        # Of the subtree as parsed: characters of text, those in links, p elements, whether an article or main element is in it.
        self.letters = self.link_letters = self.paragraphs = 0
        self.article = False
        # Points: for what lies in it, for what lies in its children, and from further below; the text's characters, those in links.
        self.given = self.below = self.far = 0.0
        self.chars = self.linked = 0


def _tag_end(text: str, at: int) -> int:
    """The place of the '>' that ends the tag begun before ``at``; quoted values may hold others."""
    quote_ok = True
    while True:
        end = text.find(">", at)
        if end < 0:
            return len(text)
        if quote_ok:
            m = _OPEN_QUOTE.search(text, at, end)
            if m:
                close = text.find(m[1], m.end())
                if close < 0:
                    quote_ok = False
                    continue
                at = close + 1
                continue
        return end


_OPEN_QUOTE = re.compile(r"""=\s*(["'])""")


def parse(text: str) -> Node:
    root = Node("#root")
    nodes: list[Node] = []
    opened: dict[str, list[Node]] = {}

    def leave(node: Node, to: Node) -> Node:
        """Close ``node`` and what it is in, up to ``to``; each element is left once."""
        while node is not to:
            opened[node.tag].pop()
            node = node.parent
        return to

    here, at, n = root, 0, len(text)
    lower = None
    no_comment_end = False
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            here.children.append(text[at:])
            break
        if lt > at:
            here.children.append(text[at:lt])
        after = text[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if text.startswith("<!--", lt) and not no_comment_end:
                end = text.find("-->", lt + 4)
                if end < 0:
                    no_comment_end = True
                    break  # a comment that is never closed ends with the page
                at = end + 3
            else:
                end = text.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        m = _NAME.match(text, lt + 1)
        if not m:
            here.children.append("<")
            at = lt + 1
            continue
        name = m[0].lower()
        end = _tag_end(text, m.end())
        attrs = text[m.end() : end]
        at = end + 1
        if name[0] == "/":
            here = leave(here, _after_end(here, name[1:], opened))
            continue
        here = leave(here, _parent_of(here, name))
        node = Node(name, attrs, here)
        nodes.append(node)
        here.children.append(node)
        if name in RAW:
            if lower is None:
                lower = text.lower() if len(text.lower()) == n else re.sub("[A-Z]+", lambda x: x[0].lower(), text)
            close = lower.find(f"</{name}", at)
            if close < 0:
                break
            node.children.append(text[at:close])
            gt = text.find(">", close)
            at = n if gt < 0 else gt + 1
        elif name not in VOID and not (attrs.endswith("/") and name in ("svg", "path")):
            here = node
            opened.setdefault(name, []).append(node)
    for node in [*reversed(nodes), root]:  # children before their parents
        if node.tag not in RAW:
            node.letters += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.link_letters = node.letters
        if up := node.parent:
            up.letters += node.letters
            up.link_letters += node.link_letters
            up.paragraphs += node.paragraphs + (node.tag == "p")
            up.article |= node.article or node.tag in ("article", "main")
    return root


def _parent_of(here: Node, name: str) -> Node:
    """The parent for a new element: an open p ends before a block, a list item before the next one."""
    if name in BLOCKS:
        block = here.block
        if block.tag == "p" or (block.tag in HEADINGS and name in HEADINGS):
            here = block.parent
    ended = here.scope.get(name)
    return ended.parent if ended else here


def _after_end(here: Node, name: str, opened: dict[str, list[Node]]) -> Node:
    """Where an end tag leads: out of the nearest open element of that name, unless something between holds it."""
    if not opened.get(name):
        return here
    found = opened[name][-1]
    if name not in BLOCKS and here.block.depth > found.depth:
        return here  # an inline end tag doesn't reach out of its block
    if name not in ("article", "main", "body", "html") and any(opened.get(t) and opened[t][-1].depth > found.depth for t in ("article", "main", "body")):
        return here
    return found.parent


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def _heading_words(node: Node) -> list[str]:
    first = next((c for c in node.children if not isinstance(c, str)), None)
    return _words(" ".join(t for _, t, _ in blocks_of(first))) if first is not None and first.tag in HEADINGS else []


def _marks(node: Node, key: str, words: list[str], inside: bool, page: Node) -> bool:
    """Whether a name's words mark an element as none of the article."""
    found = {w for k, w in enumerate(words) if w in MARKS and not (k and words[k - 1] in _NOT_BEFORE)}
    if inside:
        found.discard("header")  # an article's header is part of it
    if not found:
        return False
    small = node.tag in PARAGRAPHS
    whole = all(w in MARKS or w in SHAPES for w in words)
    if key == "id" and small:
        return False
    if key == "id" and inside and found <= HEADED and words == _heading_words(node):
        return False
    if whole:
        return True
    if inside or small:
        return node.link_letters > LINKED * node.letters
    return 2 * (node.letters - node.link_letters) <= page.letters - page.link_letters


def _is_cut(node: Node, inside: bool, page: Node) -> bool:
    """``inside``: whether an article or main element is around it; ``page``: the root."""
    if node.tag in CUT:
        return not (node.tag == "header" and inside) and not (node.tag == "form" and (node.article or node.paragraphs >= FORM_PARAGRAPHS))
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(node.attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _CLEAR.search(value)):
            return True
        if key in ("class", "id", "role") and any(_marks(node, key, _words(name), inside, page) for name in value.split()):
            return True
    return False


def _within(node: Node, tags: tuple) -> Node | None:
    """The nearest ancestor with one of the tags."""
    up = node.parent
    while up and up.tag not in tags:
        up = up.parent
    return up


def _prune(root: Node) -> None:
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not _is_cut(c, inside, root)]
        stack.extend((c, inside) for c in node.children if not isinstance(c, str))


def blocks_of(node: Node, skip: frozenset[int] = frozenset()) -> list[tuple[Node, str, int]]:
    """(block element, text, characters of it in links) of the subtree's runs of inline text, in page order; ``skip``: ids of elements to leave out."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((owner, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    # Iterative walk: (node, index of next child, block that owns the text, whether within a link).
    stack = [(node, iter(node.children), node, node.tag == "a")]
    while stack:
        here, rest, owner, link = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if here.tag in BLOCKS or here is node:
                flush(owner)
        elif isinstance(child, str):
            parts.append(child)
            linked += len(child) if link else 0
        elif id(child) in skip:
            flush(owner)
        elif child.tag == "br":
            parts.append(" ")
        elif child.tag == "hr":
            flush(owner)
        elif child.tag not in VOID:
            if child.tag in BLOCKS:
                flush(owner)
            stack.append((child, iter(child.children), child if child.tag in BLOCKS else owner, link or child.tag == "a"))
    return out


def _points(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def main_text(page: str | None) -> str:
    root = parse(page or "")
    _prune(root)
    paragraphs = blocks_of(root)
    if not paragraphs:
        return ""
    seen: list[Node] = []
    known: set[int] = set()
    for owner, text, linked in paragraphs:
        up = owner.parent if owner.tag in PARAGRAPHS and owner.parent else owner
        up.given += _points(text)
        up.chars += len(text)
        up.linked += linked
        while up and id(up) not in known:
            known.add(id(up))
            seen.append(up)
            up = up.parent
    value: dict[int, float] = {}
    for x in sorted(seen, key=lambda x: -x.depth):
        value[id(x)] = (x.given + x.below / 2 + x.far) * (1 - x.linked / x.chars)
        if up := x.parent:
            up.below += x.given
            up.far += x.below / 6 + x.far * 2 / 3
            up.chars += x.chars
            up.linked += x.linked
    best = max(seen, key=lambda x: value[id(x)])
    around = best if best.tag in ("article", "main") else _within(best, ("article", "main"))
    if around is None:
        while best.parent and best.parent.tag not in ("body", "html", "#root") and value.get(id(best.parent), 0) >= 0.75 * value[id(best)]:
            best = best.parent
        around = best
    parent = around.parent
    if parent is None or around.tag in ("body", "html"):
        return "\n".join(text for _, text, _ in blocks_of(around))
    least, dropped = 0.2 * value[id(around)], set()
    for x in parent.children:
        if isinstance(x, str) or x is around:
            continue
        if x.tag in TEXTUAL:
            found = blocks_of(x)
            good = sum(k for _, _, k in found) <= LINKED * sum(len(t) for _, t, _ in found)
        else:
            good = 0 < least <= value.get(id(x), 0)
        if not good:
            dropped.add(id(x))
    return "\n".join(text for _, text, _ in blocks_of(parent, frozenset(dropped)))


def _batches(batches):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    got = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(released(_batches), "page_id long, url string, text string")
    return got.withColumn("n_chars", F.char_length("text").cast("long"))
