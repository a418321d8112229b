"""Main text of web pages, with site templates found by counting element subtrees per host.

Every page's elements are hashed with all they hold; link targets, numbers and the words of link lists are masked, so
that a menu with another entry marked, a count or a date is still the same subtree. Spark counts the hashes per host.
A subtree on many pages of a host belongs to the site and is deleted from all its pages, unless it is prose of an
article: an article may quote the same passage as others. Parts that the markup names as menu, header, footer, sidebar,
notice, advert or reader comment may say something else on each page, so their places (path of names and classes) are
counted as well, and a place on many pages is deleted whatever it says. On a host that shows templates the counts
decide, and what is left is the text; only what no browser shows as text, and forms, go without a count. A host with few
pages shows no templates: there the markup's names decide, and the article, or the page if none is marked, is the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import bounded_batches, materialise

#: A template stands on this many pages of its host at least, and on the square root of their number.
LEAST_PAGES = 5
#: A list of links whose words are masked stands on this share of them at least.
LIST_SHARE = 0.5
#: Links of such a list, and the share of its characters inside them, at least.
LIST_LINKS, LINK_SHARE = 3, 0.8
#: Bits that tell the contents of the pages apart on which a subtree stands, and how many must be told, at most.
CONTENT_BITS, CONTENTS = 64, 24
# Element names of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp noembed noframes".split())
ESCAPABLE = set("title textarea".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
PROSE = set("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var".split())
WHOLE = ("html", "body", "article", "main")
NEVER = set(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input math menu nav noframes noscript "
    "object option script search select style svg template textarea title video".split()
)
# Of these, parts that show text and go by count where the host has templates
LANDMARKS = set("aside dialog footer menu nav".split())
#: An opening tag ends an open element of the named kinds.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
# Words of class and id that name what is not the article
SIDE = set(
    "ad ads advert advertisement adverts advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice "
    "notification overlay pager pagination popup promo promoted recommended related respond responses replies sharing "
    "share sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget widgets".split()
)
# Words that stand beside those in such names
FURNITURE = set(
    "area bar block body bottom box button buttons center col column container content fixed form global group header icon icons "
    "inner item items left link links list main outer page panel post posts primary right row secondary section site slot "
    "sticky tabs title top unit wrap wrapper".split()
)
SIDE_ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MAIN_NAMES = set("article articlebody content entry main maincontent post postbody story text".split())

#: What follows a tag's name up to its end: quotes count after "=" only, and only where they are closed.
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
TAG_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))?+)?+""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SPACE, NUMBER = re.compile(r"\s+"), re.compile(r"\d+")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for name in RAW | ESCAPABLE}


class Element:
    __slots__ = ("name", "attributes", "children", "parent", "hash", "shape", "chars", "linked", "links", "own", "wraps")

    def __init__(self, name, attributes, parent):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Element | str] = []
        self.wraps: bool | None = None


class _Open:
    """The open elements, with the depths at which each name, and anything but inline elements, stand."""

    def __init__(self, root: Element):
        self.stack, self.depths, self.hard = [root], {}, [0]

    def push(self, node: Element) -> None:
        self.depths.setdefault(node.name, []).append(len(self.stack))
        if node.name not in INLINE:
            self.hard.append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        """Close the element at a depth with all inside it."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.depths[node.name].pop()
            if node.name not in INLINE:
                self.hard.pop()

    def end(self, name: str) -> None:
        """An end tag: skipped if nothing of the name is open, or, for an inline element, only outside the block."""
        at = self.depths.get(name)
        if at and (name not in INLINE or at[-1] > self.hard[-1]):
            self.close(at[-1])

    def begin(self, name: str) -> None:
        """What a start tag ends: an open paragraph before a block; items and cells before the next one."""
        if name in BLOCK and self.stack[self.hard[-1]].name == "p":
            self.close(self.hard[-1])
        if name in ENDS:
            stop = max((self.depths[x][-1] for x in STOPS[name] if self.depths.get(x)), default=0)
            ended = [at[k] for x in ENDS[name] if (at := self.depths.get(x)) and (k := bisect_right(at, stop)) < len(at)]
            if ended:
                self.close(min(ended))


def parse(html: str) -> Element:
    """A forgiving tree in one pass: unknown ends are skipped, missing ones are supplied, a tag that never ends is dropped."""
    root = Element("", {}, None)
    open_ = _Open(root)
    at, quotes = 0, True  # whether quotes in tags are still heeded: after one tag that they leave without end they are not
    size = len(html)
    while at < size:
        lt = html.find("<", at)
        while lt >= 0 and not (lt + 1 < size and (html[lt + 1] in "!?/" or html[lt + 1].isascii() and html[lt + 1].isalpha())):
            lt = html.find("<", lt + 1)
        if lt < 0:
            lt = size
        if lt > at:
            open_.stack[-1].children.append(unescape(html[at:lt]))
        if lt == size:
            break
        end_tag = html[lt + 1] == "/"
        name = TAG_NAME.match(html, lt + 1 + end_tag)
        if not name:
            stop, skip = ("-->", 4) if html.startswith("<!--", lt) else ("]]>", 9) if html.startswith("<![CDATA[", lt) else (">", 1)
            end = html.find(stop, lt + skip)
            at = size if end < 0 else end + len(stop)
            continue
        rest = TAG_REST.match(html, name.end()) if quotes else None
        if not rest and quotes:
            quotes = False
        end = rest.end() if rest else html.find(">", name.end()) + 1
        if not end:
            break
        at, inside, name = end, html[name.end() : end - 1], name[0].lower()
        if end_tag:
            open_.end(name)
            continue
        open_.begin(name)
        attributes = {}
        if inside.strip(" /"):
            for a in ATTRIBUTE.finditer(inside):
                attributes.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        node = Element(name, attributes, open_.stack[-1])
        node.parent.children.append(node)
        if name in RAW_ENDS:
            end = RAW_ENDS[name].search(html, at)
            words, at = (html[at : end.start()], end.end()) if end else (html[at:], size)
            if name in ESCAPABLE:
                node.children.append(unescape(words))
        elif name not in VOID:
            open_.push(node)
    return root


def _names(element: Element) -> set[str]:
    return {x.lower() for key in ("class", "id") if key in element.attributes for x in NAME_PARTS.findall(element.attributes[key])} if element.attributes else set()


def _named_side(element: Element, inside: bool) -> bool:
    """Whether class or id name what is not the article. Headings and other prose never go by a name; inside an article a name
    counts only if all its words are such (``share-buttons``, not ``market-share``)."""
    if element.name in PROSE:
        return False
    if not inside:
        return bool(_names(element) & SIDE)
    words = [{x.lower() for x in NAME_PARTS.findall(t) if not x.isdigit()} for key in ("class", "id") for t in element.attributes.get(key, "").split()]
    return any(w & (SIDE - {"header"}) and not w - SIDE - FURNITURE for w in words)


def _wraps(form: Element) -> bool:
    """Whether a form holds what would be the article, as pages of some servers stand in one form. Settled for all forms inside
    it too, in one walk."""
    if form.wraps is None:
        holds: set[int] = set()
        for e in _elements(form):
            if e.name == "form":
                e.wraps = id(e) in holds
            marked = e.name in ("article", "main") or e.attributes.get("itemprop") == "articleBody" or e.attributes.get("role") == "main"
            if marked or (e.name in ("div", "section", "td") and _names(e) & MAIN_NAMES):
                holds.add(id(e))
            if id(e) in holds:
                holds.add(id(e.parent))
    return form.wraps


def is_unseen(element: Element, inside: bool) -> bool:
    """Whether an element is hidden, a form, or nothing that shows as text."""
    if element.name == "form":
        return inside or not _wraps(element)
    return element.name in NEVER and element.name not in LANDMARKS or "hidden" in element.attributes or element.attributes.get("aria-hidden") == "true"


def is_side(element: Element, inside: bool) -> bool:
    """Whether the markup itself says that an element is not the article; ``inside``: within an article."""
    if element.name == "form" and not inside and _wraps(element):
        return False
    if element.name in NEVER or (element.name == "header" and not inside):
        return True
    attributes = element.attributes
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in SIDE_ROLES:
        return True
    if element.name in ("html", "body", "main") or (element.name == "article" and "comment" not in _names(element)):
        return False
    if _names(element) & {"has", "with"} and _names(element) & SIDE <= {"sidebar"}:
        return False  # a layout that has a sidebar is not one
    return _named_side(element, inside)


def _text_parts(element: Element, inside: bool, out: list[list[str]], left_out=is_side) -> int:
    """Appends the text of an element in blocks and returns the characters of parts left out; a loop with its own stack,
    for pages nested very deep."""
    stack: list[tuple] = [(element, inside, iter(element.children))]
    named = 0
    while stack:
        node, within, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if node.name in BLOCK:
                out.append([])
        elif isinstance(child, str):
            out[-1].append(child)
        elif child.name == "br":
            out[-1].append(" ")
        elif left_out(child, within):
            named += sum(len(SPACE.sub(" ", t).strip()) for e in _elements(child) for t in e.children if isinstance(t, str) and child.name != "head")
        else:
            if child.name in BLOCK:
                out.append([])
            stack.append((child, within or child.name in ("article", "main"), iter(child.children)))
    return named


def _elements(root: Element):
    """All elements, each after those it holds."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    return reversed(order)


def articles(root: Element) -> list[Element]:
    """The elements that hold the text: marked articles, else the main part, else the largest element named as content,
    else the page."""

    def outermost(match):
        found, stack = [], [(root, False)]
        while stack:
            node, inside = stack.pop()
            if node is not root and match(node):
                found.append(node)
                continue
            for child in reversed(node.children):
                if not isinstance(child, str) and not is_side(child, inside):
                    stack.append((child, inside or child.name in ("article", "main")))
        return found

    for match in (
        lambda e: e.name == "article" or e.attributes.get("itemprop") == "articleBody",
        lambda e: e.name == "main" or e.attributes.get("role") == "main",
    ):
        if found := outermost(match):
            return found
    named = outermost(lambda e: e.name in ("div", "section", "td") and bool(_names(e) & MAIN_NAMES))
    return [max(named, key=lambda e: e.chars)] if named else [root]


def measure(root: Element) -> Element | None:
    """Sets each element's hash (name, class, and all it holds, white space and numbers aside), shape (names and classes
    alone, repeats once), characters, and what of these is links; returns the block with the most words of its own."""
    best, most = None, 0
    for node in _elements(root):
        head = f"{node.name}\0{NUMBER.sub('0', node.attributes.get('class', ''))}\0"
        digest, shape = xxhash.xxh64(head), xxhash.xxh64(head)
        chars = linked = links = own = last = 0
        for child in node.children:
            if isinstance(child, str):
                squeezed = SPACE.sub(" ", child).strip()
                digest.update(NUMBER.sub("0", squeezed) + "\1")
                chars += len(squeezed)
                own += len(squeezed)
            else:
                digest.update(child.hash.to_bytes(8, "little"))
                if child.shape != last:
                    shape.update(child.shape.to_bytes(8, "little"))
                    last = child.shape
                chars, linked, links = chars + child.chars, linked + child.linked, links + child.links
                own += child.own if child.name in INLINE else 0
        if node.name == "a":
            linked, links, own = chars, 1, 0
        node.hash, node.shape, node.chars, node.linked, node.links, node.own = digest.intdigest(), shape.intdigest(), chars, linked, links, own
        if own > most and node.name not in INLINE and node.name not in ESCAPABLE:
            best, most = node, own
    return best


def _candidates(root: Element):
    """(element, key of its content or None, key of its list of links or None, key of its place or None) of what could be
    a template. A caller that sends True back gets nothing from inside the element."""
    stack = [(root, False, 0)]
    while stack:
        node, inside, path = stack.pop()
        for child in node.children:
            if isinstance(child, str) or not child.chars or child.name in RAW or child.name == "head":
                continue
            whole = child.name in WHOLE and not is_side(child, inside)
            prose = inside and (child.name in PROSE or child.name in INLINE) and child.linked < child.chars
            here = xxhash.xxh64_intdigest(f"{path}/{child.name} {NUMBER.sub('0', child.attributes.get('class', ''))}")
            place = xxhash.xxh64_intdigest(f"{here}#") if not whole and child.name not in PROSE and is_side(child, inside) else None
            listed = None
            if not inside and child.links >= LIST_LINKS and child.linked >= LINK_SHARE * child.chars:
                listed = xxhash.xxh64_intdigest(f"{here}:{child.shape}")
            gone = (yield child, None if prose else child.hash, listed, place) if not whole else None
            if not gone:
                stack.append((child, inside or (whole and child.name in ("article", "main")), here))


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def subtrees(html: str | None) -> tuple[int, list[int], list[int]]:
    """What a page adds to the count: a number that tells its content apart, and the keys of its distinct subtrees by
    content or place and by their lists of links.

    The content is the block with the most words; what holds that block is no template of this page.
    """
    root = parse(html or "")
    body = node = measure(root)
    holders = set()
    while node:
        holders.add(id(node))
        node = node.parent
    by_content, by_list = set(), set()
    for child, key, listed, place in _candidates(root):
        if id(child) not in holders:
            by_content.update(_signed(k) for k in (key, place) if k is not None)
        if listed is not None:
            by_list.add(_signed(listed))
    return (body.hash if body else 0) % CONTENT_BITS, sorted(by_content), sorted(by_list)


def prune(root: Element, templates: set[int]) -> int:
    """Delete the subtrees that are templates (signed keys); returns the characters deleted."""
    if not templates:
        return 0
    gone, deleted, found = set(), 0, _candidates(root)
    answer = None
    while True:
        try:
            child, *keys = found.send(answer)
        except StopIteration:
            break
        answer = any(k is not None and _signed(k) in templates for k in keys)
        if answer:
            gone.add(id(child))
            deleted += child.chars
    if gone:
        for node in _elements(root):
            node.children = [c for c in node.children if isinstance(c, str) or id(c) not in gone]
    return deleted


def extract(html: str | None, templates: set[int], by_count: bool | None = None) -> tuple[str, int, int]:
    """Text of a page without the given subtrees, and the characters that were deleted by counts and otherwise (by names;
    unseen). ``by_count``: counts decide, names do not; unset, they do if there are templates."""
    root = parse(html or "")
    measure(root)
    counted = prune(root, templates)
    blocks: list[list[str]] = [[]]
    if templates if by_count is None else by_count:
        other = _text_parts(root, False, blocks, is_unseen)
    else:
        for holder in articles(root):
            _text_parts(holder, holder.name in ("article", "main"), blocks)
            blocks.append([])
        other = _text_parts(root, False, [[]])
    return "\n".join(x for x in (SPACE.sub(" ", "".join(b)).strip() for b in blocks) if x), counted, other


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def subtree_counts(pages: DataFrame) -> DataFrame:
    """host, key, listed (whether the key is that of a list of links), on (pages of the host it stands on), contents (how
    many contents of these pages are told apart, at least: copies of one page are one content), pages (of the host).

    Null html is a page without subtrees; repeated rows are pages each, of one content; an empty table gives no rows.
    """

    @F.pandas_udf("content int, keys array<long>, lists array<long>")
    def hashed(htmls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([subtrees(h) for h in htmls], columns=["content", "keys", "lists"])

    told = bounded_batches(pages).select(host(F.col("url")).alias("host"), hashed("html").alias("s"))
    keyed = lambda keys, listed: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(listed).alias("listed")))
    seen = told.select("host", F.expr("shiftleft(1L, s.content)").alias("bit"), F.explode(F.concat(keyed(F.col("s.keys"), False), keyed(F.col("s.lists"), True))).alias("k"))
    seen = seen.groupBy("host", "k.key", "k.listed").agg(F.count("*").alias("on"), F.bit_count(F.bit_or("bit")).alias("contents")).where(F.col("on") >= LEAST_PAGES)
    sizes = pages.groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    return seen.join(sizes, "host")


def site_templates(pages: DataFrame) -> DataFrame:
    """host and the keys of its templates; hosts without a template, or with fewer than ``LEAST_PAGES`` pages, have no row.

    A template stands on the square root of the host's pages at least (a masked list of links on ``LIST_SHARE`` of them)
    and on pages of several contents, so a host has no more than a page's elements times that root. Pages with a null or
    odd url share the host "".
    """
    need = F.greatest(F.lit(float(LEAST_PAGES)), F.sqrt("pages"))
    enough = F.col("on") >= F.when(F.col("listed"), F.greatest(need, LIST_SHARE * F.col("pages"))).otherwise(need)
    common = subtree_counts(pages).where(enough & (F.col("contents") >= F.least(need, F.lit(CONTENTS))))
    return common.groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("templates"))


def main_text(pages: DataFrame) -> DataFrame:
    """Pages with columns ``text``, the main text, blocks joined by one line feed, empty if there is none, and
    ``_deleted``: characters deleted by_count and by_name.

    Null html is an empty page; pages with a null or odd url share the host "". Repeated rows count as pages each and
    give a text each. All columns are passed on (``text`` and ``_deleted`` are replaced); an empty table gives no rows.
    Template lists are written first, so that Spark knows their size and broadcasts them only if that is small; else
    both sides are dealt by host and one of 32 salts.
    """
    salts = 32
    found = materialise(site_templates(pages), "templates")
    found = found.select(F.col("host").alias("_host"), F.col("templates").alias("_templates"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))

    @F.pandas_udf("text string, by_count long, by_name long")
    def extracted(htmls: pd.Series, templates: pd.Series) -> pd.DataFrame:
        sets: dict[bytes, set[int]] = {}

        def known(t):
            key = b"" if t is None else np.asarray(t, np.int64).tobytes()
            if key not in sets:
                sets[key] = set(np.frombuffer(key, np.int64).tolist())
            return sets[key]

        return pd.DataFrame([extract(h, known(t)) for h, t in zip(htmls, templates)], columns=["text", "by_count", "by_name"])

    salt = F.pmod(F.xxhash64("url", "html"), F.lit(salts)).cast("int")
    dealt = pages.select(F.struct("*").alias("_page"), host(F.col("url")).alias("_host"), salt.alias("_salt")).join(found, ["_host", "_salt"], "left")
    done = dealt.select("_page", extracted("_page.html", "_templates").alias("_x"))
    kept = [F.col("_page").getField(c).alias(c) for c in pages.columns if c.lower() not in ("text", "_deleted")]
    return done.select(*kept, F.col("_x.text").alias("text"), F.struct("_x.by_count", "_x.by_name").alias("_deleted"))
