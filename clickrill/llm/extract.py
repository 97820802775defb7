"""Main text of HTML pages by composite text density.

For every DOM node: characters per tag, adjusted by the share of its characters and tags that are links. A node's density
sum is that of its children's densities (markup inside a paragraph counts as part of it, and a paragraph's sum is its own
density). The node with the largest sum is the core. The smallest density on the path from it to the body is the threshold:
from a core that holds no paragraphs itself the search goes down again, as long as one child that holds blocks reaches
the core's own density; and up again, to the article element about it, to the parent of several parts of one kind that
all reach the threshold, or to that of nothing but headings besides. That subtree is the article; menus, headers, footers, sidebars, notices and adverts
beside it are left out because density doesn't choose them, whatever their names.

Only elements whose text is never shown as text (scripts, styles, form controls ...) are left out beforehand. Lists of tag
and class names serve inside the chosen subtree alone, for what an article's own element may hold besides (reader comments,
sharing, adverts between paragraphs), and keep an element so named from being the core. Where no element but the
body holds the text, class names aren't used at all, and blocks without blocks beside its paragraphs are none of them. Nodes are kept in document order, so nothing here recurses,
however deep a page nests.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Never shown as text of the page.
NEVER = frozenset("script style noscript template head title button select textarea iframe object svg canvas audio video map option datalist".split())
#: No part of an article inside its element.
ASIDE = frozenset("nav footer aside form menu dialog".split())
#: What text stands in.
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
HEADING = frozenset("h1 h2 h3 hgroup header".split())
#: Words of a class, id or role that mark an element inside the article's as no part of it.
BOILERPLATE = frozenset("ad ads adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter subscribe subscription sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead respond reply replies disqus share sharing social related recommended popup modal overlay toolbar pagination pager login signup search skip complementary contentinfo toc disclaimer outbrain taboola".split())
_STARTS = ("advert", "comment", "adsby", "sidebar", "navigation", "cookie", "newsletter")
#: Never part of a wrapper's name.
_TOP = frozenset("footer masthead respond disqus contentinfo".split())
#: A header of one of these is the article's own.
OWN = frozenset("article entry post story content main".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set())}
_TOKEN = re.compile(r"[a-z]+")


#: How sure a node's own mark is: no boilerplate; by words of its class, beside words for articles; by such words alone; surely.
FREE, PERHAPS, LIKELY, SURE = 0, 1, 2, 3


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
    if tag in NEVER or tag in ASIDE:
        return SURE
    mark = FREE
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")) or (name == "aria-hidden" and value == "true"):
            return SURE
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            tokens = set(_TOKEN.findall(value))
            found = {t for t in tokens if t in BOILERPLATE or t.startswith(_STARTS)}
            if any(t.startswith(_STARTS[:3]) or t in _TOP for t in found - {"header"}) or ("header" in found and not inside and not tokens & OWN):
                return SURE
            mark = max(mark, (PERHAPS if tokens & OWN else LIKELY) if found - {"header"} else FREE)
    return mark


class _Page(HTMLParser):
    """Nodes by number in document order, and the page as events: (node, text), (node, True) for its start, False for its end."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.mark, self.inside, self.kind = ["#root"], [-1], [FREE], [False], [("#root", "")]
        self.open, self.events, self.count = [0], [], {}
        self.feed(html)
        self.close()
        self._pop(1)

    def _pop(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            self.count[self.tag[node]] -= 1
            self.events.append((node, False))

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.count.get(tag):
            return
        if tag in BLOCK and self.count.get("p"):
            self._implied({"p"}, {"article", "section", "div", "td", "th", "li", "blockquote", "table", "button"})
        if tag in _CLOSES and any(self.count.get(x) for x in _CLOSES[tag][0]):
            self._implied(*_CLOSES[tag])
        up, node = self.open[-1], len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.inside.append(self.inside[up] or tag in ("article", "main"))
        self.mark.append(_boilerplate(tag, attrs, self.inside[up]))
        self.kind.append((tag, dict(attrs).get("class") or ""))
        self.events.append((node, True))
        if tag in VOID:
            self.events.append((node, False))
        else:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def _implied(self, ends: set[str], stops: set[str]) -> None:
        """Close the outermost open element of `ends` that lies above any of `stops`."""
        at = None
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in ends:
                at = depth
            elif tag in stops:
                break
        if at is not None:
            self._pop(at)

    def handle_endtag(self, tag):
        if tag in ("html", "body") or not self.count.get(tag):
            return  # what follows </body> still belongs to it
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[depth]] == tag:
                self._pop(depth)
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_data(self, data):
        self.events.append((self.open[-1], data))


class _Density:
    """Characters, characters in links, tags and link tags of each node with all that it holds, its composite density and
    its density sum; `never`: nodes that hold no shown text."""

    def __init__(self, page: _Page):
        n, tag, parent = len(page.tag), page.tag, page.parent
        self.never, anchor = [t in NEVER for t in tag], [False] * n
        self.chars, self.links, self.tags, self.link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            self.never[i] = self.never[i] or self.never[parent[i]]
            anchor[i] = anchor[parent[i]] or tag[i] == "a"
            if not self.never[i]:
                self.tags[i], self.link_tags[i] = 1, int(tag[i] == "a")
        for node, what in page.events:
            if isinstance(what, str) and not self.never[node]:
                size = len("".join(what.split()))
                self.chars[node] += size
                self.links[node] += size * anchor[node]
        for i in range(n - 1, 0, -1):
            for x in (self.chars, self.links, self.tags, self.link_tags):
                x[parent[i]] += x[i]
        self.body = tag.index("body") if "body" in tag else 0
        share = self.links[self.body] / max(1, self.chars[self.body])
        self.density, self.sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            self.density[i] = composite(self.chars[i], self.links[i], self.tags[i], self.link_tags[i], share)
            own = self.sums[i]
            # markup inside a paragraph is no child of its own, and a paragraph's sum is its own density
            self.sums[i] = 0.0 if tag[i] in INLINE else own or self.density[i]
            if i:
                self.sums[parent[i]] += own if tag[i] in INLINE else self.density[i]


def composite(chars: int, links: int, tags: int, link_tags: int, share: float) -> float:
    """The composite text density of a node; share: of the body's characters, those in links."""
    if not chars:
        return 0.0
    tags, link_tags = max(1, tags), max(1, link_tags)
    base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
    return chars / tags * max(0.0, math.log(chars / max(1, links) * tags / link_tags)) / math.log(max(1.5, base))


def _select(page: _Page, d: _Density, marked: list[bool]) -> int:
    """The node that holds the article."""
    n, tag, parent, body = len(page.tag), page.tag, page.parent, d.body
    free = [i for i in range(body, n) if not marked[i] and not d.never[i]] or [body]
    core = max(free, key=lambda i: (d.sums[i], d.density[i], -i))
    # down: a core without paragraphs of its own, of whose children just one holds blocks, or just one that is as dense
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        if tag[i] not in INLINE and not d.never[i] and d.chars[i]:
            children[parent[i]].append(i)
    while not any(tag[i] in PARAGRAPH and 2 * d.links[i] < d.chars[i] for i in children[core]):
        holders = [i for i in children[core] if children[i] and 2 * d.links[i] < d.chars[i] and not marked[i]]
        dense = holders if len(holders) == 1 else [i for i in holders if d.density[i] >= d.density[core]]
        if len(dense) != 1:
            break
        core = dense[0]
    # up: the threshold of the path to the body
    path = [core]
    while path[-1] != body and parent[path[-1]] >= 0:
        path.append(parent[path[-1]])
    threshold = min(d.density[i] for i in path)
    for i in path:
        if tag[i] in ("article", "main"):
            return i
    while core != body and parent[core] > 0 and tag[core] not in PARAGRAPH and tag[core] not in ("td", "th"):
        mates = [i for i in children[parent[core]] if i != core and not marked[i]]
        parts = any(page.kind[i] == page.kind[core] and d.density[i] >= threshold for i in mates)
        titled = parent[core] != body and mates and all(tag[i] in HEADING for i in mates)
        if not (parts or titled):
            break
        core = parent[core]
    return core


def _marked(page: _Page) -> list[bool]:
    """Nodes named as no article, with all that they hold; wrappers of an article, main or first heading element aren't."""
    n, parent, sure = len(page.tag), page.parent, [m == SURE for m in page.mark]
    for i in range(1, n):
        sure[i] = sure[i] or sure[parent[i]]
    holds = [page.tag[i] in ("article", "main", "h1") and not sure[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        holds[parent[i]] = holds[parent[i]] or holds[i]
    out = sure
    for i in range(1, n):
        out[i] = sure[i] or out[parent[i]] or (page.mark[i] != FREE and not holds[i])
    return out


def _dropped(page: _Page, d: _Density, root: int) -> list[bool]:
    """Which nodes inside root are none of the article: by tag, menus of links, and, unless root is the body, by class. A
    wrapper of most of the text may have a class like `with-sidebar`: one that holds the main element or a first heading
    isn't dropped for its class, nor is one that is named as an article too and holds more than half of the words."""
    n, tag, parent = len(page.tag), page.tag, page.parent
    inside = [False] * n
    for i in range(1, n):
        inside[i] = parent[i] == root or inside[parent[i]]
    named = tag[root] not in ("#root", "html", "body")
    sure = [d.never[i] or (inside[i] and (tag[i] in ASIDE or (named and page.mark[i] == SURE))) for i in range(n)]
    for i in range(1, n):
        sure[i] = sure[i] or sure[parent[i]]
    words, holds = [0] * n, [tag[i] in ("main", "h1") and not sure[i] for i in range(n)]
    for node, what in page.events:
        if isinstance(what, str) and not sure[node]:
            words[node] += len(what.split())
    for i in range(n - 1, 0, -1):
        words[parent[i]] += words[i]
        holds[parent[i]] = holds[parent[i]] or holds[i]
    # the body's own paragraphs, and boxes beside them
    bare = not named and any(parent[i] == root and tag[i] == "p" and d.chars[i] for i in range(1, n))
    boxes = {i for i in range(1, n) if parent[i] == root and tag[i] not in INLINE and tag[i] not in PARAGRAPH} - {parent[i] for i in range(1, n) if tag[i] not in INLINE}
    out = sure
    for i in range(1, n):
        menu = inside[i] and d.links[i] > 0.6 * d.chars[i] and d.link_tags[i] >= 3
        header = inside[i] and tag[i] == "header" and not named and not holds[i]
        by_class = named and inside[i] and page.mark[i] in (PERHAPS, LIKELY) and not holds[i] and (page.mark[i] == LIKELY or 2 * words[i] <= words[root])
        out[i] = sure[i] or out[parent[i]] or menu or header or by_class or (bare and parent[i] == root and i in boxes)
    return out


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by an empty line."""
    if not html:
        return ""
    page = _Page(html)
    n, tag, parent = len(page.tag), page.tag, page.parent
    d = _Density(page)
    root = _select(page, d, _marked(page))
    dropped = _dropped(page, d, root)
    content = [i == root for i in range(n)]
    for i in range(1, n):
        content[i] = content[i] or content[parent[i]]
    blocks, parts = [], []
    for node, what in page.events:
        if isinstance(what, str):
            if content[node] and not dropped[node]:
                parts.append(what)
        elif tag[node] == "br":
            parts.append(" ")
        elif tag[node] in BLOCK and parts:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
    blocks.append(" ".join("".join(parts).split()))
    return "\n\n".join(b for b in blocks if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, held, done = [], 0, 0
        for k, x in enumerate(b.column(2)):
            texts.append(main_text(x.as_py()))
            held += len(texts[-1])
            if held > 4 << 20 or k == b.num_rows - 1:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(texts)), b.column(1).slice(done, len(texts)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                done, texts, held = k + 1, [], 0


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points): the main text of every page.

    Null or empty html, and pages without text outside boilerplate: an empty text. Repeated rows: extracted each by itself.
    Empty table: no rows. Null ids and urls are passed on; other columns are left out.
    """
    rows = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return rows.mapInArrow(tidy(_extract), "page_id bigint, url string, text string, n_chars bigint")
