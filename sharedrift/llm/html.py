"""Main text of web pages by composite text density.

Every node of a page has a density: its characters per tag, raised where little of them is link text.  A node's
density sum is the sum of its children's densities.  The node with the largest sum is the core of the article; the
least density on its path to the body is the threshold.  From the body down, each branch whose density reaches the
threshold gives the subtree with the largest sum inside it, and what stands beside that subtree is searched in the same way.  A chosen
subtree inside an ``article`` or ``main`` element stands for that element as a whole; one without takes the headings
right before it along, and stands for the outermost container below the body whose text is mostly chosen and otherwise not
mostly links.

What is never article text takes no part: scripts, styles, forms, menus, page headers and footers, sidebars, and elements whose
class, id or role says so (adverts, notices, reader comments and the like).  Such a name must be a whole class, id or role, of
which the other parts, if any, are words like "box" or "list".  Names don't count for ``article`` and ``main`` elements, nor, on
pages that have none, for the element that holds most of the text.

Text: character references are decoded; white space inside a block becomes one space and is trimmed; blocks are joined in
page order by one newline.

Edge cases: null or empty html, and pages without text, give the empty text; elements left open or closed out of turn are
read as browsers do (a new paragraph ends the last one, an unknown end tag is ignored, a tag that the end of the page cuts
off is dropped); pages may be of any length and depth, as nothing recurses; repeated rows give repeated results; an empty
table gives an empty result; other columns are kept, those named like an output are replaced.
"""

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: element kinds of HTML, and names of what is not article text -------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset(
    "head script style textarea title xmp iframe noembed noframes noscript nav footer aside form button select template"
    " svg embed canvas audio video menu annotation annotation-xml".split())
DROPPED_OUTSIDE = frozenset("header dialog object".split())  # unless in an article
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices"
    " comment comments disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead related share"
    " sharing social newsletter popup modal contentinfo complementary search".split())
PLAIN_PARTS = frozenset(
    "area bar block body bottom box container content form global inner item items left link links list main outer page panel"
    " right section site slot the top unit widget wrap wrapper".split())
MATH = frozenset(
    "math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub"
    " msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split())
ENDS_SAME = {  # an open element of the second kind ends where one of the first begins
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"),
}
STOPS = frozenset("ul ol dl table select body html article section div main".split())  # such an end goes no further up
UNBROKEN = INLINE | RAW | MATH | (VOID - {"hr"}) | frozenset("button select template svg object canvas audio video head".split())
KEEPS_PARAGRAPH = INLINE | VOID | RAW | MATH | frozenset(["body", "html", "head", "button", "object", "svg"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# --- end of fixed values --------------------------------------------------------------------------------------------
CONTAINER_SHARE = 0.5  # of a container's characters are chosen, if it stands for them
CONTAINER_LINKS = 0.3  # of its other characters are links at most

TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|"
    # possessive, so every character is read once; a tag that never ends takes the rest of the page
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
NAME_PARTS = re.compile(r"[a-z0-9]+")


def _says_dropped(attributes: str) -> bool:
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for word in unescape("".join(values)).lower().split():
                parts = {part for part in NAME_PARTS.findall(word) if not part.isdigit()}
                if not parts.isdisjoint(DROPPED_NAMES) and parts <= DROPPED_NAMES | PLAIN_PARTS:
                    return True
    return False


class Page:
    """A page as parallel lists, nodes in page order (a parent before its children); node 0 is the root."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.skip = [0], [""], [False]
        self.named = [False]  # whether the class, id or role is that of something dropped
        self.texts: list[tuple[int, str | None]] = []  # text and the node it stands in; None where a block begins or ends
        self.opened = [0]
        self.n_open: Counter[str] = Counter()  # by tag, so what isn't open isn't looked for
        at = 0
        while at < len(html):
            found = TAG.search(html, at)
            end = found.start() if found else len(html)
            if end > at:
                self.texts.append((self.opened[-1], unescape(html[at:end])))
            if not found:
                break
            at = found.end()
            if found[2]:
                tag = found[2].lower()
                if found[1]:
                    self._close(tag)
                else:
                    self._open(tag, found[3])
                    if tag in RAW:
                        close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(html, at)
                        at = close.end() if close else len(html)
                        self._pop(len(self.opened) - 1)
        self._skip_named()

    def _pop(self, depth: int) -> None:
        self.n_open.subtract(self.tag[n] for n in self.opened[depth:])
        del self.opened[depth:]

    def _end(self, tags: tuple[str, ...], stops: frozenset[str]) -> None:
        if not any(self.n_open[tag] for tag in tags):
            return
        for depth in range(len(self.opened) - 1, 0, -1):
            tag = self.tag[self.opened[depth]]
            if tag in tags:
                if any(self.tag[n] not in UNBROKEN for n in self.opened[depth:]):
                    self.texts.append((0, None))
                self._pop(depth)
                return
            if tag in stops:
                return

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in KEEPS_PARAGRAPH:
            self._end(("p",), STOPS)
        if tag in ENDS_SAME:
            self._end(ENDS_SAME[tag], STOPS)
        up = self.opened[-1]
        skip = self.skip[up] or tag in DROPPED or (tag in DROPPED_OUTSIDE and not self._inside_article())
        self.named.append(
            not skip and attributes != "" and tag not in ("html", "body", "article", "main") and _says_dropped(attributes))
        self.parent.append(up)
        self.tag.append(tag)
        self.skip.append(skip)
        if tag == "br":
            self.texts.append((up, " "))
        elif tag not in UNBROKEN:
            self.texts.append((0, None))
        if tag not in VOID:
            self.opened.append(len(self.tag) - 1)
            self.n_open[tag] += 1

    def _close(self, tag: str) -> None:
        self._end((tag,), frozenset(["body"]) if tag not in ("body", "html") else frozenset())

    def _inside_article(self) -> bool:
        return self.n_open["article"] + self.n_open["main"] > 0

    def _skip_named(self) -> None:
        if not any(self.named):
            return
        size = len(self.tag)
        chars = [0] * size
        for n, text in self.texts:
            if text and not self.skip[n]:
                chars[n] += len("".join(text.split()))
        has_article = any(not skip and tag in ("article", "main") for skip, tag in zip(self.skip, self.tag))
        for n in range(size - 1, 0, -1):
            if not self.skip[n]:
                chars[self.parent[n]] += chars[n]
        for n in range(1, size):
            holds_most = not has_article and 2 * chars[n] > chars[0]
            self.skip[n] = self.skip[n] or self.skip[self.parent[n]] or (self.named[n] and not holds_most)

    def main_text(self) -> str:
        return self._text(self._chosen())

    def _chosen(self) -> set[int]:
        """The nodes whose subtrees are the article."""
        size = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * size, [0] * size, [0] * size, [0] * size
        linked = [False] * size
        for n in range(1, size):
            linked[n] = linked[self.parent[n]] or self.tag[n] == "a"
        for n, text in self.texts:
            if text and not self.skip[n]:
                count = len("".join(text.split()))
                chars[n] += count
                link_chars[n] += count * linked[n]
        for n in range(size - 1, 0, -1):
            if not self.skip[n]:
                up = self.parent[n]
                chars[up] += chars[n]
                link_chars[up] += link_chars[n]
                tags[up] += tags[n] + 1
                link_tags[up] += link_tags[n] + (self.tag[n] == "a")
        body = next((n for n in range(size) if self.tag[n] == "body"), 0)
        if not chars[body]:
            body = 0
        ratio = link_chars[body] / max(chars[body], 1)
        density, total = [0.0] * size, [0.0] * size
        for n in range(size):
            if chars[n] and not self.skip[n]:
                c, t, lc, lt = chars[n], max(tags[n], 1), link_chars[n], link_tags[n]
                base = log(c / max(c - lc, 1) * lc + ratio * c + e)
                density[n] = max(0.0, c / t * log(c / max(lc, 1) * t / max(lt, 1)) / max(1.0, log(base)))
                total[self.parent[n]] += density[n] * (n > 0)
        if not chars[0]:
            return set()
        # the best node of each subtree: the largest sum, the first in page order if equal
        best = list(range(size))
        for n in range(size - 1, 0, -1):
            up = self.parent[n]
            if not self.skip[n] and (total[best[n]], -best[n]) > (total[best[up]], -best[up]):
                best[up] = best[n]
        core = node = best[body]
        threshold = density[core]
        while node != body and node:
            threshold = min(threshold, density[node])
            node = self.parent[node]
        threshold = min(threshold, density[body]) if core == body else threshold
        children: list[list[int]] = [[] for _ in range(size)]
        for n in range(1, size):
            children[self.parent[n]].append(n)
        chosen, todo = set(), [body]
        while todo:
            n = todo.pop()
            if not self.skip[n] and chars[n]:
                if density[n] >= threshold and (n != body or core == body):
                    node = self._whole(best[n])
                    chosen.add(node)
                    headings = self.tag[node] not in ("article", "main")
                    # the rest of the branch: what stands beside the way down to the chosen node
                    while node > n:  # nodes are in page order
                        up = self.parent[node]
                        at = children[up].index(node)
                        todo += children[up][:at] + children[up][at + 1:]
                        for m in reversed(children[up][:at]):
                            if headings and chars[m] and not self.skip[m]:
                                headings = self.tag[m] in HEADINGS
                                chosen.update([m] if headings else [])
                        node = up
                else:
                    todo += children[n]
        return self._grown(chosen, chars, link_chars)

    def _grown(self, chosen: set[int], chars: list[int], link_chars: list[int]) -> set[int]:
        """Chosen nodes, or the outermost container below the body of which the choice is most and the rest is not mostly links.

        So short paragraphs, and those an unclosed tag put elsewhere, stay with the article they stand in.
        """
        size = len(self.tag)
        got, got_links, covered = [0] * size, [0] * size, [False] * size
        for n in range(1, size):
            covered[n] = self.parent[n] in chosen or covered[self.parent[n]]
        top = [n for n in chosen if not covered[n]]
        for n in top:
            got[n], got_links[n] = chars[n], link_chars[n]
        for n in range(size - 1, 0, -1):
            got[self.parent[n]] += got[n]
            got_links[self.parent[n]] += got_links[n]
        grown = set()
        for n in top:
            best, up = n, self.parent[n]
            while up and self.tag[up] not in ("body", "html"):
                rest, links = chars[up] - got[up], link_chars[up] - got_links[up]
                if got[up] >= CONTAINER_SHARE * chars[up] and links <= CONTAINER_LINKS * rest:
                    best = up
                up = self.parent[up]
            grown.add(best)
        return grown

    def _whole(self, node: int) -> int:
        """The outermost article or main element around a node, or the node itself."""
        whole, up = node, node
        while up:
            if self.tag[up] in ("article", "main"):
                whole = up
            up = self.parent[up]
        return whole

    def _text(self, chosen: set[int]) -> str:
        inside = [False] * len(self.tag)
        for n in range(len(self.tag)):
            inside[n] = not self.skip[n] and (n in chosen or (n > 0 and inside[self.parent[n]]))
        blocks: list[list[str]] = [[]]
        for n, text in self.texts:
            if text is None:
                blocks.append([])
            elif inside[n]:
                blocks[-1].append(text)
        return "\n".join(line for block in blocks if (line := " ".join("".join(block).split())))


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """Add ``text``, the main text, and ``n_chars``, its code points; ``html`` is left out."""
    rows = pages.drop("text", "n_chars")
    keep = [c for c in rows.columns if c != "html"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string()),
                 pa.array(np.array([len(t) for t in texts], dtype=np.int64))], names=[*keep, "text", "n_chars"])

    schema = rows.drop("html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return rows.mapInArrow(work, schema)
