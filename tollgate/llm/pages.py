"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One comment, declaration or tag. A quote after "=" opens a value of any length,
#: which may hold ">"; a quote elsewhere, or one that nothing closes, is a character
#: like others. No part gives back what it took, so a page is read once.
_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")

_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math canvas object audio video select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is not the article's.
_DROP = frozenset("head nav footer aside form button dialog menu fieldset label legend option optgroup datalist applet map".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split()
)
_CLOSES_P = _BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: What an open element of the key's kind is ended by, up to the named scopes.
_SAME = {"li": (("li",), ("ul", "ol", "dir", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr"))}
_MAIN = frozenset(("article", "main"))
#: Words of class and id that mark what stands around an article.
_AROUND = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist discussion disqus reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay pagination pager copyright disclaimer skip search tags hidden".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
_ITEM = frozenset(("p", "td", "pre", "blockquote", "li", "dd", "div", "section", "article", "main", "body", "figcaption", "th"))


class _Node:
    __slots__ = ("drop", "links", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: _Node | None, drop: bool):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.score, self.size, self.links = 0.0, 0, 0


def _around(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element's attributes say that it is not the article's; ``inside``
    an article, a header is the article's own."""
    if tag in ("html", "body"):
        return False
    words: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name in ("class", "id"):
            words.update(_WORD.findall(value))
        elif name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    around = words & _AROUND
    if inside:
        around -= {"header", "tags"}
    return tag not in _MAIN and bool(around) or bool(words & {"comment", "comments", "reply"})


def _blocks(html: str) -> list[tuple[_Node, str, int]]:
    """(element, text, characters in links) of every block that is not dropped, in page order."""
    root = _Node("html", None, False)
    stack, out, text, link = [root], [], [], 0
    linked, at, end = 0, 0, len(html)

    def flush() -> None:
        nonlocal text, linked
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line and not stack[-1].drop:
                out.append((stack[-1], line, min(linked, len(line))))
            text, linked = [], 0

    def pop_to(i: int) -> None:
        flush()
        del stack[i:]

    while at < end:
        m = _MARKUP.search(html, at)
        piece = html[at : m.start() if m else end]
        if piece:
            text.append(piece)
            if link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag, closing, attributes = tag.lower(), bool(m[1]), m[3]
        if closing:
            if tag == "a":
                link = 0
            elif tag in _BLOCK or tag in _DROP or tag == "span":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        if tag == "span":
                            pop_to(i) if i == len(stack) - 1 else None
                        else:
                            pop_to(i)
                        break
                else:
                    if tag in _BLOCK:
                        flush()
            continue
        if tag in _RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = close.end() if close else end
            text.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag != "wbr":
                text.append(" ")
            continue
        if tag == "a":
            link = 1
            continue
        if tag not in _BLOCK and tag not in _DROP:
            if tag == "span" and attributes.strip():
                if _around(tag, attributes):
                    flush()
                    stack.append(_Node(tag, stack[-1], True))
            continue
        flush()
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in ("td", "th", "table", "button", "caption"):
                    break
        if tag in _SAME:
            kinds, scopes = _SAME[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in kinds:
                    pop_to(i)
                elif stack[i].tag in scopes:
                    break
        if tag in _MAIN or tag == "body":
            # An article doesn't lie in what is dropped: that was left open.
            for i in range(1, len(stack)):
                if stack[i].drop:
                    pop_to(i)
                    break
        inside = any(n.tag in _MAIN for n in stack)
        drop = stack[-1].drop or tag in _DROP or tag == "header" and not inside or bool(attributes) and _around(tag, attributes, inside)
        stack.append(_Node(tag, stack[-1], drop))
        link = 0
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article of a page, one line per block.

    Every block of 25 characters or more scores one point, one per comma and up
    to three for its length; its element gets them whole, the next ancestor
    half, those above a third, a quarter and so on. A container's score is
    multiplied by one minus the share of its characters that stand in links.
    The best container is kept (the whole article or main element that it is part
    of), with those siblings that score a fifth of it or
    are long paragraphs with few links. Without any scoring block, the longest
    container counts. Null, empty and text-free pages give an empty string.
    """
    if not html:
        return ""
    blocks = _blocks(html)
    if not blocks:
        return ""
    touched: dict[int, _Node] = {}
    for node, line, linked in blocks:
        n, level = node, 0
        points = 1 + line.count(",") + line.count("，") + min(len(line) / 100, 3.0) if len(line) >= 25 and node.tag in _ITEM else 0.0
        # The paragraph itself is no container, unless it holds the text alone.
        n = node.parent if node.tag in ("p", "li", "td", "th", "pre", "blockquote", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption") and node.parent else node
        points *= 1 - linked / len(line)
        while n is not None:
            level += 1
            touched[id(n)] = n
            n.score += points / level
            n.size += len(line)
            n.links += linked
            n = n.parent

    def value(n: _Node) -> float:
        bonus = 1.5 if n.tag in _MAIN else 0.5 if n.tag in ("html", "body") else 1.0
        return n.score * (1 - n.links / max(n.size, 1)) * bonus

    best = max(touched.values(), key=value)
    if value(best) <= 0:
        best = max((n for n in touched.values() if n.tag in _MAIN), key=lambda n: n.size, default=None) or max(touched.values(), key=lambda n: (n.size - n.links, n.tag not in ("html", "body")))
        if best.size - best.links <= 0 and best.tag not in _MAIN:
            return ""
    # A part of a marked article stands for all of it.
    n = best
    while n is not None and n.tag not in _MAIN:
        n = n.parent
    if n is not None and n.links < 0.5 * n.size:
        best = n
    least = max(0.2 * value(best), 1.0)

    def kept(node: _Node, line: str, linked: int) -> bool:
        n, last = node, None
        while n is not None:
            if n is best:
                return True
            if n.parent is best.parent and best.parent is not None and n is not best:
                last = n
                break
            n = n.parent
        if last is None:
            return False
        if last.tag == "p":
            return len(line) > 80 and linked < 0.25 * len(line) or last.score > 0 and value(last) >= least
        return last.tag in ("article", "section", "div", "blockquote", "pre") and value(last) >= least

    return "\n".join(line for node, line, linked in blocks if kept(node, line, linked))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    Null ids and urls stay null; repeated rows are extracted each; other columns
    are ignored; an empty table gives no rows. A page is read whole.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def extract(batches):
        for batch in batches:
            text = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(extract, SCHEMA)
