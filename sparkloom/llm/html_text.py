"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of tags from the root. Text length and punctuation are
summed by path and divided by the path's number of blocks; both ratios are smoothed along the page, fused by
their geometric mean, and paths under a share of the page's best value are set aside. The content node is the
deepest element that holds most of what the remaining paths carry, or the outermost article or main around it.
The text is all blocks of that node and, elsewhere, those whose path passes the threshold and is not mostly
links, in page order, without those in menus, headers, footers, sidebars, notices, adverts, forms and comments.

An id is often an anchor that names its topic: on headings and paragraphs ids say nothing, elsewhere an id counts
only if all its words name such a part or a neutral box; inside article and main a class too. Elsewhere a class
with such a name among other words counts unless its element holds most of the page's text; inside of them such a
class counts only if ratios speak for it as well: most of the element's text is links, or children of one path and class
repeat in it, as the entries of a list of comments do.

A comment, a self-closed svg or math and other foreign elements end as HTML has it. Text of svg, math, object, canvas and
noscript is text.

Pages are independent rows: one pass, no shuffle.

Defined cases: a null html is an empty page with empty text; text outside of any tag counts as a block of the
root; unclosed and stray tags are tolerated, at any depth; repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the page's best fused ratio below which a path is set aside, and share of the fused sum that a content node must hold.
THRESHOLD, HELD = 0.08, 0.7

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|([^<]+|<)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_STRAY = re.compile("<")
_PART = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
_RAW = {"script", "style", "textarea", "title", "iframe", "template", "annotation", "annotation-xml"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr svg object canvas noscript".split())
_INLINE |= set("math mi mo mn ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mstyle mpadded mphantom merror menclose semantics maction".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_APART = {"nav", "footer", "aside", "form", "button", "select", "dialog", "head"}
_APART_OUTSIDE = {"header", "menu", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs sidebar aside widget footer masthead cookie cookies consent"
    " notice notices disclaimer alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus respond reply replies pagination pager toolbar".split()
)
_NEUTRAL = set(
    "area bar block body bottom box button buttons center col column container content desktop footer global group header holder icon icons id in inline inner item items left link links list lists main mobile"
    " outer page panel position post posts primary reader readers right row section secondary site slot small social sticky text thread threads title tools top unit up user users visitor widgets wrap wrapper form".split()
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _names_part(value: str, strict: bool) -> bool:
    """Does a class or id name a part that is not text? Strict: one of its names, by all of its words."""
    if _NAMES.isdisjoint(_PART.findall(value)):
        return False
    return not strict or any(not _NAMES.isdisjoint(words) and _NAMES.union(_NEUTRAL).issuperset(words) for words in map(_PART.findall, value.split()))


class _Node:
    """An element. Its descendants have the numbers after its own, up to `last`; `path` numbers its path of tags and classes."""

    __slots__ = ("apart", "block", "hint", "last", "main", "named", "number", "parent", "path", "role", "tag", "weak")

    def __init__(self, tag: str, attributes: str, parent: _Node | None, number: int, paths: dict[tuple[int, str, str], int]):
        self.tag, self.parent, self.number, self.last = tag, parent, number, number
        self.block = parent.block if parent is not None and tag in _INLINE else self
        self.main = tag in ("article", "main") or (parent is not None and parent.main)
        own = tag in _APART or (tag in _APART_OUTSIDE and not self.main)
        name, self.role, self.weak, self.hint = "", False, False, False
        if attributes:
            for key, *value in _NAMED.findall(attributes):
                key, value = key.lower(), "".join(value).lower()
                if key == "role":
                    own |= value in _ROLES
                    self.role |= value in ("main", "article")
                    self.main |= self.role
                elif key == "style":
                    own |= "display:none" in value.replace(" ", "")
                elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                    own = True
                else:
                    named = tag not in ("html", "body", "article", "main") and not (key == "id" and (tag in _HEADINGS or tag == "p"))
                    own |= named and _names_part(value, strict=True)
                    if named and key == "class" and _names_part(value, strict=False):
                        self.weak |= not self.main
                        self.hint |= self.main
                    name += "." + value if key == "class" else ""
        self.apart = own or (parent is not None and parent.apart)
        self.named = bool(name)
        self.path = paths.setdefault((parent.path if parent is not None else -1, tag, name), len(paths))

    def holds(self, x: _Node) -> bool:
        return self.number <= x.number <= self.last


def _read(page: str) -> tuple[list[tuple[str, _Node, int]], list[_Node]]:
    """(the page's blocks of text: text with white space reduced, the element that it stands in, its characters inside links; all elements by number).

    Work is in proportion to the page, however deep its elements stand: nothing walks up the open ones but to close them.
    """
    paths: dict[tuple[int, str, str], int] = {}
    root = _Node("#", "", None, 0, paths)
    stack, out, nodes, opened = [root], [], [root], defaultdict(int)
    parts: list[str] = []
    home, linked = root, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, home, min(linked, len(text))))
        parts.clear()
        linked = 0

    def close(size: int) -> None:
        """Ends the elements from the stack's top down to `size` open ones."""
        while len(stack) > size:
            x = stack.pop()
            x.last = nodes[-1].number
            opened[x.tag] -= 1

    at, n = 0, len(page)
    while at < n and (m := _TOKEN.match(page, at) or _STRAY.match(page, at)):
        at = m.end()
        text = m[4] if m.re is _TOKEN else "<"
        if text is not None:
            if not parts:
                home = stack[-1].block
            parts.append(text)
            linked += len(text.strip()) if opened["a"] else 0
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                if tag not in _INLINE:
                    flush()
                x = len(stack) - 1
                while stack[x].tag != tag:
                    x -= 1
                close(x)
            continue
        if m[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag not in _INLINE:
            flush()
            ends = _CLOSES.get(tag, set()) | {"p"} | (_HEADINGS if tag in _HEADINGS else set())
            if any(opened[e] for e in ends):
                for x in range(len(stack) - 1, 0, -1):  # end tags that HTML leaves out
                    if stack[x].tag in ends:
                        close(x)
                    elif stack[x].tag not in _INLINE and (tag not in _CLOSES or stack[x].tag in _SCOPE[tag]):
                        break
        if tag not in _VOID and not m[3].endswith("/"):
            x = _Node(tag, m[3], stack[-1], len(nodes), paths)
            nodes.append(x)
            stack.append(x)
            opened[tag] += 1
    flush()
    close(0)
    _set_weak_apart(out, nodes)
    return out, nodes


def _set_weak_apart(found: list[tuple[str, _Node, int]], nodes: list[_Node]) -> None:
    """An element whose class has the name of a part among other words is that part, unless it holds most of the page's text; within the article only if its links or its repeated children say so too."""
    if not any(x.weak or x.hint for x in nodes):
        return
    held, linked, repeated = [0] * len(nodes), [0] * len(nodes), defaultdict(int)
    for text, x, inside in found:
        held[x.number] += 0 if x.apart else len(text) - inside
        linked[x.number] += 0 if x.apart else inside
    for x in reversed(nodes[1:]):
        held[x.parent.number] += held[x.number]
        linked[x.parent.number] += linked[x.number]
        if x.named and x.tag not in _INLINE:
            repeated[x.parent.number, x.path] += 1
    twice = {n for (n, _), times in repeated.items() if times > 1}
    for x in nodes[1:]:
        up = x.parent
        within = twice if x.hint else ()
        lists = x.hint and (linked[x.number] > held[x.number] or x.number in within or any(k in within for k in range(x.number + 1, min(x.last, x.number + 3) + 1)))
        x.apart |= up.apart or ((x.weak or lists) and 2 * held[x.number] <= held[0])


def blocks(page: str) -> list[tuple[str, _Node, int]]:
    """The page's blocks of text: text with white space reduced, the element that it stands in, its characters inside links."""
    return _read(page)[0]


def _smooth(x: list[float]) -> list[float]:
    return [(a + 2 * b + c) / 4 for a, b, c in zip([x[0], *x], x, [*x[1:], x[-1]])] if x else x


def main_text(page: str) -> str:
    every, nodes = _read(page)
    found = [b for b in every if not b[1].apart or (b[1].main and b[1].tag in _HEADINGS and b[1].parent.tag == "header")]
    if not found:
        return ""
    length, marks, count, linked = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for text, node, inside in found:
        length[node.path] += len(text)
        marks[node.path] += len(_PUNCTUATION.findall(text))
        linked[node.path] += inside
        count[node.path] += 1
    ratio = _smooth([(length[x.path] - linked[x.path]) / count[x.path] for _, x, _ in found])
    points = _smooth([marks[x.path] / count[x.path] for _, x, _ in found])
    fused = [(a * (b + 0.5)) ** 0.5 * (4 if x.main else 1) for a, b, (_, x, _) in zip(ratio, points, found, strict=True)]
    best = max(fused)
    weight = [f * len(t) if f >= THRESHOLD * best else 0.0 for f, (t, _, _) in zip(fused, found, strict=True)]
    # what each element holds, and its child that holds most: children have higher numbers than their parents
    held, heaviest = [0.0] * len(nodes), [0] * len(nodes)
    for w, (_, x, _) in zip(weight, found, strict=True):
        held[x.number] += w
    for x in reversed(nodes[1:]):
        up = x.parent.number
        held[up] += held[x.number]
        if held[x.number] and (not heaviest[up] or held[x.number] >= held[heaviest[up]]):
            heaviest[up] = x.number
    node = 0
    while heaviest[node] and held[heaviest[node]] >= HELD * held[node]:
        node = heaviest[node]
    # a lone paragraph is not the article: its siblings and heading belong to it
    holder = nodes[node]
    while holder.parent is not None and (holder.tag in _HEADINGS or holder.tag in ("p", "li", "ul", "ol", "blockquote", "pre", "td", "tr", "tbody", "table", "dl", "dd", "section", "header")):
        holder = holder.parent
    x = holder
    while x is not None:
        if x.tag in ("article", "main") or x.role:
            holder = x
        x = x.parent
    whole = holder.tag not in ("#", "html", "body")
    kept = []
    for w, (t, x, _) in zip(weight, found, strict=True):
        plain = 2 * linked[x.path] < length[x.path]
        if whole and holder.holds(x):
            kept.append(t)
        elif plain and w or holder.holds(x) and (plain or x.tag == "p" or x.tag in _HEADINGS):
            kept.append(t)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, text."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(main_text, batch.column(2).to_pylist()), pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, rows.drop("html").schema.add("text", "string"))


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
