"""Main text of web pages by tree scoring.

A page is parsed into a tree with HTML's implied end tags. Elements that are boilerplate by tag,
role or class name are cut. Each remaining paragraph earns points for its length and commas and
passes them to its ancestors, less at each level; a container's points are discounted by its link
density. The best container (or the article or main element around it) is kept with those
siblings that score well enough or are plain paragraphs or headings.

Text: character references decoded, white space in a block turned into one space, blocks trimmed
and joined by one line feed; a line break tag is white space. Nothing else is dropped or cut.

Defined results: null, empty or text-free pages give an empty text; plain text without markup is
one block; an end of the page inside a tag leaves that tag as text; repeated rows give repeated
rows; null ids and urls are passed on; further columns are ignored, whatever they are called. Time
and memory are linear in the page, however its tags nest.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import text_parts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden|aria-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
#: What the end of the page closes.
OPEN_END = re.compile(r"(?:<!--|<!\[CDATA\[).*\Z", re.S)
PARTS = re.compile(r"[a-z]+|\d+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup: skipped to their end tag.
RAW = frozenset("script style noscript template iframe textarea title svg object noembed noframes xmp annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom mfenced menclose mspace mtable mtr mtd".split())
PARAGRAPHS = frozenset("p pre td th blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption caption address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CUT_TAGS = frozenset("nav footer aside form button select option datalist menu dialog head link meta input canvas audio video map".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: Words of class names and ids that tell boilerplate.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars "
    "footer header masthead comment comments commentlist disqus replies reply respond cookie cookies consent gdpr notice notices notification popup modal overlay share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login toolbar pagination pager widget widgets skip toc outbrain taboola copyright paywall rail aside sidenav topbar submenu menubar teaser teasers banners alert disclaimer".split()
)
#: Those that are cut even where the element holds most of the page's text.
READERS = frozenset("comment comments commentlist disqus replies respond".split())
GOOD_WORDS = frozenset("article body content entry main page post text blog story".split())
#: Words that may stand beside one of those in a name that tells boilerplate as a whole.
NEUTRAL_WORDS = GOOD_WORDS | frozenset("area bar block bottom box button buttons col column container first footer form group inner item items label last left link links list module outer panel right row section site small thread title top unit wrap wrapper".split())

CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
P_STOPS = frozenset("table td th button caption object".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}


class Node:
    __slots__ = ("tag", "words", "whole", "role", "hidden", "up", "items", "score", "chars", "commas", "linked", "links", "headings", "mains", "inside", "cut")

    def __init__(self, tag: str, attributes: str, up: Node | None) -> None:
        self.tag, self.up, self.items, self.score = tag, up, [], 0.0
        self.words, self.role, self.hidden, self.cut = frozenset(), "", False, False
        self.chars = self.commas = self.linked = self.links = self.headings = self.mains = 0
        self.whole = False  # a name that tells boilerplate as a whole
        self.inside = up is not None and (up.inside or up.tag in ("article", "main"))
        if attributes and not attributes.isspace():
            words: list[str] = []
            for name, value in ATTRIBUTE.findall(attributes):
                value = value.strip("\"'")
                match name.lower():
                    case "class" | "id":
                        for one in CAMEL.sub("-", value).lower().split():
                            parts = PARTS.findall(one)
                            words += parts
                            self.whole |= not CUT_WORDS.isdisjoint(parts) and all(x in CUT_WORDS or x in NEUTRAL_WORDS or x.isdigit() for x in parts)
                    case "role":
                        self.role = value.lower().strip()
                    case "hidden":
                        self.hidden = True
                    case "aria-hidden":
                        self.hidden |= value.lower() == "true"
                    case "style":
                        self.hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            self.words = frozenset(words)


def parse(page: str) -> Node:
    """The tree of a page; text items are decoded."""
    root = Node("#root", "", None)
    stack, places, not_inline = [root], defaultdict(list), [0]
    lost: set[str] = set()  # tags without a further end tag
    at, size = 0, len(page)
    last = page.rfind(">")

    def close(to: int) -> None:
        """Closes the elements from the place to on."""
        while len(stack) > to:
            places[stack.pop().tag].pop()
        while not_inline[-1] >= to:
            not_inline.pop()

    def innermost(tags: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element of tags, or 0."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    while at < size:
        m = TOKEN.search(page, at, last + 1) if at <= last else None
        if m is None or m[0].startswith("<!--") and not m[0].endswith("-->") or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>"):
            m = OPEN_END.search(page, at if m is None else m.start())
        begin = m.start() if m else size
        if begin > at:
            stack[-1].items.append(html.unescape(page[at:begin]))
        if not m:
            break
        at = m.end()
        shut, name, attributes = ("", "", "") if m.re is OPEN_END else (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if page.startswith("<![CDATA[", begin):
                stack[-1].items.append(page[begin + 9 : at].removesuffix("]]>"))
            continue
        tag = name.lower()
        if shut:
            if places[tag]:
                to = places[tag][-1]
                if tag not in INLINE or to > not_inline[-1]:
                    close(to)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = None if tag in lost else re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                if end:
                    gt = page.find(">", end.start())
                    at = gt + 1 if gt >= 0 else size
                else:
                    lost.add(tag)
                    if tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"):
                        at = size
            continue
        if tag in CLOSES_P and (to := innermost({"p"})) > innermost(P_STOPS):
            close(to)
        if tag in CLOSES:
            inside, stop = CLOSES[tag]
            while (to := innermost(inside)) > innermost(stop):
                close(to)
        node = Node(tag, attributes, stack[-1])
        stack[-1].items.append(node)
        if tag not in VOID and not (attributes.endswith("/") and tag in INLINE):
            if tag not in INLINE:
                not_inline.append(len(stack))
            places[tag].append(len(stack))
            stack.append(node)
    return root


def _order(root: Node) -> list[Node]:
    """All nodes that are not cut, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.cut:
            out.append(node)
            todo.extend(x for x in reversed(node.items) if type(x) is Node)
    return out


def _measure(nodes: list[Node]) -> None:
    """Sums over each node's subtree; parents come first."""
    for n in nodes:
        n.chars = n.commas = n.linked = n.links = n.headings = n.mains = 0
    for n in reversed(nodes):
        for x in n.items:
            if type(x) is str:
                n.chars += len(" ".join(x.split()))
                n.commas += x.count(",")
        if n.tag == "a":
            n.linked, n.links = n.chars, 1
        n.headings += n.tag in HEADINGS
        n.mains += n.tag in ("article", "main") and not n.words & READERS
        if n.up:
            n.up.chars += n.chars
            n.up.commas += n.commas
            n.up.linked += n.linked
            n.up.links += n.links
            n.up.headings += n.headings
            n.up.mains += n.mains


def _cut(root: Node) -> None:
    """Marks boilerplate by tag, role and class name."""
    nodes = _order(root)
    _measure(nodes)
    whole = max(root.chars, 1)
    core = set()
    for n in nodes:
        if n.tag in ("article", "main", "h1"):
            up = n if n.tag != "h1" else n.up
            while up is not None and up not in core:
                core.add(up)
                up = up.up
    for n in nodes:
        if n.tag in ("#root", "html", "body", "article", "main"):
            continue
        if n.hidden or n.tag in CUT_TAGS or n.role in CUT_ROLES:
            # a form around the page is no form of the article
            n.cut = n.hidden or n.tag != "form" or n not in core and n.chars < 0.5 * whole
        elif n.tag == "header":
            n.cut = not n.headings or not n.inside
            if not n.cut:
                for x in n.items:
                    if type(x) is Node and not x.headings:
                        x.cut = True
        elif n.tag not in HEADINGS and n.tag not in INLINE | {"p"} and n.words & CUT_WORDS or n.tag in ("p", "span", "a") and n.words & CUT_WORDS and not n.words & GOOD_WORDS:
            if n.inside and not n.whole and n.linked < 0.5 * n.chars:
                continue  # such as related-work or copyright-law
            n.cut = bool(n.words & READERS) and n.mains == (n.tag in ("article", "main") and not n.words & READERS) or n not in core and n.chars < 0.5 * whole
    # elements that only hold links, such as menus without a telling name
    nodes = _order(root)
    _measure(nodes)
    for n in nodes:
        if n.tag in ("ul", "ol", "div", "section", "table", "td", "dl") and n.links >= 3 and n.linked >= 0.8 * n.chars and n not in core:
            n.cut = True


def _best(root: Node, nodes: list[Node]) -> Node:
    """The container with most points; see the module's text."""
    for n in nodes:
        own = sum(len(x.strip()) for x in n.items if type(x) is str)
        if n.chars and (n.tag in PARAGRAPHS or n.tag not in INLINE and own and n.tag not in ("#root", "html", "body")):
            points = (1 + n.commas + min(n.chars / 100, 3)) * min(1, n.chars / 25)
            points *= 1 - n.linked / n.chars
            up, level = n.up if n.tag in PARAGRAPHS else n, 1
            while up is not None and up.up is not None and level <= 5:
                up.score += points / level
                up, level = up.up, level * 2
    best, most = None, 0.0
    for n in nodes:
        if n.score and n.tag not in ("html", "#root") and n.tag not in INLINE:
            good = 1.25 if n.tag in ("article", "main") or n.words & GOOD_WORDS else 1.0
            n.score *= good * (1 - n.linked / max(n.chars, 1))
            if n.score > most:
                best, most = n, n.score
    return best or next((n for n in nodes if n.tag == "body"), root)


def _kept(best: Node) -> list[Node]:
    """The best container with its siblings, or the article element around it."""
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.up
    if up is not None:
        while up.tag == "article" and up.inside:
            up = up.up
        return [up]
    if best.up is None or best.tag in ("body", "html"):
        return [best]
    out, enough = [], max(2.0, 0.2 * best.score)
    for x in best.up.items:
        if type(x) is not Node or x.cut or x.tag in INLINE:
            continue
        density = x.linked / x.chars if x.chars else 0
        if x is best or x.score >= enough or density < 0.25 and (x.tag in HEADINGS or x.tag in ("p", "pre", "blockquote") and x.chars):
            out.append(x)
    return out


def blocks(nodes: list[Node]) -> str:
    """Text of nodes, a line for each block."""
    lines, line = [], []

    def end() -> None:
        if line:
            if text := " ".join("".join(line).split()):
                lines.append(text)
            line.clear()

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif type(x) is str:
            line.append(x)
        elif not x.cut:
            if x.tag == "br":
                line.append(" ")
            elif x.tag in INLINE:
                todo.extend(reversed(x.items))
            else:
                end()
                todo.append(None)
                todo.extend(reversed(x.items))
    end()
    return "\n".join(lines)


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page or page.isspace():
        return ""
    root = parse(page)
    _cut(root)
    nodes = _order(root)
    _measure(nodes)
    return blocks(_kept(_best(root, nodes)))


def extract(docs: DataFrame, *, text: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns with the text of each page and its code points; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, pages in text_parts(b.column(len(keep))):
                out = [main_text(x) for x in pages]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, len(out)) for c in b.columns[: len(keep)]), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[*keep, "text", "n_chars"])

    chosen = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{schema}, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
