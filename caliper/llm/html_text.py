"""Main text of HTML pages by line-block distribution.

Markup is stripped to one line of text for each block element. A line weighs its characters without link text; a line of
page furniture (by element name or role) weighs nothing, and a change between containers of other density leaves empty lines.
A class name only raises a doubt: what it stands on weighs nothing unless its own lines are as dense in text and as poor in links
as an article's (see _lifted). Over windows of lines the weights are summed. A region ends where the window sum dives to nothing; it is
kept if the sum surges above the threshold in it, if it lies between two such regions and is no longer than one of them, or
if it heads one and is not mostly links. Marks of the main text shift the threshold: where article and main elements hold
most of the weight, any text surges inside that is not mostly links, and outside only what outweighs all of the inside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from caliper.llm.blocks import blocks

WINDOW = 3
#: Characters in a window from which text is taken for an article's; at most half of the page's largest window.
SURGE = 86

# HTML element and role names, and class names in common use for page furniture.
BLOCK = set("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
CONTAINER = set("article aside body div footer form header main nav section table ul ol dl html".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
HIDDEN = set("script style noscript template iframe svg canvas object button select textarea dialog audio video head title datalist".split())
FURNITURE = set("nav header footer aside form menu".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
FURNITURE_CLASSES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay comment comments discussion disqus replies reply responses respond share sharing social related recommended newsletter subscribe subscription signup login toolbar pagination pager masthead skip".split())
FURNITURE_WHOLE = set("bottom header footer site-header site-footer page-header page-footer global-header global-footer aside form".split())
#: Words that may stand beside one of FURNITURE_CLASSES in the name of a class.
STRUCTURE = set("site page global main primary secondary top bottom left right upper lower inner outer box list item items area container wrapper wrap block section widget bar bars link links button buttons form text title content unit slot panel group row column col body thread count tools icons media posts stories articles to user users reader readers visitor visitors".split())
#: Of FURNITURE_CLASSES those that also name parts of an article, and those that also name what a whole one is about.
PART_CLASSES = set("discussion response responses menu".split())
TOPIC_CLASSES = PART_CLASSES | set("cookie cookies related social share".split())
#: Names of the parts of a reader's comment.
IN_COMMENTS = set("comment comments commenter reply replies author avatar username vcard vote votes karma".split())

# Where HTML ends an element without its end tag, and the elements that keep an end from reaching further out.
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = set("head base basefont bgsound link meta noframes noscript script style template title html".split())
ENDS_P = HEADINGS | set("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SCOPE = set("table td th caption object template".split())
P_SCOPE = SCOPE | {"button"}
TABLE_SCOPE = {"table", "template"}
LIST_SCOPE = SCOPE | {"ul", "ol", "menu", "dir"}
IN_TABLE = set("table caption colgroup tbody td tfoot th thead tr".split())
_ITEM_SCOPE = LIST_SCOPE | set("article aside blockquote body center details dl fieldset figure footer form header main nav section".split())
_ROWS = {"tbody", "thead", "tfoot", "caption", "colgroup"}
#: For a start tag, the elements that it ends and those within which it looks for them.
SIBLINGS = (
    {"li": ({"li"}, _ITEM_SCOPE | {"dd", "dt"}), "tr": ({"tr", "caption", "colgroup"}, TABLE_SCOPE), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"})}
    | dict.fromkeys(("dd", "dt"), ({"dd", "dt"}, _ITEM_SCOPE | {"li"}))
    | dict.fromkeys(("td", "th"), ({"td", "th"}, TABLE_SCOPE | {"tr"}))
    | dict.fromkeys(("tbody", "thead", "tfoot"), (_ROWS | {"tr"}, TABLE_SCOPE))
)
FOREIGN = {"svg", "math"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Line(NamedTuple):
    text: str
    weight: int  #: characters that are not link text; 0 in furniture
    heading: bool
    kind: str  #: "furniture", "inside" or "outside" the trusted article or main, "text" if none is, or "gap"
    box: int = -1  #: number of the container


_GAP = [Line("", 0, False, "gap")] * WINDOW


_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _compound(word: str) -> bool:
    """Whether a word of at most 40 letters is put together of FURNITURE_CLASSES and STRUCTURE, one of the former among them."""
    ends = {0: False}  # place -> whether a word of FURNITURE_CLASSES leads there
    for at in range(len(word) if len(word) <= 40 else 0):
        if at in ends:
            for to in range(at + 3, min(at + 16, len(word)) + 1):
                part = word[at:to]
                if part in FURNITURE_CLASSES or part in STRUCTURE:
                    ends[to] = ends.get(to, False) or ends[at] or part in FURNITURE_CLASSES
    return ends.get(len(word), False)


def _sentence(text: str) -> bool:
    """Whether a line has three words and more and ends like a sentence."""
    return len(text[:200].split(None, 3)) > 2 and text[-200:].rstrip("\"'\u201d\u00bb)")[-1:] in (".", "!", "?", "\u2026")


def _parts(name: str) -> list[str]:
    """The words of a class or id: "cookieBanner" and "cookie-banner" have two."""
    return [x for x in re.split(r"[-_\d]+", _CAMEL.sub("-", name).lower()) if x]


@lru_cache(1 << 14)
def _doubt(name: str) -> str:
    """What a class or id says of its element: "furniture" if it names furniture as a whole ("cookie-notice", "commentlist" and
    "share-buttons" do, "share-price" does not), one of TOPIC_CLASSES if it is no more than that, or ""."""
    parts = _parts(name)
    if "-".join(parts) in FURNITURE_WHOLE:
        return "furniture"
    named = [x for x in parts if x in FURNITURE_CLASSES or (x not in STRUCTURE and _compound(x))]
    if not named or not all(x in named or x in STRUCTURE for x in parts):
        return ""
    return parts[0] if parts[0] in TOPIC_CLASSES and all(x in ("section", "text", "content") for x in parts[1:]) else "furniture"


@lru_cache(1 << 14)
def _of_comments(name: str) -> bool:
    return not IN_COMMENTS.isdisjoint(_parts(name))


def _kind_of(name: str, attributes: str) -> tuple[str, bool]:
    """"hidden", "furniture", what its classes say of it (see _doubt) or "text" for an element by itself; and whether its
    class is that of a part of a comment."""
    if name in HIDDEN:
        return "hidden", name in ("textarea", "button")
    a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes and name not in ("html", "body", "main") else {}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "").lower()):
        return "hidden", False
    names = f"{a.get('class', '')} {a.get('id', '')}".split()
    comment = name == "form" or any(map(_of_comments, names))
    if name in FURNITURE or a.get("role", "").lower() in FURNITURE_ROLES:
        return "furniture", comment
    doubts = set(map(_doubt, names))
    doubts.discard("")
    return ("named" if "furniture" in doubts else min(doubts, default="text")), comment


class Doubt:
    """A part of the page whose class names furniture, and what its lines turn out to be."""

    def __init__(self, name: str, within: bool):
        self.name, self.within, self.comments = name, within, False
        self.lines: list[int] = []


def _lifted(doubts: list[Doubt], lines: list[Line], full: list[int]) -> list[Doubt]:
    """The parts that are text after all: their class is one of TOPIC_CLASSES, nothing in them belongs to comments, and they hold
    several lines that are long and no links. For PART_CLASSES within an article or main that is enough;
    elsewhere they must be longer, and the page without them must hold no such text in any window."""
    out, rest = [], []
    for d in doubts:
        size, chars = sum(full[i] for i in d.lines), sum(len(lines[i].text) for i in d.lines)
        if d.name in TOPIC_CLASSES and not d.comments and len(d.lines) >= 2 and 5 * (chars - size) <= chars and size >= 2 * SURGE:
            if d.within and d.name in PART_CLASSES:
                out.append(d)
            elif len(d.lines) >= 3 and size >= 4 * SURGE:
                rest.append(d)
    peak = max((sum(x.weight for x in lines[i : i + WINDOW]) for i in range(len(lines))), default=0)
    return out + [d for d in rest if peak < SURGE]


def page_lines(page: str) -> list[Line]:
    """A line for each block in page order. WINDOW empty lines part two containers, neither within the other, if one is dense
    in text and the other is not. <article> and <main> are trusted if their lines hold most of the page's weight.

    Within an article another one is a reader's comment, and of a header its headings belong to the text. Open elements are on a stack, as HTML parsers keep them: an element ends at its end tag, at that of an ancestor and
    where HTML lets its end tag be left out."""
    lines: list[Line] = []
    marked: list[int] = []  # places of the lines within <article> or <main>
    parents = [-1]  # of each container; a container comes after its parent
    looks = [""]  # name and attributes of each container
    boxes: list[tuple[int, int]] = []  # open containers: place on the stack, number
    body = {0}  # numbers of the containers html and body
    text: list[str] = []
    linked = 0
    stack: list[str] = []
    where: dict[str, list[int]] = {}  # places on the stack of each name
    blocks: list[int] = []  # places on the stack of BLOCK elements
    skip = -1  # place on the stack of the hidden element that is being left out
    shade = -1  # place on the stack of the furniture element that is being weighed as nothing
    headed = False  # whether that is an article's own header
    soft = -1  # place on the stack of the element that a class names furniture
    doubts: list[Doubt] = []
    full: list[int] = []  # the weight of each line, were it not for that class

    def last(names) -> int:
        return max((where[x][-1] for x in names if where.get(x)), default=-1)

    def push(name: str, attributes: str) -> None:
        where.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        if name in CONTAINER and skip < 0:
            parents.append(boxes[-1][1] if boxes else 0)
            looks.append(f"{name} {attributes.strip()}")
            boxes.append((len(stack), len(parents) - 1))
            if name in ("html", "body"):
                body.add(len(parents) - 1)
        stack.append(name)

    def close(to: int) -> None:
        """Ends the element at this place and all in it; none for -1."""
        nonlocal skip, shade, soft
        while 0 <= to < len(stack):
            name = stack.pop()
            if name:
                where[name].pop()
            if name in BLOCK:
                blocks.pop()
        while boxes and boxes[-1][0] >= len(stack):
            boxes.pop()
        if skip >= len(stack):
            skip = -1
        if shade >= len(stack):
            shade = -1
        if soft >= len(stack):
            soft = -1

    def forget(at: int) -> None:
        """Ends an inline element but not the blocks in it."""
        where[stack[at]].pop()
        stack[at] = ""

    def imply(name: str) -> None:
        """Ends the open elements that the start of one of this name ends."""
        if where.get("head") and name not in IN_HEAD:
            close(where["head"][-1])
        if name in ENDS_P and last(("p",)) > last(P_SCOPE):
            close(last(("p",)))
        if name in SIBLINGS:
            same, scope = SIBLINGS[name]
            while (found := last(same)) > last(scope):
                close(found)
        if name in HEADINGS and stack and stack[-1] in HEADINGS:
            close(len(stack) - 1)
        if name == "main" and shade >= 0 and stack[shade] in ("nav", "header", "footer", "aside"):  # none may hold a main
            close(shade)
        if name == "a" and where.get("a"):
            close(where["a"][-1]) if where["a"][-1] in (skip, shade, soft) else forget(where["a"][-1])

    def end(name: str) -> None:
        found = last((name,))
        if found < 0 or found < last(TABLE_SCOPE if name in IN_TABLE else LIST_SCOPE if name == "li" else P_SCOPE if name == "p" else SCOPE - {name}):
            return
        if name not in BLOCK and found not in (skip, shade, soft) and blocks and blocks[-1] > found:
            forget(found)
        else:
            close(found)

    def end_block() -> None:
        nonlocal linked
        line = " ".join("".join(text).split())
        if line:
            heading = any(where.get(x) for x in HEADINGS)
            text_line = shade < 0 or (headed and heading)
            if text_line and (where.get("article") or where.get("main")):
                marked.append(len(lines))
            full.append(max(0, len(line) - linked) if text_line else 0)
            if text_line and soft >= 0:
                doubts[-1].lines.append(len(lines))
                text_line = False
            lines.append(Line(line, full[-1] if text_line else 0, heading, "text" if text_line else "furniture", boxes[-1][1] if boxes else 0))
        text.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if skip >= 0 and stack[-1] == "head" and not raw.isspace() and raw:  # text opens the body
            close(len(stack) - 1)
        if raw and skip < 0:
            plain = html.unescape(raw)
            text.append(plain)
            if where.get("a"):
                linked += len(" ".join(plain.split()))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if skip < 0 and name not in HIDDEN:
                put(page[at : stop.start() if stop else n])
            at = (page.find(">", stop.start()) + 1 if stop else n) or n
            continue
        if skip < 0 and (name in BLOCK or (closing and any(x >= 0 and stack[x] == name for x in (shade, soft)))):
            end_block()
        if closing:
            end(name)
            continue
        imply(name)
        if name in VOID or (m[3].endswith("/") and (name in FOREIGN or any(where.get(x) for x in FOREIGN))):
            if name == "br":
                put(" ")
            continue
        kind, of_comments = _kind_of(name, m[3]) if skip < 0 else ("text", False)
        if soft >= 0 and (of_comments or name == "article"):
            doubts[-1].comments = True
        if kind == "hidden":
            end_block()
            skip = len(stack)
        elif shade < 0 and (kind == "furniture" or (name == "article" and where.get("article"))):
            end_block()
            shade, headed = len(stack), name == "header" and bool(where.get("article"))
        elif shade < 0 and soft < 0 and kind not in ("text", "furniture"):
            end_block()
            soft = len(stack)
            doubts.append(Doubt(kind, bool(where.get("article") or where.get("main"))))
        push(name, m[3])
    end_block()
    for d in _lifted(doubts, lines, full):
        for i in d.lines:
            lines[i] = lines[i]._replace(weight=full[i], kind="text")
    inside = [False] * len(lines)
    for i in marked:
        inside[i] = lines[i].kind != "furniture"
    own = [x for x in lines if x.kind == "text"]
    weight = [0 if x.kind == "furniture" else x.weight if any(y.weight for y in own) else len(x.text) for x in lines]
    if 2 * sum(w for w, x in zip(weight, inside, strict=True) if x) > sum(weight):
        lines = [x if x.kind == "furniture" else x._replace(kind="inside" if i else "outside") for x, i in zip(lines, inside, strict=True)]
    return _parted(lines, parents, body, looks)


def _parted(lines: list[Line], parents: list[int], body: set[int], looks: list[str]) -> list[Line]:
    """lines with WINDOW empty ones between branches of other density. A branch of one line beside two or more dense ones of
    the same container is a paragraph of theirs; in the body, where footers stand too, only a sentence whose tag looks like theirs."""
    size, count, depth = [0] * len(parents), [0] * len(parents), [0] * len(parents)
    sentence = [True] * len(parents)
    for line in lines:
        if line.kind != "furniture":
            sentence[line.box] = _sentence(line.text)
            size[line.box] += line.weight
            count[line.box] += 1
    for box in range(len(parents) - 1, 0, -1):
        size[parents[box]] += size[box]
        count[parents[box]] += count[box]
    for box in range(1, len(parents)):
        depth[box] = depth[parents[box]] + 1
    dense = [k > 0 and n * WINDOW >= SURGE * k for n, k in zip(size, count, strict=True)]
    dense_children = [0] * len(parents)
    dense_looks: dict[tuple[int, str], int] = {}
    for box in range(1, len(parents)):
        dense_children[parents[box]] += dense[box]
        dense_looks[parents[box], looks[box]] = dense_looks.get((parents[box], looks[box]), 0) + dense[box]

    def alike(box: int) -> bool:
        paragraph = count[box] == 1 and size[box] > 0 and (parents[box] not in body or sentence[box])
        near = dense_looks.get((parents[box], looks[box]), 0) if parents[box] in body else dense_children[parents[box]]
        return dense[box] or (paragraph and near > 1)

    out = lines[:1]
    for line, x, y in zip(lines[1:], (x.box for x in lines), (x.box for x in lines[1:]), strict=False):
        if x != y:
            a, b = -1, -1  # the branches below the nearest common container
            while x != y:
                if depth[x] >= depth[y]:
                    a, x = x, parents[x]
                else:
                    b, y = y, parents[y]
            if a >= 0 and b >= 0 and alike(a) != alike(b):
                out += _GAP
        out.append(line)
    return out


def _regions(lines: list[Line]) -> list[list[Line]]:
    """Runs of lines of one kind, parted by the gaps and by furniture that does not stand in the midst of one container;
    WINDOW or more lines that weigh nothing are runs of their own."""
    runs: list[list[Line]] = []
    flow: list[Line] = []  # the run that is open
    for kind, group in groupby(lines, lambda x: x.kind):
        run = list(group)
        if kind == "furniture":
            runs.append(run)
        elif kind != "gap":
            if not (flow and flow[-1].kind == kind and flow[-1].box == run[0].box):
                runs.append(flow := [])
            flow += run
        else:
            flow = []
    regions: list[list[Line]] = []
    for run in runs:
        region: list[Line] = []
        for weighty, group in groupby(run, lambda x: x.weight > 0):
            part = list(group)
            if not weighty and len(part) >= WINDOW:
                regions += [region, part]
                region = []
            else:
                region += part
        regions.append(region)
    return [r for r in regions if r]


def _surging(regions: list[list[Line]]) -> list[int]:
    """The regions, by place, that the window sums tell to be the main text."""
    kind = [r[0].kind for r in regions]
    length = [sum(len(x.text) for x in r) for r in regions]
    own = [0 if k == "furniture" else sum(len(x.text) if x.heading else x.weight for x in r) for r, k in zip(regions, kind, strict=True)]  # a heading may be a link
    peaks = [max(sum(x.weight for x in r[i : i + WINDOW]) for i in range(len(r))) for r in regions]
    most = max((p for p, k in zip(peaks, kind, strict=True) if k in ("inside", "text")), default=0)
    surge = min(SURGE, max(1, most / 2))
    least = {"inside": surge, "text": surge, "outside": most + 1, "furniture": 1}
    strong = [i for i, peak in enumerate(peaks) if peak >= least[kind[i]] or (not most and kind[i] in ("inside", "text"))]
    kept = set(strong)
    for before, after in zip([-1, *strong], strong, strict=False):
        weak = [i for i in range(before + 1, after) if kind[i] in ("inside", "text")]
        for i in weak:
            mostly_links = 2 * own[i] < length[i]
            between = before >= 0 and length[i] <= max(length[before], length[after]) and (not mostly_links or len(regions[i]) <= 2 * WINDOW)
            if between or (i == weak[-1] and not mostly_links):  # what heads a region
                kept.add(i)
    kept.update(i for i, k in enumerate(kind) if k == "inside" and 2 * own[i] >= length[i])  # there any text surges
    return sorted(kept)


def main_text(page: str | None) -> str:
    """The page's main text: blocks joined by an empty line, white space in a block one space; null, empty: ''."""
    regions = _regions(page_lines(page)) if page else []
    return "\n\n".join(x.text for i in _surging(regions) for x in regions[i])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of pages (page_id, url, html): whole pages, no shuffle, other columns ignored.

    A null or empty page and one without text give the empty text. Repeated rows are extracted each, null ids and urls kept;
    no pages give no rows. A page is held by one task, whatever its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x.as_py()) for x in part.column(2)], pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
