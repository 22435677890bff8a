"""Main text of web pages from parser events and the text-to-tag ratio of lines.

The standard library's parser streams events; block elements cut the text into
lines, each with its number of characters and of tags. A line's ratio of
characters to tags is smoothed with a Gaussian over its neighbours, and lines
whose smoothed ratio is above a share of the ratios' deviation form clusters of
content. Content lines vote, by their length, for all elements that hold them;
the region is the innermost element with nearly all votes, wider if what stands
around it is content as well, or an article or main element with most of them.
All lines of the region are kept, short ones between and beside the clusters too.

Kinds, roles, classes and ids of elements are features that the votes can
overrule. What they mark as no article text weighs little in the ratios, and goes
from the region unless it holds half of the page's votes (what is named for
readers' comments: nearly all; navigation and footers always go). Weak marks, which layouts use for
content too, go only if most of their own text is outside the clusters. Without
a line left, the content lines stay. Only markup is never text: scripts, styles,
the head, controls and embedded objects.

Defined results: null and empty pages and pages without text give an empty
text; unclosed, stray and malformed tags and declarations are allowed; of
regions with equal votes the inner, then the later one counts; repeated rows get
equal texts; very long and very deep pages take time in proportion to their
length; an empty table gives an empty table; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
MARKUP = frozenset("head title script style noscript template button select option textarea iframe object svg canvas math audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = ("article", "main")
CONTAINERS = frozenset("article main section div td form body".split())
#: What closes an open p, li and the like, and where the search for it ends.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "select")
AROUND_P = ("td", "th", "li", "div", "article", "section", "body", "blockquote")
AROUND_INLINE = ("p", "li", "td", "div", "article")
#: Features: kinds, roles and words of class and id that mark what is no article text. Lowest share of the votes to stay.
HALF, NEARLY_ALL, NEVER = 0.5, 0.9, 2.0
MARKED_KINDS = {"form": HALF, "header": HALF, "dialog": HALF, "aside": NEARLY_ALL, "nav": NEVER, "footer": NEVER, "menu": NEVER}
MARKED_ROLES = {"form": HALF, "search": HALF, "banner": HALF, "dialog": HALF, "alertdialog": HALF, "alert": HALF, "complementary": NEARLY_ALL, "navigation": NEVER, "contentinfo": NEVER, "menu": NEVER, "menubar": NEVER, "toolbar": NEVER}
MARKED_NAMES = dict.fromkeys("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager".split(), HALF) | dict.fromkeys("comment comments reply replies disqus".split(), NEARLY_ALL)
WEAK_NAMES = frozenset("header banner widget toolbar discussion".split())
#: Weight of a marked line's ratio.
FAINT = 0.25
WIDTH = 2
SHARE = 0.5


@dataclass
class Node:
    """An element that may hold a region or bears a mark."""

    parent: int
    kind: str
    need: float = 0.0  # share of votes to stay
    weak: bool = False
    votes: float = 0.0
    letters: float = 0.0
    inside: float = 0.0  # letters in content lines
    titled: bool = False


class Lines(HTMLParser):
    """Collects lines (text, tags, node, heading) and the tree of nodes; nodes are numbered from the outside in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node(-1, "")]
        self.lines: list[tuple[str, int, int, bool]] = []
        self.open: list[tuple[str, int, bool]] = []  # name, node, hidden
        self.where: dict[str, list[int]] = defaultdict(list)  # places of each name in open
        self.parts: list[str] = []
        self.tags = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections are no HTML: a comment up to the next >."""
        end = self.rawdata.find(">", i)
        return -1 if end < 0 else end + 1

    def unknown_decl(self, data: str) -> None:
        pass

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            name, node, hidden = self.open[-1] if self.open else ("", 0, False)
            if not hidden:
                self.lines.append((text, self.tags, node, any(self.where[h] for h in HEADINGS)))
            self.tags = 0

    def inside(self, *names: str) -> bool:
        return any(self.where[n] for n in names)

    def mark(self, name: str, given: dict) -> tuple[float, bool]:
        """The share of votes that an element needs to stay, and whether its mark is weak."""
        words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{given.get('class', '')} {given.get('id', '')}").lower()))
        found = [MARKED_NAMES[w] for w in words & MARKED_NAMES.keys()]
        if name in ("html", "body", *REGIONS):
            return (max(found) if words & {"comment", "comments"} else 0.0), False
        if name in MARKED_KINDS and not (name == "header" and self.inside(*REGIONS)):
            found.append(MARKED_KINDS[name])
        role = given.get("role", "").lower()
        if role in MARKED_ROLES:
            found.append(MARKED_ROLES[role])
        return max(found, default=0.0), bool(words & WEAK_NAMES)

    def pop(self, name: str, bound: tuple[str, ...] = ()) -> None:
        """Close the last open name with all it holds, unless one of bound was opened since."""
        if self.where[name] and self.where[name][-1] >= max((self.where[b][-1] for b in bound if self.where[b]), default=-1):
            for _ in range(len(self.open) - self.where[name][-1]):
                self.where[self.open.pop()[0]].pop()

    def handle_starttag(self, name: str, attrs: list) -> None:
        if name == "br":
            self.parts.append(" ")
        if name in BLOCK:
            self.cut()
            self.pop("p", AROUND_P)
            for old in CLOSED_BY.get(name, ()):
                self.pop(old, LISTS)
        self.tags += 1
        if name in VOID:
            return
        given = {k: v or "" for k, v in attrs}
        _, node, hidden = self.open[-1] if self.open else ("", 0, False)
        hidden = hidden or name in MARKUP or "hidden" in given or given.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")))
        need, weak = self.mark(name, given)
        if name in CONTAINERS or need or weak:
            self.nodes.append(Node(node, name, need, weak))
            node = len(self.nodes) - 1
        if name == "h1" and self.inside(*REGIONS):
            self.nodes[node].titled = True
        self.where[name].append(len(self.open))
        self.open.append((name, node, hidden))

    def handle_startendtag(self, name: str, attrs: list) -> None:
        self.handle_starttag(name, attrs)
        if name in ("svg", "path"):
            self.pop(name)

    def handle_endtag(self, name: str) -> None:
        self.tags += 1
        if name in BLOCK:
            self.cut()
        if name not in VOID:
            self.pop(name, () if name in BLOCK else AROUND_INLINE)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def smoothed(ratios: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Means of the ratios under a Gaussian of the given width, cut at the ends."""
    weight = np.exp(-(np.arange(-3 * width, 3 * width + 1) ** 2) / (2.0 * width**2))
    around = slice(3 * width, 3 * width + len(ratios))
    return np.convolve(ratios, weight, "full")[around] / np.convolve(np.ones(len(ratios)), weight, "full")[around]


def content_lines(ratios: np.ndarray, width: int = WIDTH, share: float = SHARE) -> np.ndarray:
    """Which lines are in a cluster: smoothed ratio of at least share of the standard deviation (all, if nothing varies)."""
    return smoothed(ratios, width) >= share * ratios.std()


def count_votes(nodes: list[Node], lines: list[tuple], content: np.ndarray) -> float:
    """Add the lines' votes and letters to their nodes and all that hold those; the sum of the votes."""
    for (text, _, node, _), c in zip(lines, content, strict=True):
        nodes[node].letters += len(text)
        nodes[node].votes += len(text) if c else 0.0
    # Children have larger numbers than their parents.
    for n in reversed(nodes[1:]):
        up = nodes[n.parent]
        up.votes, up.letters, up.titled = up.votes + n.votes, up.letters + n.letters, up.titled or n.titled
    return nodes[0].votes


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    nodes, lines = parser.nodes, parser.lines
    if not lines:
        return ""
    faint = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        faint[i] = faint[n.parent] or n.need > 0
    ratios = np.array([len(text) / max(1, tags) for text, tags, _, _ in lines])
    weighed = ratios * np.where([faint[x[2]] for x in lines], FAINT, 1.0)
    content = content_lines(weighed)
    # Clusters by the bare ratios overrule marks: their votes decide what stays.
    total = count_votes(nodes, lines, content_lines(ratios) if content.any() else np.ones(len(lines), dtype=bool))
    gone = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        weak = n.weak and not n.titled and n.votes < HALF * n.letters
        marked = n.need > 0 and n.votes < n.need * total and not (n.titled and n.need <= HALF)
        gone[i] = gone[n.parent] or ((weak or marked) and n.votes < max(n.need, HALF) * total)
    left = [k for k, x in enumerate(lines) if not gone[x[2]]]
    if not left:
        never = [False] * len(nodes)
        for i, n in enumerate(nodes[1:], 1):
            never[i] = never[n.parent] or n.need == NEVER
        return "\n".join(x[0] for x, c in zip(lines, content, strict=True) if c and not never[x[2]])
    lines, content, weighed = [lines[k] for k in left], content[left], weighed[left]
    region = best_region(nodes, lines, content, weighed)
    within = [i == region for i in range(len(nodes))]
    for i, n in enumerate(nodes[1:], 1):
        within[i] = within[i] or within[n.parent]
    return "\n".join(text for text, _, node, _ in lines if within[node])


def best_region(nodes: list[Node], lines: list[tuple], content: np.ndarray, weighed: np.ndarray) -> int:
    """The number of the node whose lines are the text."""
    for n in nodes:
        n.votes = n.letters = 0.0
    total = count_votes(nodes, lines, content if content.any() else np.ones(len(lines), dtype=bool))
    named = [i for i, n in enumerate(nodes) if n.kind in REGIONS and n.votes >= HALF * total]
    if named:
        return max(named, key=lambda i: (nodes[i].votes, i))
    region = max(i for i, n in enumerate(nodes) if (i == 0 or n.kind in CONTAINERS) and n.votes >= NEARLY_ALL * total)
    # Wider as long as the lines that come in, headings apart, are content by their own ratio as well.
    least = SHARE * weighed.std()
    poor = [0] * len(nodes)
    for (text, _, node, heading), c, r in zip(lines, content, weighed, strict=True):
        poor[node] += 0 if c and (heading or r >= least) else len(text)
    for i in range(len(nodes) - 1, 0, -1):
        poor[nodes[i].parent] += poor[i]
    while region:
        up = nodes[region].parent
        if poor[up] > poor[region]:
            break
        region = up
    return region


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h or "") for h in batch.column(batch.num_columns - 1).to_pylist()]
            made = [*batch.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(made, [*keep, "text", "n_chars"])

    # Arrow batches pass the kept columns through as they are, whatever their type.
    rows = pages.select(*keep, F.col(html_col).cast("string"))
    kept = pages.select(*keep).schema
    return rows.mapInArrow(run, StructType([*kept.fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
