"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, prepare, released

#: Elements that begin and end a line, those that hold regions, and those that are no main text.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
REGIONS = frozenset("article main section div td body".split())
NOT_TEXT = frozenset("script style noscript template head title nav footer aside form button select textarea iframe object svg canvas audio video map menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out, what a new one ends, and what such an end doesn't reach over.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol menu dl table select html".split())
#: Elements beyond which an end tag ends nothing.
WALLS = frozenset("html table td th caption object template".split())
#: End tags that reach beyond walls, and what begins a tag.
UNWALLED = WALLS | SCOPES | {"tr", "body", "tbody", "tfoot", "thead"}
UNFINISHED = re.compile("<[a-zA-Z/!?]")
#: Roles, and words of class and id, that mark what is no main text wherever they stand in a name.
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form".split())
MARKS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promotion cookie cookies consent gdpr popup modal nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar newsletter disqus".split())
READERS = frozenset("comment comments commentlist reply replies respond".split())
#: Words that also mean something else: beside words that are neither of these nor of the next line, they mark nothing.
DOUBTFUL = frozenset("ad consent menu".split())
BESIDE = frozenset("banner bar dropdown google header footer item items label leaderboard mobile desktop nav rectangle slot space sub toggle unit widget zone".split())
#: Words that mark it only in names made of nothing but them and the plain words.
WEAK = frozenset("header footer masthead banner search notice notices alert overlay widget widgets related share sharing social subscribe subscription signup login toolbar".split())
PLAIN = frozenset("site page global top bottom left right main form box list section bar links link buttons button area wrap wrapper container block inner outer primary secondary js the".split())
ARTICLES = ("article", "main")
SPLIT = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])").split


@lru_cache(4096)
def marked(name: str, within: str) -> bool:
    """Whether a class or id says that the element isn't main text; an article is left out as a reader's comment only."""
    words = [w.lower() for w in SPLIT(name) if w]
    if within == "article":
        return len(words) == 1 and words[0] in READERS
    known = all(w in MARKS or w in WEAK or w in PLAIN or w in BESIDE or w.isdigit() for w in words)
    if any(w in READERS or w in MARKS and (known or w not in DOUBTFUL) for w in words):
        return True
    return any(w in WEAK for w in words) and all(w in WEAK or w in PLAIN or w.isdigit() for w in words)


class Lines(HTMLParser):
    """Turns parser events into lines: (text, number of tags, innermost open region or -1); left-out elements give none.

    Regions are numbered as they begin, so a region's inner ones have the numbers from its own to ``ends`` of it. The
    places of open elements are kept by name: no event walks through open elements, but to end them.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.open: list[tuple[str, int, bool]] = []  # name, the innermost region before it, left out
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.out, self.text, self.tags, self.region = 0, [], 0, -1

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.region))
            self.tags = 0
        self.text = []

    def sorts(self, tag: str, left: bool) -> list[str]:
        """Under which names an open element's place is kept: its own, and what it is for others."""
        return [tag, *(k for k, x in (("(block)", tag in BLOCKS), ("(stop)", tag in BLOCKS or tag in SCOPES), ("(wall)", tag in WALLS), ("(left)", left)) if x)]

    def nearest(self, names: Iterable[str]) -> int:
        """The innermost open element with one of the names, or -1."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def shut(self, at: int) -> None:
        """End the open elements from place ``at`` on."""
        for tag, region, left in reversed(self.open[at:]):
            self.out -= left
            for name in self.sorts(tag, left):
                self.places[name].pop()
            while self.region != region:
                self.ends[self.region] = len(self.kinds) - 1
                self.region = self.parents[self.region]
        del self.open[at:]

    def left_out(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NOT_TEXT:
            return True
        if tag in ("html", "body", "main"):
            return False
        if tag == "header" and self.nearest(ARTICLES) < 0:
            return True
        for k, v in attrs:
            if v and k in ("class", "id") and any(marked(name, tag) for name in v.split()):
                return True
            if v and k == "role" and tag != "article" and v.strip().lower() in ROLES:
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            if tag != "br" and self.open:
                self.implied(tag)
        if tag in VOID:
            return
        if tag in ("body", "main", "article"):
            # a head never ends inside the page, nor does main stand within what is left out: an end tag is missing
            first = [self.places[n][0] for n in ("head", *["(left)"] * (tag == "main")) if self.places[n]]
            if first:
                self.shut(min(first))
        left = self.left_out(tag, attrs)
        for name in self.sorts(tag, left):
            self.places[name].append(len(self.open))
        self.open.append((tag, self.region, left))
        self.out += left
        if tag in REGIONS and not left:
            self.kinds.append(tag)
            self.parents.append(self.region)
            self.ends.append(-1)
            self.region = len(self.kinds) - 1

    def implied(self, tag: str) -> None:
        """End what a block that begins ends by itself: an open paragraph, the list item or table cell before it."""
        ends = ENDS.get(tag, ())
        stops = ("p", *ends, *SCOPES, *((WALLS & BLOCKS) if tag != "tr" else ())) if ends else ("(stop)",)
        while (k := self.nearest(stops)) >= 0:
            name = self.open[k][0]
            if name != "p" and name not in ends:
                return
            self.shut(k)
            if not ends or name != "p" and (tag != "tr" or name == "tr"):
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        block = tag in BLOCKS
        if block:
            self.flush()
        at = self.nearest((tag,))
        between = [*["(wall)"] * (tag not in UNWALLED), *["(block)"] * (not block)]
        if at >= 0 and self.nearest(between) <= at:
            self.shut(at)  # else an end tag without its beginning

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.text.append(data)


def smooth(values: list[float], radius: int = 2) -> list[float]:
    """Gaussian smoothing; the kernel ends at the page's ends and is normalised there."""
    kernel = [math.exp(-(j * j) / (2 * radius)) for j in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        a, b = max(0, i - radius), min(len(values), i + radius + 1)
        w = kernel[a - i + radius : b - i + radius]
        out.append(sum(x * y for x, y in zip(values[a:b], w, strict=True)) / sum(w))
    return out


def limit_of(values: list[float], factor: float = 0.5) -> float:
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return min(factor * spread, mean)


def cluster(values: list[float], factor: float = 0.5) -> list[bool]:
    """Content or not: over ``factor`` times the standard deviation, or over the mean if all are much alike."""
    limit = limit_of(values, factor)
    return [v >= limit for v in values]


def read_lines(html: str) -> Lines:
    """The parsed page. A tag that the page's end cuts off is no text; the parser would look for its end again and again."""
    rest = html.rfind(">") + 1
    cut = UNFINISHED.search(html, rest)
    parser = Lines()
    parser.feed(html[: cut.start()] if cut else html)
    parser.close()
    parser.flush()
    parser.shut(0)
    return parser


def extract(html: str) -> str:
    """Main text of one page, empty if none.

    Lines come from block elements; each has its text-to-tag ratio, which is smoothed over neighbours and clustered by
    a threshold. The characters of content lines vote for the regions around them. If an article or main element has at
    least half of all votes, the one with most is the main region, or an inner one with at least half of its votes that
    no other article stands beside; all its lines count, short ones too.

    Else the main regions are the smallest one with nearly all votes and, so that no part of a split text is lost, those
    right around lines that are content by their own ratio, not only by their neighbours', and the smallest one around
    all of these. All their lines count, and so do those between the first and the last of them. The body as a whole is
    no main region: if none has nearly all votes, lines from the first content line to the last count instead of it.

    Time and memory grow with the page, however deep its elements are nested.
    """
    parser = read_lines(html)
    lines, kinds, parents, ends = parser.lines, parser.kinds, parser.parents, parser.ends
    if not lines:
        return ""
    ratios = [len(t) / max(1, n) for t, n, _ in lines]
    smoothed = smooth(ratios)
    content = cluster(smoothed)
    votes, held = [0] * (len(kinds) + 1), [0] * (len(kinds) + 1)  # of regions and what is in them; the last is no region
    for (text, _, region), good in zip(lines, content, strict=True):
        votes[region] += good * len(text)
        held[region] += 1
    total = sum(votes)
    for r in range(len(kinds) - 1, -1, -1):
        votes[parents[r]] += votes[r] if parents[r] >= 0 else 0
        held[parents[r]] += held[r] if parents[r] >= 0 else 0
    regions = range(len(kinds))
    articles = [r for r in regions if votes[r] and kinds[r] in ARTICLES and 2 * votes[r] >= total]
    if articles:
        best = max(articles, key=lambda r: (votes[r], r))
        within = [r for r in range(best + 1, ends[best] + 1) if held[r] and kinds[r] in ARTICLES]
        if len(within) == 1 and 2 * votes[within[0]] >= votes[best]:
            best = within[0]
        return " ".join(t for t, _, region in lines if best <= region <= ends[best])
    if not total:
        return ""
    limit = limit_of(smoothed)
    firm = [x and v >= limit for x, v in zip(content, ratios, strict=True)]
    inner = [-1] * len(kinds)  # the innermost region that isn't the body
    for r in regions:
        inner[r] = r if kinds[r] != "body" else inner[parents[r]] if parents[r] >= 0 else -1
    around = [inner[region] if region >= 0 else -1 for (_, _, region), x in zip(lines, firm, strict=True) if x]
    main = max((r for r in regions if votes[r] >= 0.8 * total and kinds[r] != "body"), default=-1)
    chosen = {r for r in around if r >= 0} | {main} - {-1}
    if around and min(around) >= 0:
        r, last = min(around), max(around)
        while r >= 0 and ends[r] < last:
            r = inner[parents[r]] if parents[r] >= 0 else -1
        chosen |= {r} - {-1}
    reach, covered = -1, [False] * (len(kinds) + 1)
    for r in regions:
        reach = max(reach, ends[r]) if r in chosen else reach
        covered[r] = r <= reach
    alone = content if main < 0 else firm
    kept = [i for i, (x, (_, _, region)) in enumerate(zip(alone, lines, strict=True)) if x or covered[region]]
    return " ".join(t for t, _, _ in lines[kept[0] : kept[-1] + 1])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages``, from its whole html, without a shuffle.

    A null html counts as empty; a page without main text has an empty one. Broken markup is read as far as it goes.
    Null or repeated page_ids and rows are kept as they come; other columns are ignored.
    """
    prepare(pages.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(v.as_py() or "") for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
