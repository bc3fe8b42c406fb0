"""Main-text extraction: streaming parser events, text-to-tag ratios, smoothing, clustering.

The standard library's parser streams events; no tree is built. Each block of text is one
line with its text-to-tag ratio. On every page the ratios are smoothed with a Gaussian and cut
in two clusters; the lines of the high cluster weigh regions, which the page's landmarks
(article, main) and boilerplate containers (nav, footer, adverts, ...) delimit. Landmarks are
evidence: they win unless the text outside them is far heavier. Every line of a selected
region is kept, short ones too, but for blocks of links.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import arrow_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Elements whose text is never content.
DROPPED = frozenset("script style noscript template head title iframe object embed svg annotation annotation-xml canvas audio video select option optgroup datalist button textarea input form fieldset nav aside footer dialog menu map progress meter".split())
LANDMARKS = frozenset(("article", "main"))
CONTAINERS = frozenset("section div td table body ul ol".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
#: Words that mark a container as something other than the article, where a name of its class or id has no word but these and PLACES.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar sidebar sidebars aside rail "
    "footer foot masthead topbar comment comments reply replies respond disqus share sharing social related recommended recommendations widget widgets copyright search login".split()
)
#: Words that say where or as what something stands, not what it holds.
PLACES = frozenset("a above after area bar before below block body bottom box card cell col column container content desktop entry first fixed float floating global group head inner item items js large last left link links list main mobile of page panel post primary reader right row secondary section side site slot small sticky story the title to top unit user users wrap wrapper your".split())
#: Words that mark an article element as something other than the article.
REPLIES = frozenset("comment comments reply replies related teaser promo".split())
#: As above, but only outside an article or main.
OUTER = frozenset(("header",))
#: Elements and words that often wrap a whole page: an article or main inside is content all the same.
FORMS, SOFT_TAGS = frozenset(("form", "fieldset")), frozenset(("header", "nav"))
SOFT_WORDS = frozenset("sidebar sidebars rail header nav menu banner search login top".split())
#: With one of these a word says how a page is laid out, not what the element holds.
NEUTRAL = frozenset("no has with without layout".split())
HARD, SOFT, FORM = 3, 2, 1
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SIGMA, KERNEL = 1.0, 3
#: What a character or a ratio in a landmark counts against one outside, and the links that make a block of links there.
LANDMARK_WEIGHT, LANDMARK_LINKS = 4, 3
#: Share of a block's characters in links beyond which it is a block of links.
LINKED = 0.4
#: Share of the page's weight with which a region is the place to look in.
WHOLE = 0.9


class Lines(HTMLParser):
    """Blocks of text with their tags, region and depth, from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int, tuple[int, int]]] = []  # tag, drop, landmark, region and the two counts before it
        # how many of each tag are open, of all and since each landmark still open, its own element included
        self.open_tags: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]
        self.hard = self.soft = self.form = self.landmarks = self.region = self.regions = 0
        self.parent, self.page = [0], {0}  # of each region its parent, and the regions of the page itself
        self.region_landmark = [0]  # the outermost landmark's region, 0 outside
        self.in_article = [False]
        self.text: list[str] = []
        self.tags = self.link = self.in_link = self.anchors = 0
        self.lines: list[tuple[str, int, int, int, bool, int]] = []  # text, tags, link characters, region, in a form, links

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append((line, self.tags, self.link, self.region, self.form > 0, self.anchors))
                self.tags = self.link = self.anchors = 0
            self.text = []

    def drop(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """HARD for what is never content, SOFT and FORM for what may wrap a page, 0 otherwise."""
        if tag in FORMS:
            return FORM
        if tag in SOFT_TAGS:
            return 0 if tag == "header" and self.landmarks else SOFT
        if tag in DROPPED:
            return HARD
        if not attrs or tag in INLINE and tag not in ("span", "a"):
            return 0
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return HARD
            if not value:
                continue
            if key == "role" and value.lower() in ROLES:
                return SOFT if value.lower() in ("form", "banner", "navigation", "search") else HARD
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                return HARD
            if key in ("class", "id") and tag not in ("body", "html", "main"):
                marks = REPLIES if tag == "article" else BOILERPLATE if self.landmarks else BOILERPLATE | OUTER
                names = [{w.lower() for w in WORDS.findall(name)} for name in value.split()]
                if any(words & NEUTRAL for words in names):
                    continue
                # a name that says more, as share-price-analysis does, is about its subject
                wrong = set().union(*[words & marks for words in names if words <= marks | PLACES])
                if wrong:
                    return SOFT if wrong <= SOFT_WORDS else HARD
        return 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if tag in ("p", "li", "b", "i", "em", "strong") and not attrs:
            return  # often left open, and they bound nothing
        drop = self.drop(tag, attrs)
        if tag in INLINE and not drop:
            if tag == "a":
                self.in_link += 1
                self.anchors += 1
            return
        self.flush()
        landmark = not drop and (tag in LANDMARKS or any(k == "role" and v in LANDMARKS for k, v in attrs))
        self.open.append((tag, drop, landmark, self.region, (self.soft, self.form)))
        if landmark:
            self.scopes.append(Counter())
        self.open_tags[tag] += 1
        self.scopes[-1][tag] += 1
        self.hard += drop == HARD
        self.soft += drop == SOFT
        self.form += drop == FORM
        if landmark:
            self.landmarks += 1
            self.soft = self.form = 0
            if tag == "main":
                self.in_link = 0  # a link left open before it
        elif tag not in CONTAINERS:
            return
        self.regions += 1
        self.parent.append(self.region)
        if tag == "body":
            self.page.add(self.regions)
        self.region_landmark.append(self.region_landmark[self.region] or (self.regions if landmark else 0))
        article = landmark and (tag == "article" or tag != "main" and any(k == "role" and v == "article" for k, v in attrs))
        self.in_article.append(article or self.in_article[self.region])
        self.region = self.regions

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        elif tag == "a" and self.in_link:
            self.in_link -= 1
        # a stray end tag does not close the article
        if not (self.open_tags if tag in ("body", "html", *LANDMARKS) else self.scopes[-1])[tag]:
            return
        self.flush()
        while True:
            last, drop, landmark, region, soft = self.open.pop()
            self.open_tags[last] -= 1
            self.scopes[-1][last] -= 1
            if landmark:
                self.scopes.pop()
            self.hard -= drop == HARD
            self.landmarks -= landmark
            self.region, (self.soft, self.form) = region, soft
            if last == tag:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.hard and not self.soft:
            self.text.append(data)
            if self.in_link:
                self.link += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    kernel = np.exp(-np.arange(-KERNEL, KERNEL + 1) ** 2 / (2 * sigma * sigma))
    return np.convolve(np.pad(ratios, KERNEL, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """The boundary of the two clusters of a one-dimensional two-means, started at the extremes."""
    low, high = values.min(), values.max()
    for _ in range(32):
        cut = (low + high) / 2
        upper = values > cut
        if not upper.any() or upper.all():
            return cut
        new = values[~upper].mean(), values[upper].mean()
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def link_blocks(lines: list[tuple[str, int, int, int, bool, int]], at: list[int], least: int) -> set[int]:
    """Regions of the lines ``at`` that are mostly links, of which they have ``least`` or more."""
    sums: dict[int, list[int]] = {}
    for i in at:
        text, _, link, region, _, anchors = lines[i]
        have = sums.setdefault(region, [0, 0, 0])
        for k, n in enumerate((len(text), link, anchors)):
            have[k] += n
    return {r for r, (n, link, anchors) in sums.items() if link > LINKED * n and anchors >= least}


def container(lines: list[tuple[str, int, int, int, bool, int]], weight: np.ndarray, parent: list[int], page: set[int]) -> list[int]:
    """The lines of the region that holds the text: from the page down to where no part has nearly all the weight.

    Parts that lie side by side in it are judged together, so a short one stays, and so does what
    stands beside it in its parent, a title or a list; beside it in the page itself (regions
    ``page``) only if its weight is its own lines', as a block of text has it.
    """
    of: dict[int, list[int]] = {}
    own: dict[int, float] = {}
    for i, x in enumerate(lines):
        of.setdefault(x[3], []).append(i)
        own[x[3]] = own.get(x[3], 0) + weight[i]
    total = [own.get(r, 0) for r in range(len(parent))]
    count = [len(of.get(r, ())) for r in range(len(parent))]
    children: list[list[int]] = [[] for _ in parent]
    for r in range(len(parent) - 1, 0, -1):  # a region's number is above its parent's
        total[parent[r]] += total[r]
        count[parent[r]] += count[r]
        children[parent[r]].append(r)
    at = 0
    while heir := next((r for r in children[at] if total[r] >= WHOLE * total[0] > 0), 0):
        at = heir
    up = at
    while up and count[up] == count[at]:
        up = parent[up]
    if up not in page or own.get(at, 0) >= total[at] / 2:
        at = up
    stack, out = [at], []
    while stack:
        r = stack.pop()
        out += of.get(r, ())
        stack += children[r]
    return sorted(out)


def main_text(html: str | None) -> str:
    """The article's blocks joined by one space; empty if there is none."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    # a form's text is content only where the whole page is one form
    lines = [x for x in parser.lines if not x[4]] or parser.lines
    if not lines:
        return ""
    chars = np.array([len(x[0]) for x in lines], float)
    links = np.array([x[2] for x in lines], float)
    ratios = smoothed(np.maximum(chars - links, 0) / np.array([max(1, x[1]) for x in lines]))
    cut = np.expm1(threshold(np.log1p(ratios)))  # of logarithms, lest one long paragraph be a cluster of its own
    dense = ratios >= cut
    marked = np.array([parser.region_landmark[x[3]] > 0 for x in lines])
    heavy = np.where(ratios >= np.where(marked, cut / LANDMARK_WEIGHT, cut), np.maximum(chars - links, 0), 0)
    # landmarks together, and the heaviest of them with its bonus, against the text outside
    inside: dict[int, float] = {}
    for i, x in enumerate(lines):
        if top := parser.region_landmark[x[3]]:
            inside[top] = inside.get(top, 0) + heavy[i]
    outside = heavy[~marked].sum()
    if inside and max(LANDMARK_WEIGHT * max(inside.values()), sum(inside.values())) >= outside:
        at = np.flatnonzero(marked).tolist()
        linked = link_blocks(lines, at, LANDMARK_LINKS)
        return " ".join(lines[i][0] for i in at if lines[i][3] not in linked or len(linked) == len({lines[k][3] for k in at}))
    # an article far lighter than the text around it is a piece of its own
    rest = [i for i, x in enumerate(lines) if not parser.in_article[x[3]]]
    lines, chars, links, dense = [lines[i] for i in rest], chars[rest], links[rest], dense[rest]
    at = container(lines, np.where(dense, np.maximum(chars - links, 0), 0), parser.parent, parser.page)
    linked = link_blocks(lines, at, 1)
    return " ".join(lines[i][0] for i in at if lines[i][3] not in linked)


def extract(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default page_id and url), then text and n_chars (code points).

    The whole page is parsed, however long. Null html, a page without content, and one of
    markup only give an empty text and 0. Broken markup is read as far as the parser goes.
    Rows, null keys and repeats are kept; an empty table gives an empty one; other columns
    are not read. One narrow pass without a shuffle.
    """
    keep = keep or ["page_id", "url"]
    names = [f"_c{i}" for i in range(len(keep))]
    schema = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(len(keep))]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    chosen = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    return arrow_rows(df, [*chosen, F.col(f"`{html}`").cast("string").alias("_html")], run, f"{schema}, text string, n_chars long").withColumnsRenamed(dict(zip(names, keep)))
