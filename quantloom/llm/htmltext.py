"""Main text of web pages by tag-path ratios.

1. One pass over the page gives its elements and its blocks: the text between two boundaries of block elements. The leaf of
   a block's tag path is the element of its longest run of text. Only what is never shown as text has no blocks.
2. For each path the mean text length (saturating, so that one huge block doesn't set the scale), the mean number of
   punctuation marks and the share of text that isn't links are fused into one ratio. It is weighed by a prior of what
   the tags, classes, ids and roles on the way say: navigation, headers, footers, asides, forms, notices, adverts and reader
   comments weigh little; inside an article, words that may as well name a topic (menu, form, search) weigh half.
3. Every block gets the weighed ratio of its path; these values are smoothed over the page in order. A path is content if
   both its own ratio and its mean smoothed one reach a share of the mean over the page's text (weighed too), in an article at most
   that of a short sentence. Blocks that are links as a whole and loose inline elements between blocks also need a ratio
   that is high among the page's blocks.
4. The blocks on content paths are selected. With them go headings right before selected blocks, and the other undeclared
   blocks of the region of the selected ones, but for such links and loose elements: of the article and main elements with
   selected text where those hold half of it, else of the deepest container that has all of it, there without named
   containers in which nothing is selected.

Defined results: null html, the empty page and pages without content, or with nothing but navigation, page headers, footers,
asides and forms, give the empty text; broken and cut-off markup is read as far as it goes, where a tag that never ends is
the end of the page; repeated rows get equal results; ties between run lengths go to the first run; an empty table gives no
rows; other columns, whatever their names, do not matter. Pages are independent rows, so there is no shuffle; time is
linear in the page and memory is bounded by one page, however long or deeply nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import small_batches, tidy

#: HTML's elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr script style noscript template".split()
)
UNREAD = frozenset(
    "head script style textarea title xmp noembed noframes iframe noscript template svg select option button object canvas"
    " audio video map".split()
)
ASIDE = frozenset("nav footer aside form dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
P_ENDS_BEFORE = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section"
    " table ul".split()
)
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body article main section div table ul ol dl td th aside nav header footer form blockquote".split())
#: The elements that a name can declare, the names, ARIA's roles.
NAMED = frozenset("div section ul ol dl table span ins figure center header".split())
COMMENTS = r"comments?|commentlist|commenters?|disqus|replies|respond|responses?|discussions?|reactions?|feedback"
#: Names of what is never an article's text, and words that name a topic as well.
NAMES = (
    r"nav|navbar|navigation|breadcrumbs?|masthead|foot|footer|copyright|colophon|sidebars?|rail|cookies?|consent|gdpr|ccpa|cc|ccbar|cmp"
    r"|ads?|adverts?|advertisement|advertising|adsense|adslot|dfp|gpt|taboola|outbrain|sponsor|sponsored|promo|promoted|login|signup|newsletter"
    r"|subscribe|subscription|paywall|related|recommended|recirc|trending|share|sharing|social|widget|popup|modal|overlay|toolbar|pagination|pager"
)
TOPICS = r"menu|form|search|notice|notices|banner|slot|legal|tags|tools|alert"
ROLES = frozenset("navigation menu menubar banner contentinfo complementary search form".split())

PART = r"(?:^|[\s_-])(?:%s)(?:$|[\s_-])"
SAYS_COMMENTS, SAYS_ASIDE, SAYS_TOPIC = (re.compile(PART % words, re.I) for words in (COMMENTS, NAMES, TOPICS))
SAYS_HEADER = re.compile(r"(?:^|\s)(?:(?:site|page|top|main|global)[_-])?header(?:$|\s)", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden)\b(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+", re.I)
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: Priors of paths on which a tag, a name, or in an article a word that may be a topic speaks against content.
BY_TAG, BY_NAME, BY_TOPIC = 0.001, 0.002, 0.5
PUNCTUATION = re.compile(r"[.,;:!?…。，、]")


class Page:
    """The elements of a page in order (lists by element number; 0 stands for the page) and its runs of text."""

    def __init__(self, page: str):
        self.parent, self.tag, self.last, self.article, self.hint = [-1], [""], [0], [0], [0]
        self.label, self.plain, self.linked, self.inline = [0], [0], [False], [False]
        self.named = [0]  # nearest container with a class or id
        self.hints: list[tuple[int, bool, bool, float]] = [(-1, False, False, 1.0)]  # (hint around it, undone, it is of comments, prior)
        self.runs: list[tuple[int, int, str]] = []  # (element, block, text)
        self.read(page)

    def declared(self, tag: str, attributes: str, in_article: bool) -> tuple[str, float] | None:
        """What the tag and its attributes say it is ("aside", "comments", "header" or "unseen"), and the prior of that."""
        topic = False
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "hidden" or (name == "style" and UNSEEN.search(value)):
                return "unseen", 0.0
            if name in ("class", "id") and SAYS_COMMENTS.search(value) and tag not in HEADINGS and tag != "p":
                return "comments", BY_NAME
            if tag not in NAMED:
                continue
            if name == "role" and value.lower() in ROLES:
                return "aside", BY_TAG
            if name in ("class", "id") and not in_article and SAYS_HEADER.search(value):
                return "header", BY_NAME
            if name in ("class", "id") and SAYS_ASIDE.search(value):
                return "aside", BY_NAME
            topic |= name in ("class", "id") and bool(SAYS_TOPIC.search(value))
        if tag in ASIDE or (tag == "header" and not in_article):
            return "header" if tag == "header" else "aside", BY_TAG
        return ("aside", BY_TOPIC if in_article else BY_NAME) if topic else None

    def read(self, page: str) -> None:
        labels: dict[tuple[int, str], int] = {}
        stack, scopes = [0], [(0, {})]  # open elements; (depth where a scope begins, depths of open tags in it)
        open_tags: dict[str, int] = {}
        dead: list[bool] = [False]  # by depth: text there is left out whatever comes
        block = at = 0
        tags, end_of_page = TAG, len(page)

        def text_to(end: int) -> None:
            if end > at and not dead[-1]:
                self.runs.append((stack[-1], block, html.unescape(page[at:end])))

        def cut(depth: int) -> None:
            """Close all elements from this depth on."""
            while len(stack) > depth:
                gone = stack.pop()
                dead.pop()
                self.last[gone] = len(self.tag) - 1
                tag = self.tag[gone]
                open_tags[tag] -= 1
                if scopes[-1][0] == len(stack):
                    scopes.pop()
                scopes[-1][1].get(tag, [0]).pop()

        def end_same(names: tuple[str, ...]) -> None:
            begin, there = scopes[-1]
            depths = [there[n][-1] for n in names if there.get(n)]
            if depths:
                cut(min(depths) if "tr" in names else max(depths))
            elif len(stack) > 1 and self.tag[stack[begin]] in names:
                cut(begin)

        while at < end_of_page:
            start = page.find("<", at)
            if start < 0:
                break
            following = page[start + 1 : start + 2]
            if following in ("!", "?"):
                close = "-->" if page.startswith("<!--", start) else ">"
                end = page.find(close, start + 2)
                text_to(start)
                at = end + len(close) if end >= 0 else end_of_page
                continue
            if not (following == "/" or following.isalpha()):
                text_to(start + 1)
                at = start + 1
                continue
            found = tags.match(page, start)
            if not found and tags is TAG and ">" in page[start:]:
                tags = PLAIN_TAG  # a quote that never ends: from here on tags end at the first mark
                found = tags.match(page, start)
            if not found:
                text_to(start)
                if "/" == following and page.find(">", start) >= 0:
                    at = page.find(">", start) + 1
                    continue
                at = end_of_page
                break
            text_to(start)
            at = found.end()
            tag = found[2].lower()
            if tag == "br":
                self.runs.append((stack[-1], block, "\n")) if not dead[-1] else None
                continue
            block += tag not in INLINE
            if found[1]:
                if open_tags.get(tag):
                    depth = len(stack) - 1
                    while self.tag[stack[depth]] != tag:
                        depth -= 1
                    cut(depth)
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                closing = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
                at = closing.end() if closing else end_of_page
                continue
            if tag in P_ENDS_BEFORE:
                end_same(("p",))
            if tag in SAME_ENDS:
                end_same(SAME_ENDS[tag])
            if not found[3].endswith("/"):
                self.open(tag, found[3], stack, scopes, open_tags, dead, labels)
        text_to(end_of_page)
        cut(1)
        self.last[0] = len(self.tag) - 1

    def open(self, tag: str, attributes: str, stack: list, scopes: list, open_tags: dict, dead: list, labels: dict) -> None:
        number, up = len(self.tag), stack[-1]
        says, prior = (self.declared(tag, attributes, bool(self.article[up])) if tag not in ("html", "body", "main") else None) or (None, 1.0)
        hint = self.hint[up]
        if says in ("aside", "comments", "header"):
            self.hints.append((hint, False, says == "comments", prior))
            hint = len(self.hints) - 1
        elif hint and tag in ("article", "main") and not self.hints[hint][2]:
            self.hints[hint] = (self.hints[hint][0], True, False, self.hints[hint][3])
        name = next((v.split()[0] for n, *vs in ATTRIBUTE.findall(attributes) if n.lower() == "class" for v in vs if v.split()), "")
        holds = tag in ("div", "section") and any(n.lower() in ("class", "id") for n, *_ in ATTRIBUTE.findall(attributes))
        self.named.append(number if holds else self.named[up])
        self.parent.append(up)
        self.tag.append(tag)
        self.last.append(number)
        self.article.append(self.article[up] or (number if tag in ("article", "main") else 0))
        self.hint.append(hint)
        self.label.append(labels.setdefault((self.label[up], f"{tag}.{name}" if name else tag), len(labels) + 1))
        self.plain.append(labels.setdefault((self.plain[up], f"<{tag}>"), len(labels) + 1))
        self.linked.append(self.linked[up] or tag == "a")
        self.inline.append(tag in INLINE)
        dead.append(dead[-1] or tag in UNREAD or says == "unseen")
        open_tags[tag] = open_tags.get(tag, 0) + 1
        scopes[-1][1].setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append((len(stack), {}))
        stack.append(number)

    def priors(self) -> list[float]:
        """For each hint the prior of what is below it. A hint around an article says nothing, unless it is of comments."""
        undone = [h[1] for h in self.hints]
        for k in range(len(self.hints) - 1, 0, -1):
            around = self.hints[k][0]
            undone[around] |= undone[k] and not self.hints[around][2]
        out = [1.0]
        for k in range(1, len(self.hints)):
            around = out[self.hints[k][0]]
            out.append(around if undone[k] else min(around, self.hints[k][3]))
        return out


class Block:
    """Text between two boundaries, with the element of its longest run."""

    def __init__(self, page: Page, runs: list[tuple[int, str]], priors: list[float]):
        self.text = " ".join("".join(t for _, t in runs).split())
        self.leaf = max(runs, key=lambda r: len(r[1].strip()))[0]
        self.link = all(page.linked[e] or not t.strip() for e, t in runs)
        self.wrapped = all(page.inline[e] or not t.strip() for e, t in runs)
        around = self.leaf
        while page.inline[around]:
            around = page.parent[around]
        self.around = around
        self.heading, self.extra = page.tag[around] in HEADINGS, False
        self.prior = priors[page.hint[self.leaf]]
        linked = sum(len(t.strip()) for e, t in runs if page.linked[e])
        self.unlinked = 1 - 0.9 * linked / max(sum(len(t.strip()) for _, t in runs), 1)


def blocks_of(page: Page) -> list[Block]:
    groups: dict[int, list[tuple[int, str]]] = {}
    for element, block, text in page.runs:
        groups.setdefault(block, []).append((element, text))
    priors = page.priors()
    return [Block(page, g, priors) for g in groups.values() if any(t.strip() for _, t in g)]


def content_paths(
    page: Page, blocks: list[Block], share: float = 0.15, sentence: float = 20.0, own: float = 0.5, long: float = 300.0, width: int = 2
) -> tuple[set[int], set[int]]:
    """The paths whose weighed ratio reaches ``share`` of its mean over the page's text, by itself and smoothed over the page
    (``sentence`` is enough in articles), and those of them whose ratio is at least ``own`` of the mean over the blocks. The
    best path is in both."""
    path, first, place = np.unique([page.label[b.leaf] for b in blocks], return_index=True, return_inverse=True)
    number = np.bincount(place)
    mean = lambda values: np.bincount(place, values) / number
    size = np.array([len(b.text) for b in blocks], np.float64)
    fused = mean(long * size / (long + size)) * np.log(2 + mean([len(PUNCTUATION.findall(b.text)) for b in blocks]))
    prior = np.array([b.prior for b in blocks])
    fused *= mean([b.unlinked for b in blocks]) * mean(prior)
    kernel = np.exp(-0.5 * np.arange(-width, width + 1) ** 2)
    inner = slice(width, len(blocks) + width)
    smooth = np.convolve(fused[place], kernel)[inner] / np.convolve(np.ones(len(blocks)), kernel)[inner]
    least = share * (fused[place] @ (size * prior)) / (size @ prior)
    inside = np.array([bool(page.article[blocks[k].leaf]) for k in first])
    needed = np.where(inside, min(least, sentence), least)
    chosen = (fused >= needed) & (mean(smooth) >= needed)
    chosen[fused.argmax()] = True
    return set(path[chosen].tolist()), set(path[chosen & (fused >= own * fused[place].mean())].tolist())


def regions(page: Page, selected: list[Block]) -> list[tuple[int, int]]:
    """First and last element of each region of the selected blocks, in order."""
    held: dict[int, int] = {}
    for b in selected:
        held[page.article[b.leaf]] = held.get(page.article[b.leaf], 0) + len(b.text)
    outside = held.pop(0, 0)
    if held and sum(held.values()) >= outside:
        return [(e, page.last[e]) for e in sorted(held)]
    root, leaf = selected[0].around, selected[-1].around
    top = max(selected, key=lambda b: b.around).around
    while not root <= min(leaf, top) <= max(leaf, top) <= page.last[root] or page.tag[root] in HEADINGS or page.tag[root] == "p":
        root = page.parent[root]
    return [(root, page.last[root])]


def main_text(html_text: str) -> str:
    page = Page(html_text)
    blocks = blocks_of(page)
    if max((b.prior for b in blocks), default=0) <= BY_TAG:
        return ""
    chosen, strong = content_paths(page, blocks)
    filled = {b.around for b in blocks if not b.wrapped} | {page.parent[b.around] for b in blocks}
    for b in blocks:
        b.extra = (b.link and page.tag[b.around] != "p") or (b.wrapped and b.around in filled and page.tag[b.around] != "p")
    told = [page.label[b.leaf] in (strong if b.extra else chosen) for b in blocks]
    selected = [b for b, x in zip(blocks, told, strict=True) if x]
    areas = regions(page, selected)
    declared = bool(page.article[areas[0][0]])
    holding = set()  # named containers with selected text
    for b in selected:
        around = page.named[b.around]
        while around and around not in holding:
            holding.add(around)
            around = page.named[page.parent[around]]
    kept, area, follows = [], len(areas) - 1, False
    for b, by_path in zip(reversed(blocks), reversed(told), strict=True):
        while area > 0 and b.around < areas[area][0]:
            area -= 1
        begin, end = areas[area]
        inside = begin <= b.around <= end and b.prior == 1
        if inside and not declared:
            around = page.named[b.around]
            inside = around <= begin or around in holding
        keep = by_path or (b.heading and ((follows and b.prior > BY_NAME) or inside)) or (inside and not b.extra)
        follows = keep
        if keep:
            kept.append(b.text)
    return " ".join(reversed(kept))


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of ``pages``, and text: the main text of the html."""
    names = [f"_c{k}" for k in range(len(keep))]
    rows = small_batches(
        pages.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.coalesce(F.col(html_col), F.lit("")).alias("_h"))
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column("_h").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), texts], [*names, "_t"])

    found = rows.mapInArrow(tidy(run), f"{schema}, _t string")
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), F.col("_t").alias("text"))
