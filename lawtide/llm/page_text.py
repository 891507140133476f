"""Main text of web pages: the contiguous region of maximal score.

A page is a sequence of words and tags. Words score by the block they are in (its element, its length,
its share of links), tags by their name, with weights learned from labelled pages: those that mark their
article themselves. The mark is the label and no feature, so the weights hold for pages without one. One
linear scan finds the contiguous region whose sum is greatest; its text, without the parts of a page
that are never article, is what is returned. Where a page marks an article, words inside score above
and words beyond below zero, unless the region found without the mark is far longer: then the mark is
that of a teaser.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements, and words that sites use in class and id.
HIDDEN = frozenset("head script style template noscript svg canvas iframe object math audio video".split())
FORMS = frozenset("form button input select textarea fieldset label option dialog".split())
ZONES = frozenset("nav footer aside menu".split())
MARKED = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE = frozenset("a abbr b br cite code em i img mark q s small span strong sub sup u".split())
NEVER_ARTICLE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer disqus footer masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted "
    "related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
# Of these, words that an article's own element may bear beside a word that says what it is.
PASSING = frozenset("notice notices promo promoted related share sharing social sponsored".split())
ARTICLE_WORDS = frozenset("article body content entry main post story text".split())
# Elements of comments, which are articles of their own.
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
NEVER_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
RAW = "script style template noscript svg iframe textarea title"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^'\">])*+)(>|\Z)", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*(?:>|\Z)|\Z", re.I) for name in RAW.split()}
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _zone(name: str, attributes: str, inside: bool) -> str | None:
    """The zone that an element opens, if any. `inside`: an article is open."""
    if name in HIDDEN or name in FORMS:
        return "hidden"
    if name in ZONES or name == "header" and not inside:
        return "frame"
    for key, *value in _ATTRIBUTE.findall(attributes) if attributes else ():
        words = re.split(r"[^a-z0-9]+", "".join(value).lower())
        if key.lower() == "role":
            if NEVER_ROLES.intersection(words) and name not in MARKED:
                return "frame"
        elif name in MARKED:
            if COMMENTS.intersection(words):
                return "frame"
        elif name != "body" and name != "html" and (never := NEVER_ARTICLE.intersection(words)):
            if never - PASSING or not ARTICLE_WORDS.intersection(words):
                return "frame"
    if name in MARKED:
        return "marked"
    return None


def tokens(page: str) -> Iterator[tuple[str, str, str, str | None]]:
    """(kind, name or text, zone, block): tags as they come, and the text between them.

    Zones of text: hidden, frame (menus, footers, adverts, forms and the like), marked (within an article
    element), link, heading, plain. Elements that end with their parent, and those never closed, are
    closed with the element around them. block is the innermost block element that text is in, none
    within a link; an article element counts as a division.
    """
    stack: list[tuple[str, str | None]] = []
    # How many open elements have a name, and how many opened a zone: no tag needs a look through the stack.
    names, zones, blocks = Counter(), Counter(), ["body"]
    at = 0

    def push(name: str, attributes: str) -> None:
        stack.append((name, _zone(name, attributes, zones["marked"] > 0)))
        names[name] += 1
        zones[stack[-1][1]] += 1
        if name in BLOCKS:
            blocks.append("div" if name in MARKED else name)

    def pop() -> str:
        name, opened = stack.pop()
        names[name] -= 1
        zones[opened] -= 1
        if name in BLOCKS:
            blocks.pop()
        return name

    def zone() -> str:
        for opened in ("hidden", "frame", "marked"):
            if zones[opened]:
                return opened
        return "link" if names["a"] else "heading" if names["h1"] or names["h2"] or names["h3"] else "plain"

    now = "plain"
    for found in _TOKEN.finditer(page):
        if found.start() < at:
            continue
        if found.start() > at:
            yield "text", page[at: found.start()], now, None if names["a"] else blocks[-1]
        at = found.end()
        closing, name, attributes, _ = found.groups()
        if not name:
            continue
        name = name.lower()
        if closing:
            if names[name]:
                while pop() != name:
                    pass
                now = zone()
        elif name in _RAW_END:
            at = _RAW_END[name].search(page, at).end()
            continue
        elif name not in VOID:
            if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                pop()
            push(name, attributes)
            now = zone()
        yield "tag", name, now, None
    if at < len(page):
        yield "text", page[at:], now, None if names["a"] else blocks[-1]


Token = tuple[str, str, str, str | None]


def featured(found: Sequence[Token]) -> list[tuple[str, ...]]:
    """What is known of the words of each text: the element, the number of words and the share of links of
    the block it is in. Nothing for tags and hidden text."""
    out: list[tuple[str, ...]] = [()] * len(found)
    texts: list[int] = []

    def close() -> None:
        sizes = [len(found[i][1].split()) for i in texts]
        n = sum(sizes)
        if n:
            linked = sum(size for i, size in zip(texts, sizes) if found[i][3] is None)
            element = next((found[i][3] for i in texts if found[i][3] is not None), "a")
            known = (f"in {element}", f"words {min(n.bit_length(), 7)}", f"links {round(3 * linked / n)}")
            for i in texts:
                out[i] = known
        texts.clear()

    for i, (kind, value, zone, _) in enumerate(found):
        if kind == "text":
            if zone != "hidden":
                texts.append(i)
        elif value in BLOCKS:
            close()
    close()
    return out


_COUNT = "name string, inside long, outside long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often tags and words of each feature stand inside and outside the articles of marked pages."""
    sums: dict[str, list[int]] = {}
    for batch in batches:
        for page in batch["html"].to_pylist():
            if not page or not re.search(r"<(article|main)\b", page, re.I):
                continue
            found = list(tokens(page))
            for (kind, value, zone, _), known in zip(found, featured(found)):
                if kind == "tag":
                    names, n = (f"<{value}>" if value in BLOCKS or value in INLINE else "<other>",), 1
                else:
                    names, n = ("all", *known) if known else (), len(value.split())
                for name in names:
                    sums.setdefault(name, [0, 0])[0 if zone == "marked" else 1] += n
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums)), pa.array([a for a, _ in sums.values()], pa.int64()),
             pa.array([b for _, b in sums.values()], pa.int64())], ["name", "inside", "outside"])


def learned_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all pages that mark an article: for a feature of words, how many times as frequent it is
    inside as outside, as a logarithm; for tags the log odds of being outside, below zero always. Menus and
    the like count as outside. The names are those of HTML elements and of a few sizes, some dozens,
    whatever the pages; only their sums reach the driver."""
    rows = (
        pages.select(F.col(html_col).cast("string").alias("html")).mapInArrow(_counted, _COUNT)
        .groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect())
    weights = {}
    inside, outside = next(((r["inside"], r["outside"]) for r in rows if r["name"] == "all"), (0, 0))
    for row in sorted(rows, key=lambda r: r["name"]):
        if row["name"].startswith("<"):
            odds = math.log((row["inside"] + 0.5) / (row["outside"] + 0.5))
            weights[row["name"]] = -max(0.02, min(0.5, -odds / 8))
        elif row["name"] != "all":
            ratio = math.log(
                (row["inside"] + FEW) * (outside + 2 * FEW) / ((row["outside"] + FEW) * (inside + 2 * FEW)))
            weights[row["name"]] = max(-3.0, min(3.0, ratio))
    return weights


#: Words of a feature before it weighs: so many are added to both sides.
FEW = 20
#: What words weigh before the labelled pages are asked, by zone.
_PLAIN = {"plain": 1.0, "heading": 0.5, "link": -0.75}
#: What is learned moves that by so much at most: text stays above zero and links below, whatever the
#: labelled pages say, as they may know a block element from their adverts alone.
MOVED = 0.4
#: Words in a marked article, and beyond one; the mark is the label, so nothing can be learned of it.
_MARKED, _BEYOND = 3.0, -3.0
#: A marked article is a teaser if the page holds so many times its words in one region beyond it.
TEASER = 4


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run of the greatest sum, the longest of equals; empty if none is above zero."""
    best, most, start, total = (0, 0), 0.0, 0, 0.0
    for i, score in enumerate(scores):
        if total < 0:
            start, total = i, 0.0
        total += score
        if total > most or total == most > 0 and i + 1 - start > best[1] - best[0]:
            best, most = (start, i + 1), total
    return best


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The article of a page: one line per block, white space in a block as one space, character
    references decoded."""
    found = list(tokens(page or ""))
    sizes = [len(value.split()) if kind == "text" else 0 for kind, value, _, _ in found]
    marked = sum(n for n, token in zip(sizes, found) if token[2] == "marked")

    # Words beyond a marked article, by what is known of their blocks.
    out = {"hidden", "frame", "marked"}
    scores = []
    for (kind, value, zone, _), known, n in zip(found, featured(found), sizes):
        if zone in out:
            scores.append(0.0)
        elif kind == "tag":
            scores.append(weights.get(f"<{value}>", weights.get("<other>", -0.02)))
        else:
            learned = sum(weights.get(name, 0.0) for name in known) / 3
            scores.append(n * (_PLAIN[zone] + max(-MOVED, min(MOVED, learned))))
    a, b = best_region(scores)
    if marked and sum(n for n, token in zip(sizes[a:b], found[a:b]) if token[2] not in out) <= TEASER * marked:
        out = {"hidden", "frame"}
        scores = []
        for (kind, value, zone, _), n in zip(found, sizes):
            if zone in out:
                scores.append(0.0)
            elif kind == "tag":  # within the article a tag costs less than the least word
                scores.append(weights.get(f"<{value}>", weights.get("<other>", -0.02)) / (64 if zone == "marked" else 1))
            else:
                scores.append(n * (_MARKED if zone == "marked" else _BEYOND))
        a, b = best_region(scores)
    blocks, open_ = [], []
    for kind, value, zone, _ in found[a:b]:
        if kind == "text":
            if zone not in out:
                open_.append(value)
        elif value in BLOCKS:
            blocks.append(open_)
            open_ = []
        elif value == "br":
            open_.append(" ")
    blocks.append(open_)
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks)
    return "\n".join(line for line in lines if line)


def _extracted(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["row", "text", "n_chars"])
    return run


def extracted(pages: DataFrame, html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """All other columns of pages as the column `row`, with text and n_chars (code points).

    null and empty pages, and pages without an article, give the empty text. Pages of any length are read
    whole. Repeated rows and ids are pages each. Without weights they are learned from the pages.
    """
    if weights is None:
        weights = learned_weights(pages, html_col)
    rest = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    source = pages.select(
        F.struct(*rest).alias("row") if rest else F.struct(F.lit(0).alias("none")).alias("row"),
        F.col(html_col).cast("string").alias("html"))
    schema = source.select("row").withColumns(
        {"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return source.mapInArrow(_extracted(weights), schema)
