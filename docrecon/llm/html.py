"""Main text of web pages: the maximum-scoring subsequence of a page's words and tags, with weights learned from labelled pages."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lines, materialise

#: Weights are fitted on about so many labelled pages at most (those of least hash): pages that mark one article element.
MAX_LABELLED = 500
#: The most frequent sets of signs of the labelled pages that are fitted.
MAX_SETS = 5000
#: Fixed values, of HTML itself: elements that end a block, that hold no text of a page, that have no end, and that only lay out.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
RAW = frozenset("script style template noscript iframe svg canvas object math textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LAYOUT = frozenset("html body div span section article main".split())
#: What a sign weighs, in log odds of main text, before any page is seen. Elements by their meaning in HTML; class, id
#: and role names by their parts, which must all be known here, at least one in the first row. Labelled pages move these weights.
PRIOR_ELEMENTS = dict.fromkeys("nav footer aside form menu button select dialog".split(), -3.0) | {"header": -2.0, "p": 1.5} | dict.fromkeys(HEADINGS := ("h1", "h2", "h3", "h4", "h5", "h6"), 1.0)
PRIOR_NAME, PRIOR_PARTS = -3.5, frozenset("ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices comment comments reply replies sidebar menu nav navigation navbar footer header breadcrumb breadcrumbs share sharing social related newsletter subscribe popup modal login signup search".split())
PRIOR_FILL = frozenset("area bar block box container content form inner item items left links list main outer right section top bottom site page widget wrapper".split())
#: How strongly a weight is held to its prior, in words of the labelled sample scaled to FIT_WORDS; a word in an article or main element weighs LABEL more at most.
HOLD, FIT_WORDS, LABEL = 0.5, 2000.0, 4.0
#: A word's log odds count up to so much either way. Within the chosen region a block goes if its own are at or below DROP.
MOST, DROP = 6.0, -1.0
#: A block in an article element whose signs have a prior this low is no example of either kind: articles hold adverts too.
UNCLEAR = -2.5
#: What a tag may cost; the labelled pages choose.
TAG_COSTS = (0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.5)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"']+)))?""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_CLOSES_P = BLOCKS - {"br", "body", "html", "head", "title"}


def hidden(attributes: str) -> bool:
    """Whether a tag's attributes hide it: hidden itself, aria-hidden=true or display:none in its style."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").strip().lower()
        if name == "hidden" and value not in ("false", "until-found") or name == "aria-hidden" and value == "true" or name == "style" and _NOT_SHOWN.search(value):
            return True
    return False


def _signs(name: str, attributes: str) -> frozenset[str]:
    """An element's signs: its name, unless it only lays out, and its class, id and role names with a point in front. The id of a heading is a link's target and no sign."""
    own = {f".{x.lower()}" for kind, a, b, c in _NAMES.findall(attributes) for x in (a or b or c).split() if kind.lower() != "id" or name not in HEADINGS}
    return frozenset(own if name in LAYOUT else own | {name})


class Block:
    """A piece of text with the signs of what is open around it (inside the first article or main element: since its start),
    whether it is in that article or main element, and the tags since the block before."""

    __slots__ = ("inside", "main", "signs", "tags", "text", "words")

    def __init__(self, text: str, signs: frozenset[str], inside: bool, main: bool, tags: int):
        self.text, self.signs, self.inside, self.main, self.tags, self.words = text, signs, inside, main, tags, text.count(" ") + 1


class Open:
    """The open elements of a page. What is asked of them, however deep they nest, is kept up as they open and close: the places of
    each name, how many are hidden, an article or main text, and the signs since the last of these (or since the start)."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset[str], str]] = []  # name, signs, what it is: article (the first), main, hidden or nothing
        self.places: dict[str, list[int]] = {}
        self.kinds = Counter()
        self.signs: list[Counter] = [Counter()]

    def last(self, name: str) -> int:
        """The place of the innermost open element of that name; -1 if there is none."""
        at = self.places.get(name)
        return at[-1] if at else -1

    def push(self, name: str, signs: frozenset[str], kind: str) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, signs, kind))
        if kind:
            self.kinds[kind] += 1
            self.signs.append(Counter())
        else:
            self.signs[-1].update(signs)

    def cut(self, at: int) -> None:
        """Close all elements from a place on."""
        while len(self.stack) > at:
            name, signs, kind = self.stack.pop()
            self.places[name].pop()
            if kind:
                self.kinds[kind] -= 1
                self.signs.pop()
            else:
                own = self.signs[-1]
                for x in signs:
                    own[x] -= 1
                    if not own[x]:
                        del own[x]


def blocks(page: str) -> Iterator[Block]:
    """A page's blocks in order; one without words is skipped, as is what a page does not show. Time grows with the length of the page, however its elements nest."""
    opened = Open()
    articles = 0
    text: list[str] = []
    tags = 0

    def done():
        nonlocal text, tags
        whole = " ".join(html.unescape("".join(text)).split())
        text = []
        if whole and not opened.kinds["hidden"]:
            yield Block(whole, frozenset(opened.signs[-1]), opened.kinds["article"] > 0, opened.kinds["main"] > 0, tags)
            tags = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m.group(2) is None:
            t = m.group()
            if t[:9] == "<![CDATA[":
                text.append(html.escape(t[9:-3] if t.endswith("]]>") else t[9:]))
            elif t[0] != "<" or t == "<":
                text.append(t)
            continue
        close, name, rest = m.group(1), m.group(2).lower(), m.group(3)
        tags += 1
        if name in BLOCKS:
            yield from done()
        if close:
            if opened.last(name) >= 0:
                opened.cut(opened.last(name))
            continue
        if name in RAW:
            if not rest.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if name in VOID or rest.endswith("/"):
            continue
        if name in _CLOSES_P and opened.last("p") >= 0:
            opened.cut(opened.last("p"))
        elif name == "li" and opened.last("li") > max(opened.last("ul"), opened.last("ol")):
            opened.cut(opened.last("li"))
        kind = "hidden" if rest and hidden(rest) else "main" if name == "main" else "article" if name == "article" and not articles else ""
        articles += kind == "article"
        opened.push(name, _signs(name, rest) if not kind else frozenset(), kind)
    yield from done()


def prior(sign: str) -> float:
    """A sign's weight before any page is seen."""
    if sign[0] != ".":
        return PRIOR_ELEMENTS.get(sign, 0.0)
    parts = {x for x in re.split(r"[^a-z]+", sign) if x}
    return PRIOR_NAME if parts & PRIOR_PARTS and parts <= PRIOR_PARTS | PRIOR_FILL else 0.0


class Weights:
    """What words and tags score, from the labelled pages' words in and out of their article elements.

    of_signs: log odds of main text by a block's signs, a logistic regression that is held to the priors. label: what a word
    or tag in (first) and out (second) of the page's article or main element scores besides, where the page has one. tag: what
    a tag costs.
    """

    def __init__(self, counts: list[tuple[frozenset[str], bool, int]] | None = None, tag: float = 0.5):
        counts, self.tag = counts or [], tag
        words = {k: sum(n for _, inside, n in counts if inside is k) for k in (True, False)}
        self.label = (min(LABEL, math.log(words[True] + 1)), -min(LABEL, math.log(words[False] + 1))) if counts else (2.0, -2.0)
        self.bias, self.weights = 0.5, {}
        if counts:
            self._fit(counts)
        self._known: dict[frozenset[str], float] = {}

    def _fit(self, counts) -> None:
        names = sorted({s for row in counts for s in row[0]})
        place = {s: i for i, s in enumerate(names)}
        row = np.repeat(np.arange(len(counts)), [len(r[0]) for r in counts])
        col = np.array([place[s] for r in counts for s in sorted(r[0])], np.int64)
        n = np.array([r[2] for r in counts], float)
        n *= FIT_WORDS / n.sum()
        y = np.array([r[1] for r in counts], float)
        start = np.array([prior(s) for s in names])
        w, bias, square, square_b = start.copy(), self.bias, np.full(len(names), 1e-6), 1e-6
        for _ in range(400):  # adaptive gradient steps on a convex loss
            z = bias + np.bincount(row, w[col], len(counts))
            error = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            g = np.bincount(col, error[row], len(names)) + HOLD * (w - start)
            square += g * g
            square_b += error.sum() ** 2
            w -= 0.5 * g / np.sqrt(square)
            bias -= 0.5 * error.sum() / np.sqrt(square_b)
        self.bias, self.weights = float(bias), dict(zip(names, w.tolist(), strict=True))

    def of_signs(self, signs: frozenset[str]) -> float:
        if signs not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[signs] = self.bias + sum(self.weights.get(s, prior(s)) for s in signs)
        return self._known[signs]


def best_span(scores: list[float], costs: list[float]) -> tuple[int, int]:
    """The contiguous items lo to hi - 1 of the highest sum of scores and of the costs between them; (0, 0) if no sum is above zero. One pass: the best sum that ends at each item either goes on or begins there."""
    best, span, now, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if i and now + costs[i] > 0:
            now += costs[i]
        else:
            now, begin = 0.0, i
        now += score
        if now > best:
            best, span = now, (begin, i + 1)
    return span


def region(parts: list[Block], weights: Weights, tag: float, labelled: bool = True) -> list[Block]:
    """The blocks of the best contiguous region, but for those whose own signs speak against main text.

    A word scores its block's log odds and its label where the page has an article element or, without one, a main element;
    the tags between two blocks score against joining them. With labelled=False the page's own labels are not looked at.
    """
    which = next((k for k in ("inside", "main") if any(getattr(b, k) for b in parts)), None) if labelled else None
    own = [weights.of_signs(b.signs) for b in parts]
    label = [0.0 if which is None else weights.label[0 if getattr(b, which) else 1] for b in parts]
    scores = [b.words * (max(-MOST, min(MOST, w)) + x) for b, w, x in zip(parts, own, label, strict=True)]
    costs = [b.tags * min(x - tag, -0.01) for b, x in zip(parts, label, strict=True)]
    lo, hi = best_span(scores, costs)
    return [b for b, w in zip(parts[lo:hi], own[lo:hi], strict=True) if w > DROP]


def main_text(page: str | None, weights: Weights) -> str:
    """The main text of a page; empty if no region scores above zero."""
    return " ".join(b.text for b in region(list(blocks(page or "")), weights, weights.tag))


def _labelled(pages: DataFrame) -> DataFrame:
    """About MAX_LABELLED pages (html) with exactly one article element: those below a hash threshold set by their count, so that no task ranks whole pages."""
    labelled = pages.filter(F.regexp_count(F.lower("html"), F.lit("<article[\\s>]")) == 1)
    part = F.pmod(F.xxhash64("html"), F.lit(1024))
    upto, n = 0, 0
    for r in labelled.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():  # 1024 rows at most
        if n and n + r["n"] > MAX_LABELLED:
            break
        upto, n = r["p"] + 1, n + r["n"]
    return labelled.filter(part < upto).select("html")


def fit_weights(pages: DataFrame) -> Weights:
    """Weights from pages (html) that mark their main text by one article element, at most about MAX_LABELLED of them.

    First the signs: at most MAX_SETS sets with their words come back to the driver. Then what a tag costs: the largest of
    TAG_COSTS whose regions, found without looking at the labels, share most words with the labelled ones.
    """

    def count(batches):
        for batch in lines(batches):
            total: Counter = Counter()
            for page in batch.column(0):
                for b in blocks(page.as_py()):
                    if not (b.inside and min(map(prior, b.signs), default=0.0) <= UNCLEAR):
                        total[b.signs, b.inside] += b.words
            if total:
                yield pa.record_batch([pa.array([sorted(s) for s, _ in total], pa.list_(pa.string())), pa.array([k for _, k in total]), pa.array(list(total.values()), pa.int64())], names=["signs", "inside", "words"])

    sample = materialise(_labelled(pages), "labelled-pages")
    counts = sample.mapInArrow(count, "signs array<string>, inside boolean, words long").groupBy("signs", "inside").agg(F.sum("words").alias("words")).orderBy(F.desc("words"), "signs", "inside").limit(MAX_SETS)
    weights = Weights([(frozenset(r["signs"]), r["inside"], r["words"]) for r in counts.collect()])

    def compare(batches):
        for batch in lines(batches):
            hits, all_ = [0] * len(TAG_COSTS), [0] * len(TAG_COSTS)
            for page in batch.column(0):
                parts = list(blocks(page.as_py()))
                for i, cost in enumerate(TAG_COSTS):
                    got = region(parts, weights, cost, labelled=False)
                    hits[i] += 2 * sum(b.words for b in got if b.inside)
                    all_[i] += sum(b.words for b in got) + sum(b.words for b in parts if b.inside)
            yield pa.record_batch([pa.array(TAG_COSTS), pa.array(hits, pa.int64()), pa.array(all_, pa.int64())], names=["cost", "hits", "all"])

    if weights.weights:
        best = sample.mapInArrow(compare, "cost double, hits long, all long").groupBy("cost").agg(F.coalesce(F.try_divide(F.sum("hits"), F.sum("all")), F.lit(0.0)).alias("f1")).orderBy(F.desc(F.round("f1", 6)), F.desc("cost")).first()
        weights.tag = best["cost"]
    discard(sample)
    return weights


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    A null or empty page has an empty text. White space of any kind within a block becomes one space. A page of any length is
    read whole, by one task. Without labelled pages the weights are the priors. Repeated rows are read alike; other columns are
    ignored, whatever they are called; an empty table gives no rows.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    weights = fit_weights(rows)

    def run(batches):
        for b in lines(batches):
            texts = [main_text(x.as_py(), weights) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op6_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
