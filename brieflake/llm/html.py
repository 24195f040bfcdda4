"""HTML main text by the maximum-scoring subsequence.

A page is a sequence of tags and words. Words score by where they stand (nearest block element, link or not, boilerplate
container or not), tags score below zero; the weights are log odds learned from labelled pages, which are those
with exactly one <article> (at most SAMPLE_PAGES of them, by hash of page_id): what stands in it is content. There are two sets of them.
For pages with one filled <article>, features say whether they are inside it. For all other pages they don't, as the
label would be in them; there a labelled page can only show that a kind of text or tag is content, not that it is none (what
stands beside an article may be the content of another page), so the larger of the learned and the prior weight counts. One linear scan
finds the contiguous region of the largest sum. Boilerplate containers, their tags included, count nothing; the region's
text is returned without them.
"""

from __future__ import annotations

import functools
import html as _html
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brieflake.llm.common import sliced

SAMPLE_PAGES = 2000

# Elements and class, id and role words of the HTML vocabulary.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video title".split())
BOILER_TAGS = frozenset("nav footer aside form head title script style noscript template textarea iframe svg math object canvas audio video button select option dialog menu search".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars nav navbar navigation "
    "menu menus breadcrumb breadcrumbs footer comment comments commentlist respond reply replies disqus cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget widgets search pagination pager toolbar masthead copyright hidden".split()
)
HEADER_WORDS = frozenset("header topbar".split())
#: Words that mark a name by themselves, whatever stands beside them.
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion cookie cookies consent gdpr newsletter".split())
#: Words before them that take that back.
WITHOUT_WORDS = frozenset("has no not with without show hide".split())
#: Words that may stand beside those in a class or id without another sense.
BESIDE_WORDS = frozenset("area bar block blocks bottom box button buttons container content count form group hidden icon icons inner item items js link links list main message outer panel post posts row section site text title top wrap wrapper".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NEVER_BOILER = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: Log odds of words before any page is seen, by nearest block.
PRIOR = {"p": 2.0, "h1": 2.0, "h2": 1.5, "h3": 1.5, "h4": 1.0, "h5": 1.0, "h6": 1.0, "blockquote": 1.5, "pre": 1.5, "li": 0.5, "td": 0.5, "dd": 0.7, "figcaption": 0.5}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>|<[!?/][^>]*\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKING = re.compile(r"class|id|role|hidden|style", re.I)


#: What _boiler says of an element.
NO, YES, COMMENTS, ADVERT = range(4)
#: Words of a long paragraph, and how many make a container with a heading article text in spite of its name.
LONG, LONG_PARAGRAPHS = 40, 2


def _marked(value: str, in_article: bool, tag: str) -> int:
    """What a class or id attribute says. YES: a name only says boilerplate, as each of its words does or stands beside one that
    does; COMMENTS, ADVERT: a name holds a word for readers' comments or adverts among others."""
    found = NO
    for name in value.split():
        order = [w.lower() for w in _WORDS.findall(name)]
        words = set(order)
        said = words & BOILER_WORDS if in_article else words & (BOILER_WORDS | HEADER_WORDS)
        if tag == "article":  # an article is one unless it is a reader's or an advertiser's
            said &= {"comment", "comments", "reply", "ad", "advert", "sponsored", "related"}
        if said and words <= said | BOILER_WORDS | BESIDE_WORDS:
            return YES
        if order and order[0] not in WITHOUT_WORDS:
            found = max(found, COMMENTS if words & COMMENT_WORDS else ADVERT if words & ADVERT_WORDS else NO)
    return found


_INLINE_KEEP = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())


@functools.lru_cache(maxsize=50_000)
def _boiler(tag: str, attrs: str, in_article: bool) -> int:
    if tag in BOILER_TAGS:
        return YES
    if tag == "header" and not in_article:
        return YES
    found = NO
    if not attrs or tag in NEVER_BOILER or not _MARKING.search(attrs):
        return found
    for m in _ATTR.finditer(attrs):
        name, raw = m[1].lower(), m[2] or m[3] or m[4] or ""
        value = raw.lower()
        if name in ("class", "id"):
            said = _marked(raw, in_article, tag)
            if said == YES:
                return YES
            found = max(found, said)
        elif name == "role" and value in BOILER_ROLES:
            return YES
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return YES
    return found


def _article_like(page: str, at: int, tag: str, said: int) -> bool:
    """Whether the container that opens before `at` holds a heading (beside comment words: the page's, h1) and long paragraphs."""
    depth, end = 1, len(page)
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            end = m.start()
            break
    inner = page[at:end]
    if not re.search(r"<h1[\s>]" if said == COMMENTS else r"<h[1-3][\s>]", inner, re.I):
        return False
    long = (m for m in re.finditer(r"<p(?:\s[^>]*)?>(.*?)(?=</p|<p[\s>]|\Z)", inner, re.I | re.S) if len(re.sub(r"<[^>]*>", " ", m[1]).split()) >= LONG)
    return len(list(itertools.islice(long, LONG_PARAGRAPHS))) == LONG_PARAGRAPHS


def scan(page: str | None) -> Iterator[tuple[str, str, str | None, bool, bool, bool]]:
    """(kind t or w, feature, text or None, starts a block, inside <article>, boilerplate) of each tag and text run."""
    page = page or ""
    stack: list[tuple[str, bool, bool, str]] = []  # open containers: tag, boilerplate, in article, nearest block
    at, end = 0, len(page)
    block = "body"  # innermost block for words, p and headings included
    linked = False  # in a link

    def text(raw: str):
        boiler, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        return "w", "w:in" if boiler else f"w:{block}{'@' if linked else ''}{'/a' if inside else ''}", raw, False, inside, boiler

    def marked(tag: str, attrs: str, inside: bool) -> bool:
        said = _boiler(tag, attrs, inside)
        return said == YES or said > YES and (tag not in BLOCKS or not _article_like(page, at, tag, said))

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            yield text(page[at:])
            break
        if m.start() > at:
            yield text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        boiler, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        known = tag if tag in BLOCKS or tag in _INLINE_KEEP or tag in RAW else "other"
        if tag == "a" or tag in BLOCKS:  # a block ends an open link
            linked = tag == "a" and not closing
        if closing:
            if tag in BLOCKS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        block = stack[i][3]
                        del stack[i:]
                        break
                else:
                    if tag == "p" or tag[0] == "h":
                        block = stack[-1][0] if stack else "body"
            inside = stack[-1][2] if stack and tag != "article" else inside and tag != "article"
            yield "t", "t:in" if boiler else f"t:/{known}{'/a' if inside else ''}", None, tag in BLOCKS, inside, boiler
            continue
        here = boiler or marked(tag, m[3], inside)
        yield "t", "t:in" if boiler else f"t:{'x' if here else known}{'/a' if inside else ''}", None, tag in BLOCKS, inside, here
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if tag in ("title", "textarea", "script", "style", "iframe", "noscript", "template") or close:
                at = close.start() if close else end
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "p" or re.fullmatch(r"h[1-6]", tag):
            # paragraphs and headings don't nest; a marked one is boilerplate until the next block
            while stack and (stack[-1][0] == "p" or re.fullmatch(r"h[1-6]", stack[-1][0])):
                stack.pop()
            boiler, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            stack.append((tag, boiler or marked(tag, m[3], inside), inside, block if block != tag else "body"))
            block = tag
        elif tag in BLOCKS:
            while stack and stack[-1][0] == "p":  # a block ends an open paragraph
                stack.pop()
            boiler, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            stack.append((tag, boiler or marked(tag, m[3], inside), inside or tag == "article", block))
            block = tag
        elif here and not boiler:
            # a marked inline element: hold it as a container until it closes
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if close:
                at = close.end()


def labelled(items: list[tuple[str, str, str | None, bool, bool, bool]], page: str | None) -> bool:
    """Whether the page, scanned to items, has exactly one <article>, with words of content in it."""
    one = page and len(re.findall(r"<article[\s>]", page, re.I)) == 1
    return bool(one) and any(kind == "w" and inside and not boiler and raw.strip() for kind, _, raw, _, inside, boiler in items)


def label_counts(page: str | None) -> dict[str, list[int]]:
    """feature -> [content, other] of a labelled page, with the label in them and (any:) without; empty if it isn't one."""
    items = list(scan(page))
    if not labelled(items, page):
        return {}
    found: dict[str, list[int]] = {}
    for kind, feature, raw, _, inside, boiler in items:
        n = len(raw.split()) if kind == "w" else 1
        if n and not feature.endswith(":in"):
            for key in (feature, "any:" + feature.removesuffix("/a")):
                found.setdefault(key, [0, 0])[0 if inside and not boiler else 1] += n
    return found


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log odds, words at most 1, tags below zero; little below inside an article, whose region shall not break there."""
    out = {}
    for feature, (pos, neg) in counts.items():
        odds, inside = math.log((pos + 0.5) / (neg + 0.5)), feature.endswith("/a")
        if feature.removeprefix("any:")[0] == "w":
            out[feature] = min(1.0, max(-0.02 if inside else -0.1, odds))
        else:
            out[feature] = max(-0.1 if inside else -5.0, min(-0.02, odds))
    return out


def prior(feature: str) -> float:
    """Of a word or tag before any page is seen. Words of links count little but in paragraphs and headings."""
    name = feature[2:].removesuffix("/a")
    if feature[0] == "t":
        return -0.02 if feature.endswith("/a") else -0.1
    block, linked = name.removesuffix("@"), name.endswith("@")
    if linked and PRIOR.get(block, 0) < 1:
        return 0.05
    return min(1.0, PRIOR.get(block, 0.3 if not feature.endswith("/a") else 1.0))


def weight(model: dict[str, float], feature: str, labelled: bool) -> float:
    """Of a word or tag, on a page with one filled <article> or another. What is in a boilerplate container counts nothing."""
    if feature.endswith(":in"):
        return 0.0
    if labelled:
        got = model.get(feature)
        return got if got is not None else -2.0 if feature == "t:x" else prior(feature)
    plain = feature.removesuffix("/a")
    if plain == "t:x":
        return 0.0
    return max(prior(plain), model.get("any:" + plain, -9.0))


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous part with the largest sum, the first of equal ones; (0, 0) if none is above zero."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, model: dict[str, float]) -> str:
    items = list(scan(page))
    known = labelled(items, page)
    start, end = best_region([weight(model, feature, known) * (len(raw.split()) if kind == "w" else 1) for kind, feature, raw, _, _, _ in items])
    blocks, now = [], []
    for kind, feature, raw, cut, _, boiler in items[start:end]:
        if kind == "w":
            if not boiler:
                now.append(_html.unescape(raw))
        elif cut:
            blocks.append("".join(now))
            now = []
        elif feature in ("t:br", "t:br/a"):
            now.append(" ")
    blocks.append("".join(now))
    return "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most sample_pages labelled pages; features are pairs of a fixed vocabulary."""
    rows = pages.filter("page_id is not null").select("page_id", "html", F.xxhash64("html").alias("hh"))
    keys = rows.filter(F.lower("html").contains("<article")).select("page_id", "hh", F.xxhash64(F.lit(3), "page_id", "hh").alias("h")).distinct().orderBy("h", "page_id").limit(sample_pages).select("page_id", "hh")
    # at most sample_pages keys, and a page for each, however often a row is repeated
    sample = rows.join(F.broadcast(keys), ["page_id", "hh"]).dropDuplicates(["page_id", "hh"]).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch.column("html"):
                for f, (a, b) in label_counts(page.as_py()).items():
                    t = total.setdefault(f, [0, 0])
                    t[0] += a
                    t[1] += b
        yield pa.RecordBatch.from_pydict({"f": pa.array(list(total), pa.string()), "a": pa.array([x[0] for x in total.values()], pa.int64()), "b": pa.array([x[1] for x in total.values()], pa.int64())})

    got = sample.mapInArrow(run, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    return weights({r.f: (r.a, r.b) for r in got})


def extract_pages(pages: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html, or one without words: empty text, 0. Very long pages: read whole. Equal regions: the first. No labelled pages: prior weights alone. Repeated rows
    and ids: each row is a page. Empty table: no rows. Other columns are ignored.
    """
    model = fit(pages) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [extract(p.as_py(), model) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
