"""HTML extraction by equivalence classes of template tokens.

Tokens of a page are its element paths and its blocks of text, each with the path it
stands in.  Over the pages of a host a token has an occurrence vector: how often it
occurs on each page.  Tokens with equal vectors form an equivalence class if they are on
``SUPPORT`` of the pages or more.  A class is valid if it has several tokens that keep
their places in one order on its pages, over and over where they occur more than once, and never
cross a class of more pages (``NOISE`` of its pages may differ); tokens that change their
places are left out of it.  Valid classes nest: each
opens in a gap between two tokens of the one around it.  The gaps that the nested
template leaves open are its slots.  Pages that hold the same
article count as one page, so copies of an article are no template: what repeats beside unlike text is.

Vectors are never gathered.  Each token's vector is folded into fingerprints (XOR and sum
over pages of a hash of page and count), which tasks combine before the shuffle,
so a host with a third of all pages is no larger than any other.

The host's article slots are those with ``SLOT_SHARE`` of its slot text, and headings on
``SUPPORT`` of its pages; where most slot text is in article (or main) elements, only
slots that are mostly in these.  A host's main path is the innermost element that holds them.
A page's article is its slots' text below the main path, or, if half of the text is
elsewhere, all of it; on pages with article elements only what is in these.  Text of the
template is no article text; inside of an article element only that of classes on
``ALWAYS`` of the host's pages, as an article may quote what others do.  Navigation,
headers, footers, asides, forms, notices, adverts, comments and the like are never
article text; they vary from page to page, so that no template shows them.  Headings in
an article's own header are its text.

Null and empty html give the empty text.  Hosts of few pages have no template;
structure alone decides.  A null url is a host of its own.  Rows that repeat are
extracted alike.  Very long pages are parsed whole, one at a time.  No pages give no rows.
Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import sliced, table, written

#: Share and number of a host's pages that a template token must be on at least.
SUPPORT, MIN_PAGES = 0.3, 4
#: Share of a host's slot text that a slot of its article has at least, if it holds no heading.
SLOT_SHARE = 0.03
#: Tokens that a class must have at least.
MIN_TOKENS = 2
#: Share of a class's pages that may break its order or its nesting.
NOISE = 0.1
#: Share of a host's pages that a class is on if its text is no article's, not even in article elements.
ALWAYS = 0.9
#: Tokens of all hosts' templates, some 40 bytes each, up to which these are broadcast; parts of a host's pages beyond.
MAX_TOKENS, PARTS = 1_000_000, 64

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg annotation textarea select title head canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME_TAGS = frozenset("nav header footer aside form menu button dialog fieldset label".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted promotion recommended related replies reply respond share sharing sidebar sidebars signup skip social sponsor "
    "sponsored subscribe toolbar topbar widget widgets".split()
)
#: Words of furniture that also name layouts around the article.
SIDE_WORDS = frozenset("ad ads banner footer header menu nav navbar sidebar sidebars widget widgets".split())
LAYOUT_WORDS = frozenset("container content layout main page wrap wrapper".split())
#: Words that turn a class into a statement about what is there or not.
STATE_WORDS = frozenset("allow closed disabled elementor enabled has have hide no not open with without".split())
#: What is left of a class's name that says that a paragraph or the like is furniture.
PART_WORDS = frozenset("bar block box button count counts item label line link links list note row slot text title unit".split())
#: What may stand beside words of furniture in the name of furniture within an article.
PLACE_WORDS = frozenset("area article articles bottom buttons container content inline inner left post posts right section sections stories top wrap wrapper".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th b i em strong span a".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond".split())
COMMENT_PARTS = COMMENT_WORDS | frozenset("alt body box content depth even inner item odd single thread".split())
MAIN_TAGS = frozenset(("article", "main"))
#: An opening tag of the first kind ends open elements of the second, up to those of the third.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
}

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|[!?/][^>]*(?:>|\Z))", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")


class Block:
    """A block of text: where it stands, whether in an article element, whether in page furniture,
    whether in an article element inside what is called a sidebar or the like."""

    __slots__ = ("path", "text", "in_main", "chrome", "doubtful")

    def __init__(self, path: str, text: str, in_main: bool, chrome: bool, doubtful: bool):
        self.path, self.text, self.in_main, self.chrome, self.doubtful = path, text, in_main, chrome, doubtful

    @property
    def token(self) -> int:
        return _hash(f"t{self.path}\n{self.text}")


#: Kinds of furniture: none, an article's own header, by a class that may be the layout's, by a class, by element or role.
NONE, HEAD, SIDE, NAMED, FIXED = range(5)


def _kind_of(name: str, tag: str, inside: bool) -> int:
    """What one class or id says of its element.  Within an article, and of elements that hold running text, only a name that says nothing
    else makes furniture: ``promo-box`` does, ``promotion-history`` does not."""
    words = _WORDS.findall(name)
    named = CHROME_WORDS.intersection(words)
    if not named or tag in ("html", "body", "main") or not STATE_WORDS.isdisjoint(words):
        return NONE
    if tag in TEXT_TAGS and not (CHROME_WORDS | COMMENT_PARTS | PART_WORDS).issuperset(words):
        return NONE
    if inside and tag != "article" and not (CHROME_WORDS | COMMENT_PARTS | PART_WORDS | PLACE_WORDS).issuperset(words):
        return NONE
    if tag == "article":
        return NAMED if named & COMMENT_WORDS and COMMENT_PARTS.issuperset(words) else NONE
    if not named <= SIDE_WORDS:
        return NAMED
    return NONE if words[0] not in SIDE_WORDS and not LAYOUT_WORDS.isdisjoint(words) else SIDE


def _attributes(tag: str, rest: str, inside: bool) -> tuple[str, int]:
    """The element's name in paths, with its classes, and what kind of page furniture it is."""
    chrome = FIXED if tag in CHROME_TAGS else NONE
    name = tag
    if "=" in rest or "hidden" in rest:
        for key, *values in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), "".join(values).lower()
            if key == "class":
                name += "." + ".".join(sorted(value.split()))
            if key == "role" and value in CHROME_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                chrome = FIXED
            if key in ("class", "id"):
                chrome = max([chrome, *(_kind_of(x, tag, inside) for x in value.split())])
    return name, chrome


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """The page's blocks of text in order, and its tokens in order."""
    blocks: list[Block] = []
    tokens: list[int] = []
    stack: list[tuple[str, str, bool, int, bool]] = [("", "", False, NONE, False)]  # tag, path, in main, furniture, doubtful
    pieces: list[str] = []
    at, size = 0, len(page)
    lower = None

    def flush() -> None:
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                _, path, main, chrome, doubtful = stack[-1]
                blocks.append(Block(path, text, main, chrome > NONE, doubtful))
                tokens.append(blocks[-1].token)

    def close(k: int) -> None:
        flush()
        del stack[k:]

    def close_tags(tags: frozenset, stops: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                close(k)
            elif stack[k][0] in stops:
                return

    p_only, p_stops = frozenset(("p",)), frozenset(("button", "table", "td", "th", "article", "section", "div", "body"))
    while at < size:
        found = _TAG.search(page, at)
        if not found:
            # a tag that never ends is no text
            tail = re.search(r"<[a-zA-Z/!]", page[at:])
            pieces.append(page[at : at + tail.start()] if tail else page[at:])
            break
        if found.start() > at:
            pieces.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag in BLOCK:
                        close(k)
                    elif not any(s[0] in BLOCK for s in stack[k + 1 :]):
                        if stack[k][3] != stack[k - 1][3]:
                            flush()
                        del stack[k:]
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
            else:
                if tag == "p" or tag in BLOCK:
                    flush()
            continue
        if tag in RAW:
            if tag == "head":
                continue
            lower = page.lower() if lower is None or len(lower) != size else lower
            end = lower.find(f"</{tag}", at) if len(lower) == size else page.find(f"</{tag}", at)
            tokens.append(_hash(f"e{stack[-1][1]}/{tag}"))
            if not found[3].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                if end < 0:
                    at = size
                else:
                    stop = page.find(">", end)
                    at = size if stop < 0 else stop + 1
            continue
        if tag == "br" or tag == "hr" or tag == "wbr" or tag in VOID:
            if tag == "hr":
                flush()
            elif tag != "wbr":
                pieces.append(" ")
            continue
        name, chrome = _attributes(tag, found[3], stack[-1][2])
        if tag in BLOCK:
            flush()
            if tag in ENDS:
                close_tags(*ENDS[tag])
            close_tags(p_only, p_stops)
        _, path, in_main, up, doubtful = stack[-1]
        if tag == "main" and up < FIXED or tag == "article" and up == SIDE:
            doubtful = tag == "article"
            up = NONE
        if tag == "header" and in_main and up == NONE and _attributes("div", found[3], True)[1] == NONE:
            chrome = HEAD
        elif tag in HEADINGS and up == HEAD:
            up = NONE
        if chrome != up and chrome:
            flush()
        path = f"{path}/{name}"
        tokens.append(_hash("e" + path))
        stack.append((tag, path, in_main or tag in MAIN_TAGS, max(up, chrome), doubtful))
    flush()
    return blocks, tokens


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) >> 1


def page_items(blocks: list[Block], tokens: list[int]) -> list[tuple[int, int, int, int, str | None]]:
    """The page's tokens: each with its count on the page and, for text outside of furniture, its length,
    its length if in an article element, and its path."""
    seen: dict[int, list] = {}
    for t in tokens:
        seen.setdefault(t, [0, 0, 0, None])[0] += 1
    for b in blocks:
        if not b.chrome and not b.doubtful:
            seen[b.token][1:] = len(b.text), len(b.text) * b.in_main, b.path
    return [(t, *v) for t, v in seen.items()]


_ITEM = ("token", "n", "size", "main", "path")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, a number for the page's text outside of furniture, its tokens in order, and each once with what it is."""
    item = pa.struct([(k, pa.string() if k == "path" else pa.int64()) for k in _ITEM])
    for batch in sliced(batches):
        bodies, orders, items = [], [], []
        for page in batch.column(1).to_pylist():
            blocks, tokens = blocks_of(page)
            bodies.append(_hash("\n".join(b.text for b in blocks if not b.chrome)))
            orders.append(tokens)
            items.append([dict(zip(_ITEM, x, strict=True)) for x in page_items(blocks, tokens)])
        arrays = [batch.column(0), pa.array(bodies, pa.int64()), pa.array(orders, pa.list_(pa.int64())), pa.array(items, pa.list_(item))]
        yield pa.RecordBatch.from_arrays(arrays, ["host", "body", "tokens", "items"])


_PARSED = "host string, body long, tokens array<long>, items array<struct<token: long, n: long, size: long, main: long, path: string>>"


def _with_hosts(pages: DataFrame, hosts: DataFrame, size: Column, part: Column) -> DataFrame:
    """``pages`` with what a written table knows of their hosts: broadcast if it is small, else
    each host's pages are dealt out in parts, so that a host with a third of all pages is split."""
    if (hosts.agg(F.sum(1 + F.coalesce(size, F.lit(0)))).first()[0] or 0) <= MAX_TOKENS:
        return pages.join(F.broadcast(hosts), "host", "left")
    parts = hosts.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return pages.withColumn("__part", F.pmod(part, F.lit(PARTS)).cast("int")).join(parts, ["host", "__part"], "left").drop("__part")


def _one() -> Column:
    """Of several pages that count as one, always the same one."""
    return F.min_by(F.struct("tokens", "items"), F.xxhash64("tokens", "items"))


def _unlike(pages: DataFrame) -> DataFrame:
    """(host, page, tokens, items): of pages that hold the same article, one.

    These have the same text, or the same longest block of those that are not on half of the host's pages.
    """
    distinct = written(pages.mapInArrow(_parsed, _PARSED).groupBy("host", "body").agg(_one().alias("one")).select("host", "body", "one.*"), "html-pages")
    hosts = distinct.groupBy("host").agg(F.count("*").alias("all_pages"))
    common = (
        distinct.select("host", F.explode(F.expr("transform(filter(items, x -> x.size > 0), x -> x.token)")).alias("token"))
        .groupBy("host", "token")
        .agg(F.count("*").alias("pages"))
        .join(hosts, "host")
        .filter((F.col("pages") >= MIN_PAGES) & (2 * F.col("pages") >= F.col("all_pages")))
        .groupBy("host")
        .agg(F.collect_list("token").alias("common"))
    )
    common = written(common, "html-common")
    own = F.expr("array_max(transform(filter(items, x -> x.size > 0 AND NOT array_contains(coalesce(common, array()), x.token)), x -> struct(x.size, x.token))).token")
    joined = _with_hosts(distinct, common, F.size("common"), F.col("body"))
    rows = joined.select("host", F.coalesce(own, "body").alias("page"), "tokens", "items")
    return written(rows.groupBy("host", "page").agg(_one().alias("one")).select("host", "page", "one.*"), "html-unlike")


def common_ancestor(paths: list[str]) -> str:
    """The path of the innermost element that holds all of some blocks' elements."""
    split = [p.split("/")[:-1] for p in paths]
    shared = next((k for k, x in enumerate(zip(*split, strict=False)) if len(set(x)) > 1), min(map(len, split), default=0))
    return "/".join(split[0][:shared]) if split else ""


@F.pandas_udf(T.StringType())
def _above(paths: pd.Series) -> pd.Series:
    return paths.map(common_ancestor)


def _sweep(tokens: list[int], classes: dict[int, tuple[int, int]], lengths: dict[int, int], without: set[int]) -> tuple[list[tuple[int, int]], int | None]:
    """The gap that each token is in; the sweep ends at the first crossing, with the class of fewer pages."""
    gaps: list[tuple[int, int]] = []
    stack: list[list[int]] = []  # class, pages, tokens seen
    for t in tokens:
        c, pages = classes.get(t, (None, 0))
        if c is not None and c not in without:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), None)
            if at is None:
                stack.append([c, pages, 0])
            elif at < len(stack) - 1:
                return gaps, min((on, other) for other, on, _ in stack[at:])[1]
            stack[-1][2] += 1
            if stack[-1][2] == lengths[c]:
                stack.pop()
        gaps.append((stack[-1][0], stack[-1][2]) if stack else (0, 0))
    return gaps, None


def nested(tokens: list[int], classes: dict[int, tuple[int, int]], lengths: dict[int, int]) -> tuple[list[tuple[int, int]], set[int]]:
    """Nest a page's classes: the gap (class, number) that each of its tokens is in, and the classes left out as
    they cross one of more pages.

    ``classes``: each token's class and on how many pages that is; ``lengths``: number of tokens of each class.
    """
    crossing: set[int] = set()
    while True:
        gaps, lost = _sweep(tokens, classes, lengths, crossing)
        if lost is None:
            return gaps, crossing
        crossing.add(lost)


def places_of(tokens: list[int], length: int) -> list[tuple[int, int | None]]:
    """Each token of a class on a page with its place in their order; None if they do not keep one over and over."""
    first = tokens[:length]
    kept = len(set(first)) == length and tokens == first * (len(tokens) // length)
    return [(t, k if kept else None) for k, t in enumerate(dict.fromkeys(tokens))]


def _host_classes(known: dict, host: str | None, found: list | None) -> tuple[dict, dict]:
    """A host's classes as ``nested`` takes them; those of the last hosts of the task are kept."""
    if host not in known:
        if len(known) >= 100:
            known.clear()
        lengths: dict[int, int] = {}
        for x in found or ():
            lengths[x["class"]] = lengths.get(x["class"], 0) + 1
        known[host] = {x["token"]: (x["class"], x["pages"]) for x in found or ()}, lengths
    return known[host]


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, place) of the classes' tokens on every page; null where the order is broken or the class crosses."""
    known: dict = {}
    for batch in sliced(batches):
        out: list[tuple] = []
        for host, tokens, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            classes, lengths = _host_classes(known, host, found)
            _, crossing = nested(tokens, classes, lengths)
            orders: dict[int, list[int]] = {}
            for t in tokens:
                if t in classes:
                    orders.setdefault(classes[t][0], []).append(t)
            for c, x in orders.items():
                out += [(host, t, None if c in crossing else k) for t, k in places_of(x, lengths[c])]
        arrays = [pa.array([x[k] for x in out], pa.int64() if k else pa.string()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(arrays, ["host", "token", "place"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, class, gap, path, chars, main) of the text that each page has in each slot."""
    known: dict = {}
    names = ["host", "class", "gap", "path", "chars", "main"]
    for batch in sliced(batches):
        out: list[tuple] = []
        for host, tokens, items, found in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            classes, lengths = _host_classes(known, host, found)
            texts = {x["token"]: x for x in items}
            gaps, _ = nested(tokens, classes, lengths)
            slots: dict[tuple, list[int]] = {}
            for t, gap in zip(tokens, gaps, strict=True):
                if t in texts and t not in classes:
                    slot = slots.setdefault((*gap, texts[t]["path"]), [0, 0])
                    slot[0] += texts[t]["size"]
                    slot[1] += texts[t]["main"]
            out += [(host, *k, *v) for k, v in slots.items()]
        arrays = [pa.array([x[k] for x in out], pa.string() if k in (0, 3) else pa.int64()) for k in range(6)]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _classes(unlike: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, found): each host's valid classes, a struct of token, class and pages a token.

    A token of a class is on ``SUPPORT`` of the pages, so the tokens of a host are bounded by the size of a page.
    """
    mixed = F.xxhash64("page", "item.n")
    frequent = (
        unlike.select("host", "page", F.explode("items").alias("item"))
        .groupBy("host", F.col("item.token").alias("token"))
        .agg(F.count("*").alias("pages"), F.bit_xor(mixed).alias("vec_xor"), F.sum(mixed.bitwiseAND(0x3FFFFFFF)).alias("vec_sum"))
        .filter(F.col("pages") >= MIN_PAGES)
        .join(hosts, "host")
        .filter(F.col("pages") >= SUPPORT * F.col("all_pages"))
    )
    equal = written(
        frequent.groupBy("host", F.xxhash64("vec_xor", "vec_sum", "pages").alias("class"), "pages")
        .agg(F.collect_list("token").alias("tokens"))
        .filter(F.size("tokens") >= MIN_TOKENS),
        "html-equal",
    )
    each = equal.select("host", F.explode("tokens").alias("token"), "class", "pages")
    listed = F.collect_list(F.struct("token", "class", "pages")).alias("found")
    candidates = written(each.groupBy("host").agg(listed), "html-candidates")
    seen = _with_hosts(unlike.select("host", "tokens", "page"), candidates, F.size("found"), F.col("page")).filter("found IS NOT NULL")
    places = seen.select("host", "tokens", "found").mapInArrow(_orders, "host string, token long, place long").groupBy("host", "token", "place").agg(F.count("*").alias("n"))
    counts = places.groupBy("host", "token").agg(F.sum("n").alias("all"), F.max(F.when(F.col("place").isNotNull(), F.col("n"))).alias("most"))
    kept = counts.filter(F.col("most") >= (1 - NOISE) * F.col("all")).select("host", "token")
    valid = each.join(kept, ["host", "token"]).groupBy("host", "class", "pages").agg(F.collect_list("token").alias("tokens")).filter(F.size("tokens") >= MIN_TOKENS)
    return written(valid.select("host", F.explode("tokens").alias("token"), "class", "pages").groupBy("host").agg(listed), "html-classes")


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, always, main_path): each host's template tokens, those on nearly all pages, and the path that its articles are below."""
    unlike = _unlike(pages)
    hosts = unlike.groupBy("host").agg(F.count("*").alias("all_pages"))
    valid = _classes(unlike, hosts)
    texts = F.expr("transform(filter(items, x -> x.size > 0), x -> struct(x.token AS token, x.size AS size, x.main AS main, x.path AS path))")
    rows = _with_hosts(unlike.select("host", "tokens", texts.alias("texts"), "page"), valid, F.size("found"), F.col("page"))
    found = (
        rows.select("host", "tokens", "texts", "found")
        .mapInArrow(_slots, "host string, class long, gap long, path string, chars long, main long")
        .groupBy("host", "class", "gap", "path")
        .agg(F.sum("chars").alias("chars"), F.sum("main").alias("main"), F.count("*").alias("times"))
    )
    found = written(found, "html-slots")
    whole = found.groupBy("host").agg(F.sum("chars").alias("all_chars"), F.sum("main").alias("all_main")).join(hosts, "host")
    large = F.col("chars") >= SLOT_SHARE * F.col("all_chars")
    heading = F.col("path").rlike("/h[1-3](\\.[^/]*)?$") & (F.col("times") >= SUPPORT * F.col("all_pages"))
    evident = (2 * F.col("main") > F.col("chars")) | (2 * F.col("all_main") <= F.col("all_chars"))
    # of large slots there are 1 / SLOT_SHARE at most, of a host's headings as many as a page has
    slots = found.join(whole, "host").filter((large | heading) & evident).groupBy("host").agg(F.collect_list("path").alias("slots")).withColumn("main_path", _above("slots"))
    tokens = F.expr("transform(found, x -> x.token)").alias("tokens")
    always = F.expr(f"transform(filter(found, x -> x.pages >= {ALWAYS} * all_pages), x -> x.token)").alias("always")
    return written(hosts.join(valid, "host", "left").join(slots, "host", "left").select("host", tokens, always, "main_path"), "html-templates")


def article(page: str, template: set[int], main_path: str | None, always: set[int] = frozenset()) -> list[str]:
    """The page's blocks of article text."""
    blocks, _ = blocks_of(page)
    blocks = [b for b in blocks if not b.chrome]
    size = lambda some: sum(len(b.text) for b in some)
    if any(b.in_main and not b.doubtful for b in blocks):
        slots = [b for b in blocks if b.in_main and not b.doubtful and b.token not in always]
    else:
        doubtful = [b for b in blocks if b.doubtful]
        if 2 * size(doubtful) > size(blocks):
            return [b.text for b in doubtful]
        slots = [b for b in blocks if not b.doubtful and b.token not in template]
    inside = [b for b in slots if main_path and (b.path == main_path or b.path.startswith(main_path + "/"))]
    return [b.text for b in (inside if 2 * size(inside) > size(slots) else slots)]


def _extract(at_html: int, n: int):
    """html, tokens, always and main path are columns ``at_html`` and those after it; ``n`` columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, set] = {}

        def as_set(tokens: list[int] | None) -> set:
            if len(sets) >= 100:
                sets.clear()
            return sets.setdefault(np.array(tokens or (), np.int64).tobytes(), set(tokens or ()))

        for batch in sliced(batches):
            texts = []
            for page, tokens, always, main in zip(*(batch.column(at_html + k).to_pylist() for k in range(4)), strict=True):
                texts.append("\n".join(article(page, as_set(tokens), main, as_set(always))) if page else "")
            columns = [*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:n], "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("host", host)
    found = templates(rows.select("host", "html"))
    joined = _with_hosts(rows, found, 2 * F.size("tokens"), F.xxhash64("page_id", "url")).select("page_id", "url", "html", "tokens", "always", "main_path")
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return joined.mapInArrow(_extract(2, 2), schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
