"""WARC archives and HTML extraction."""

from __future__ import annotations

import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from ravelin.llm import html_text, warc
from ravelin.llm.common import shared_path
from tests.compare import SMALL, check

PAGES = "page_id long, url string, html string, digest string, text string"


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://www.Example.com:443/A/b?x=1#top", "com,example)/a/b?x=1"),
        ("http://a.b.example.org", "org,example,b,a)/"),
        ("http://h.example.net:8080/", "net,example,h:8080)/"),
        ("", ""),
        (None, ""),
        ("no url", "no url"),
        ("http://[bad/", "http://[bad/"),
    ],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_warc_sql(spark):
    check(spark, warc.op7_warc, warc.SQL)


def test_round_trip(spark):
    big = "é" * 80
    rows = [(k, f"http://h{k % 40}.example.org/{k}", f"page {k} " + "x" * (k % 300)) for k in range(700)]
    rows += [(900, "http://e.org/", None), (901, None, ""), (902, "http://d.org/a b\r\nX: 1", big), (903, "http://d.org/", big), (None, None, big), (904, "http://s.org/", "tiny"), (905, "http://s.org/", "tiny")]
    rows += [(906, "http://r.org/", "again" * 40)] * 2 + [(907, "http://long.org/", "\r\n\r\n\0<p>" * 100_000)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], PAGES).repartition(3)
    got = warc.captures(df).collect()
    assert len(got) == len(rows)
    first: dict[bytes, int] = {}
    for p, _, h in rows:
        if p is not None:
            data = (h or "").encode()
            first[data] = min(p, first.get(data, p))
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and first[data] != p
        want.append((str(p), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(key, ((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(key, want))
    assert warc.captures(df.limit(0)).count() == 0


def test_files_are_gzip_members_and_ranges_read_alone(spark):
    df = spark.createDataFrame([(k, f"http://x.org/{k}", f"<p>{k}</p>" * 50, "", "") for k in range(600)], PAGES).coalesce(1)
    path = shared_path(spark, "warc-test")
    warc.write_archives(df, path)
    files = glob.glob(f"{path.removeprefix('file:')}/part-*")
    data = b"".join(gzip.open(f).read() for f in files)
    assert data.count(b"WARC/1.1\r\n") == 600
    index = warc.build_index(spark, path)
    assert index.count() >= 3
    wanted = spark.createDataFrame([(warc.capture_key("http://x.org/17", 17),), (warc.capture_key("http://x.org/599", 599),), ("none",)], "key string")
    places = warc.look_up(index, wanted)
    assert places.count() == 2
    rows = warc.read_records(places, path).collect()
    assert sorted(r["page_id"] for r in rows) == [17, 599]
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    slices = places.groupBy("file").cogroup(whole.groupBy("file")).applyInPandas(warc._read_slices, warc._READ).collect()
    assert sorted(map(tuple, slices)) == sorted(map(tuple, rows))


ODD = (
    '<html><body class="page"><div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header><aside>x</aside>'
    "<div class=content><h2>Title &amp; more</h2><p>Hello <b>wor</b>ld&nbsp;now<br>next<p>Second &#233;&hellip;<ul><li>a<li>b</ul>"
    "<form><input>f</form><!-- <p>no</p> --><script>var t='</p><p>x'</script><div class='comments'><p>c1</div></div><footer>f</footer></body>"
)


def test_blocks():
    text = lambda page: html_text.article(page, set(), None)
    assert text(ODD) == ["Title & more", "Hello world now next", "Second é…", "a", "b"]
    assert text("<nav>n</nav><article><h1>T</h1><p>x <i>y</i>\n z<aside>no</aside><p>w</article><p>out") == ["T", "x y z", "w"]
    assert text("") == [] and text("just text &lt; more") == ["just text < more"]
    assert text("<article><p>cut &am") == ["cut &am"] and text("<article><p>cut <a hre") == ["cut"]
    assert text("<p>a</div></p></ul>b<table><tr><td>1<td>2</table>") == ["a", "b", "1", "2"]
    assert text("<article>" + "<div>" * 500 + "deep") == ["deep"]


def test_templates_drop_what_repeats(spark):
    rows = []
    for k in range(12):
        body = f"<div class=top>Welcome to our site</div><div class=body><p>Story {k} begins</p><p>and ends {k * 7}</p></div><div class=end>All rights kept</div>"
        rows.append((k, f"http://one.org/{k}", f"<html><body>{body}</body></html>", "", ""))
    rows += [(50, "http://one.org/none", None, "", ""), (51, None, "<p>x</p>", "", ""), (None, "http://solo.org", "<p>a<p>b", "", ""), (50, "http://one.org/none", None, "", "")]
    df = spark.createDataFrame(rows, PAGES)
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    for k in range(12):
        text = f"Story {k} begins\nand ends {k * 7}"
        assert got[k, f"http://one.org/{k}"] == (text, len(text))
    assert got[50, "http://one.org/none"] == ("", 0) and got[51, None] == ("x", 1) and got[None, "http://solo.org"] == ("a\nb", 3)
    assert html_text.extract(df).count() == len(rows) and html_text.extract(df.limit(0)).count() == 0


def test_articles_that_repeat_stay(spark):
    page = "<nav>menu</nav><article><h1>Same</h1><p>words</article>"
    df = spark.createDataFrame([(k, "http://copies.org/", page, "", "") for k in range(20)], PAGES)
    assert {r["text"] for r in html_text.extract(df).collect()} == {"Same\nwords"}


def test_given_pages_keep_exactly_their_article(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in html_text.op10_html_extraction(spark, SMALL).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p)


def test_classes_around_and_of_articles():
    text = lambda page: html_text.article(page, set(), None)
    for name in ("content-sidebar-wrap", "has-sidebar", "elementor-widget elementor-widget-container", "sidebar-right", "related"):
        assert text(f"<div class='{name}'><main><h1>T</h1><p>x</main></div>") == ["T", "x"]
    for name in ("content-sidebar-wrap", "has-sidebar", "elementor-widget-container", "comments-open"):
        assert text(f"<div class='{name}'><h1>T</h1><p>x</div><div class=sidebar>no</div>") == ["T", "x"]
    assert text("<div class=sidebar-left><article><p>the whole story</article></div><p>z") == ["the whole story"]
    body = "<div class=content><p>The story itself, at length</div>"
    for name in ("comment-list", "related", "sidebar"):
        assert text(f"{body}<div class={name}><article><p>not this</article></div>") == ["The story itself, at length"]
    assert text(f"{body}<article class='comment depth-1'><p>not this</article>") == ["The story itself, at length"]
    assert text("<article class='post comments-open'><p>x<article class=comment><p>no</article><p>y</article>") == ["x", "y"]


def test_sections_of_an_article_stay_whatever_their_names(spark):
    """Words of furniture within longer names, with and without a template, and formulas."""
    names = ("social-history", "promotion-history", "related-work", "recipe-menu", "consent-decree", "shared-widget-theory")
    parts = "".join(f"<section class='{n}' id='{n}-1'><h2>On {n}</h2><p>Paragraph of {n}</p></section>" for n in names)
    furniture = "".join(f"<div class='{n}'><p>no</p></div>" for n in ("promo-box", "related-posts", "share-buttons", "ad", "comments-area", "newsletter signup", "social"))
    body = f"<article><h1>T</h1>{parts}{furniture}<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p></article>"
    want = ["T", *(x for n in names for x in (f"On {n}", f"Paragraph of {n}")), "so x=1 holds"]
    assert html_text.article(body, set(), None) == want
    page = lambda k: f"<body><div class=top>Welcome to all</div>{body.replace('Paragraph of', f'Page {k} on')}<div class=end>All rights kept</div>"
    rows = [(k, f"http://w.org/{k}", page(k), "", "") for k in range(9)]
    for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect():
        lines = r["text"].split("\n")
        assert [x for x in lines if x.startswith("Page")] == [f"Page {r['page_id']} on {n}" for n in names]
        assert not {"no", "Welcome to all", "All rights kept"} & set(lines)


def test_copies_outside_of_article_elements_stay(spark):
    def page(k, body):
        return (k, f"http://one.org/{k}", f"<html><body><div class=top>Welcome to our site</div><div class=body>{body}</div><div class=end>All rights kept</div></body></html>", "", "")

    same = "<p>A story that many pages hold</p><p>and its second part</p>"
    rows = [page(k, f"<p>Story {k} begins here</p><p>and ends {k * 7}</p>") for k in range(12)]
    rows += [page(k, same) for k in range(20, 26)] + [page(k, f"{same}<p>read {k}</p>") for k in range(30, 36)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    story = "A story that many pages hold\nand its second part"
    assert got == {k: f"Story {k} begins here\nand ends {k * 7}" for k in range(12)} | {k: story for k in range(20, 26)} | {k: f"{story}\nread {k}" for k in range(30, 36)}


def test_all_parts_of_an_article_stay(spark):
    """Headline outside of the body, several sections, lists longer than paragraphs: exactly what each page was made of."""
    shapes = {
        "head": lambda k: ([f"Title {k}", f"First words {k} of the story", f"and more {k * 3}"], "<div class=post><h1>{}</h1><div class=body><p>{}</p><p>{}</p></div></div>"),
        "sections": lambda k: ([f"Short {k}", f"A much longer section {k} " * 4 + "end", f"Last part {k}"], "<div class=post><section class=a><p>{}</p></section><section class=b><p>{}</p></section><section class=c><p>{}</p></section></div>"),
        "lists": lambda k: ([f"Intro {k}", f"item {k} " * 9 + "a", f"item {k} " * 9 + "b", f"Outro {k}"], "<div class=body><p>{}</p><ul><li>{}</li><li>{}</li></ul><p>{}</p></div>"),
    }
    rows, want = [], {}
    for name, shape in shapes.items():
        for k in range(12):
            parts, form = shape(k)
            url = f"http://{name}.org/{k}"
            want[url] = "\n".join(parts)
            rows.append((k, url, f"<body><div class=top>Welcome to all</div>{form.format(*parts)}<div class=end>All rights kept</div>", "", ""))
    got = {r["url"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want


def test_archives_are_cut_by_bytes_and_read_in_chunks(spark, monkeypatch):
    import os

    rows = [(k, f"http://x.org/{k}", os.urandom(2000).hex() * (1 + 40 * (k % 50 == 0)), "", "") for k in range(300)] + [(300, "http://x.org/300", None, "", "")]
    path = shared_path(spark, "warc-test")
    monkeypatch.setattr(warc, "FILE_PACKS", 1)
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    files = glob.glob(f"{path.removeprefix('file:')}/part-*")
    data = [open(f, "rb").read() for f in files]
    assert sum(gzip.decompress(d).count(b"WARC/1.1\r\n") for d in data) == 301
    assert len(files) == 1 or max(map(len, data)) <= warc.PACK_BYTES + 1
    for d in data:
        whole = list(warc.members(iter([d])))
        for size in (1, 7, 1000, len(d)):
            assert list(warc.members(d[k : k + size] for k in range(0, len(d), size))) == whole
        with pytest.raises(ValueError):
            list(warc.members(iter([d[:-5]])))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    assert sorted(files.mapInArrow(warc._captures_of_contents, warc._CAPTURE).collect()) == sorted(
        files.select("path").mapInArrow(warc._captures, warc._CAPTURE).collect()
    )
    assert warc.build_index(spark, path).count() >= 2


def valid_tokens(pages):
    """Template tokens by the definition: equal vectors, enough pages and tokens, places in one order, no crossing."""
    orders = [html_text.blocks_of(p)[1] for p in pages]
    vectors = {t: tuple(o.count(t) for o in orders) for o in orders for t in o}
    classes = {}
    for t, v in vectors.items():
        classes.setdefault(v, set()).add(t)
    on = lambda v: sum(n > 0 for n in v)
    classes = {v: c for v, c in classes.items() if on(v) >= max(html_text.MIN_PAGES, html_text.SUPPORT * len(pages)) and len(c) >= html_text.MIN_TOKENS}
    good = set()
    for v, c in classes.items():
        places = {t: [] for t in c}
        for o in orders:
            if seen := [t for t in o if t in c]:
                kept = set(seen[: len(c)]) == c and seen == seen[: len(c)] * (len(seen) // len(c))
                x = [k for k, t in enumerate(o) if t in c]
                for w, d in classes.items():
                    y = [k for k, t in enumerate(o) if t in d]
                    if on(v) < on(w) and max(v) == max(w) == 1 and y:
                        inside = lambda a, b: not any(a[0] < k < a[-1] for k in b)
                        kept &= inside(x, y) or inside(y, x)
                for t in c:
                    places[t].append(seen.index(t) if kept else None)
        same = {t for t, p in places.items() if max(p.count(k) if k is not None else 0 for k in p) >= (1 - html_text.NOISE) * len(p)}
        good |= same if len(same) >= html_text.MIN_TOKENS else set()
    return good


def test_classes_keep_one_order_and_nest(spark):
    """Against the definition, on pages with and without article elements."""
    pages = {"plain.org": [], "article.org": []}
    for k in range(12):
        swapped = ["<p>Left words</p>", "<p>Right words</p>"][:: 1 if k % 2 else -1]
        story = f"<h1>Title {k}</h1><p>Story {k} begins here</p><p>and ends with {k * 7}</p>"
        rows = "".join(f"<ul><li class=x>row <i>{k}.{j}</i></li></ul>" for j in range(k % 4))
        some = "<section class=a><p>Crossing one</p></section>" if k < 5 else ""
        more = "<section class=b><p>Crossing two</p></section>" if k < 5 else ""
        for host, (start, end) in {"plain.org": ("<div class=body>", "</div>"), "article.org": ("<article>", "</article>")}.items():
            pages[host].append(f"<body><div class=top>Welcome to all</div>{some}{start}{''.join(swapped)}{story}{rows}{end}{more}<div class=end>All rights kept</div></body>")
    df = spark.createDataFrame([(h, p) for h, ps in pages.items() for p in ps], "host string, html string")
    got = {r["host"]: r for r in html_text.templates(df).collect()}
    for host, some in pages.items():
        want = valid_tokens(some)
        assert set(got[host]["tokens"]) == want
        texts = {b.text for p in some for b in html_text.blocks_of(p)[0] if b.token in want}
        assert {"Welcome to all", "All rights kept"} <= texts and not texts & {"Crossing one", "Story 1 begins here"}
        # two texts that change places are no class of one order
        assert not texts & {"Left words", "Right words"}


def test_lists_of_cards_and_standing_lines_are_no_article(spark):
    rows, want = [], {}
    for k in range(12):
        story = f"<article class=post><header><h1>Title {k}</h1><p>by no one</header><p class=share-price>Shares rose {k}</p><p>{'The long story and how it goes on ' * 20}{k}</p><p>Our paper is free for all</p></article>"
        cards = f"<section class=more><article class=card><h4>See {k + 1}</h4></article></section>"
        rows.append((k, f"http://one.org/{k}", f"<body><div class=top>Welcome to all</div>{story}{cards}<div class=end>All rights kept</div></body>", "", ""))
        want[k] = f"Title {k}\nShares rose {k}\n{'The long story and how it goes on ' * 20}{k}"
    assert {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()} == want


def test_hosts_dealt_out_in_parts_give_the_same(spark, monkeypatch):
    df = html_text.table(spark, SMALL, "pages")
    want = sorted(map(str, html_text.extract(df).collect()))
    monkeypatch.setattr(html_text, "MAX_TOKENS", 0)
    monkeypatch.setattr(html_text, "PARTS", 3)
    assert sorted(map(str, html_text.extract(df).collect())) == want
