import html
import re

from brieflake.llm import html as H

MODEL: dict = {}
PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">'
    '<header><a href="/">Site</a></header><nav><ul><li><a href="/x">Menu one</a></li></ul></nav><!-- ad > 1 --><div class="ad">Buy this now and then some more</div>'
    "<article><h1>The &amp; title</h1><p><b>First   para.<br><p>Second &lt;para&gt;\n with <i>in</i>line.</p>"
    '<aside>related stuff</aside><div class="share-buttons">share me</div><ul><li>item one</li><li>item two</li></ul><p hidden>secret</p></article>'
    '<section id="comments"><p>A reader wrote this long comment about the article, at some length, many words.</p></section>'
    '<form><p>Your mail</p><input name=q></form><div class="cookie-notice"><p>We use cookies</p></div><footer>&copy; me and others with many words here</footer></body></html>'
)
WANT = "The & title\nFirst para.\nSecond <para> with inline.\nitem one\nitem two"


def test_prior_weights_and_learned_weights_agree(spark):
    assert H.extract(PAGE, {}) == WANT
    counts = H.label_counts(PAGE)
    assert H.extract(PAGE, H.weights({k: tuple(v) for k, v in counts.items()})) == WANT


def test_page_without_article():
    page = '<body><nav><a href=x>Home</a></nav><div id="content"><h2>Head</h2><p>' + "some real words " * 20 + '</p></div><div class="sidebar"><p>See also these pages</p></div><footer>Legal text</footer></body>'
    assert H.extract(page, {}) == "Head\n" + ("some real words " * 20).strip()


def test_odd_pages():
    for page in (None, "", "<", "<p", "<!-- x", "<script>", "</p></div>", "<p a='", "<<<>>>" * 2000, "<p " * 5000, "&amp" * 10, "<div>" * 3000 + "x"):
        assert isinstance(H.extract(page, {}), str)
    assert H.extract("plain text only", {}) == "plain text only"
    assert H.extract("<article>" + "<p>w x</p>" * 30000 + "</article>", {}).count("\n") == 29999


def test_all_pages_against_their_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|ul|li)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        want = "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)
        assert got[r.page_id] == want


def test_rows(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (2, "u", "", "a"), (2, "u", PAGE, "a"), (2, "u", PAGE, "a")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in H.extract_pages(df).collect())
    assert got == [(1, "", "", 0), (2, "u", "", 0), (2, "u", WANT, len(WANT)), (2, "u", WANT, len(WANT))]
    assert H.extract_pages(df.limit(0)).count() == 0


def test_labelled_pages_do_not_cost_other_pages_their_text(spark):
    outside = "<body><p>Top of the site</p><div>Some plain words</div><ul><li>One of these</li></ul><h2>Two words</h2>{}<p>All the rest</p><div>Last plain words</div></body>"
    label = [(i, "u", outside.format("<article><h1>A title</h1>" + "<p>" + "real words here " * 20 + "</p></article>"), "a") for i in range(90)]
    said = [f"Paragraph {i} has its own words here" for i in range(6)]
    comment = '<article class="comment"><p>A reader wrote this</p></article>'
    other = {
        100: "<body><main>" + "".join(f"<p>{x}</p>" for x in said) + "</main></body>",
        101: "<body><div class=post>" + "".join(f"<div>{x}</div>" for x in said) + "</div></body>",
        102: "<body><ul>" + "".join(f"<li>{x}</li>" for x in said) + "</ul></body>",
        103: "<body><nav><a href=x>Home</a></nav><div class=post><div><h2>Short heading</h2></div>" + "".join(f"<p>{x}</p>" for x in said) + "<div><h3>The end</h3></div></div></body>",
        104: f"<body><main>{''.join(f'<p>{x}</p>' for x in said)}</main>{comment}</body>",
        105: "<body><article></article><main>" + "".join(f"<p>{x}</p>" for x in said) + "</main></body>",
        106: "<body><article><p>" + said[0] + "</p></article><article><p>" + said[1] + "</p></article></body>",
    }
    df = spark.createDataFrame(label + [(i, "u", h, "a") for i, h in other.items()], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in H.extract_pages(df).collect()}
    assert all(got[i] == "A title\n" + ("real words here " * 20).strip() for i in range(90))
    want = dict.fromkeys((100, 101, 102, 104, 105), "\n".join(said)) | {103: "\n".join(["Short heading", *said, "The end"]), 106: "\n".join(said[:2])}
    assert {i: got[i] for i in other} == want


def test_best_region_against_all_regions():
    import random

    rng = random.Random(8)
    for _ in range(400):
        scores = [rng.choice([-5.0, -2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 14))]
        a, b = H.best_region(scores)
        every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[a:b]) == max([0.0, *every])


def test_names_that_only_sound_like_boilerplate():
    said = "Some real words that make up a paragraph here"
    inside = [
        f"<div class='related-work'><p>{said} one</p></div>", f"<section id='search-methods'><h2>Methods</h2><p>{said} two</p></section>",
        f"<div class='noticeboard-history'><p>{said} three</p></div>", f"<div class='comment-box'><p>{said} gone</p></div>", f"<div id='relatedPosts'><p>{said} gone</p></div>",
    ]
    want = f"Title\n{said} one\nMethods\n{said} two\n{said} three"
    assert H.extract(f"<body><article><h1>Title</h1>{''.join(inside)}</article></body>", {}) == want
    assert H.extract(f"<body><div><h1>Title</h1>{''.join(inside)}</div></body>", {}) == want


def test_text_goes_on_behind_boilerplate():
    said = "Some real words that make up a paragraph here"
    nav = "<nav><ul>" + "<li><a href=x>Link there</a></li>" * 30 + "</ul></nav>"
    ad = "<div class='ad-banner'>" + "<div><span>Buy</span></div>" * 20 + "</div>"
    page = f"<body>{nav}<p>{said} one</p>{nav}<p>{said} two</p>{ad}<p>{said} three</p><footer><p>Legal words and many more of them in here</p></footer></body>"
    assert H.extract(page, {}) == f"{said} one\n{said} two\n{said} three"


def test_repeated_pages_in_the_sample(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "a")] * 50 + [(2, "u", PAGE, "b")], "page_id long, url string, html string, text string")
    once = H.fit(df.dropDuplicates(["page_id"]))
    assert H.fit(df) == once and once


def test_very_long_page():
    assert H.extract("<div>" + "<p>some words here</p>" * 100_000 + "</div>", {}).count("\n") == 99_999


def test_short_blocks_beside_boilerplate_stay():
    twenty = " ".join(f"word{i}" for i in range(20))
    said = {
        f"<h1>Overview</h1><div class='ad'>Buy</div><p>{twenty}</p>": f"Overview\n{twenty}",
        f"<h1>Overview</h1><p>Short.</p><aside>x</aside><p>{twenty}</p>": f"Overview\nShort.\n{twenty}",
        f"<p>{twenty}</p><aside>x</aside><p>End.</p>": f"{twenty}\nEnd.",
        "<p>Body <b class='hidden'>x</b> text</p>": "Body text",
        f"<div>{twenty}</div><nav><a href=x>Go there</a></nav><div>End</div>": f"{twenty}\nEnd",
        f"<p>{twenty}</p><div><a href=a>Home</a></div><div><a href=b>Who we are</a></div>": twenty,
        f"<p>{twenty} <a href=x>a link of five words</a></p>": f"{twenty} a link of five words",
    }
    assert {page: H.extract(f"<body>{page}</body>", {}) for page in said} == said


def test_comments_and_adverts_by_their_words():
    long = " ".join(f"word{i}" for i in range(60))
    gone = "comment-thread comment-body user-comments-thread ad-slot adsbygoogle promo-card cookie-notice-x".split()
    inside = "".join(f"<div class='{name}'><h3>What readers say</h3><p>{long} bad</p></div>" for name in gone)
    for page in (f"<article><h1>Title</h1><p>{long}</p>{inside}<p>End here.</p></article>", f"<div><h1>Title</h1><p>{long}</p>{inside}<p>End here.</p></div>"):
        assert H.extract(f"<body>{page}</body>", {}) == f"Title\n{long}\nEnd here."
    kept = f"<div class='ad-supported-story'><h1>Title</h1><p>{long}</p><p>{long}</p></div><div class='has-comments'><p>More {long}</p></div><div class=no-ads><p>And more</p></div>"
    assert H.extract(f"<body>{kept}</body>", {}) == f"Title\n{long}\n{long}\nMore {long}\nAnd more"


def _layouts(rng):
    """Pages of five layouts without <article>: (html, text)."""
    words = lambda n: " ".join(rng.choice(["stone", "river", "a", "the", "of", "light", "seven", "Paris", "walks"]) + str(rng.randint(0, 99)) for _ in range(n))
    junk = [
        f"<nav><ul><li><a href=/>{words(2)}</a></li><li><a href=/a>{words(1)}</a></li></ul></nav>", f"<div class='ad-slot'><p>{words(12)}</p></div>", f"<aside><h3>{words(2)}</h3><p>{words(20)}</p></aside>",
        f"<section id='comments'><h2>{words(2)}</h2><div class='comment-body'><p>{words(30)}</p></div></section>", f"<div class='cookie-notice'>{words(14)}</div>", f"<form><label>{words(3)}</label></form>",
    ]
    foot = f"<footer><p>{words(25)}</p></footer><script>var x = '<p>{words(5)}</p>'</script>"
    for layout in range(5):
        title, paras = words(rng.randint(1, 8)), [words(rng.choice([1, 3, 8, 40, 90])) for _ in range(rng.randint(2, 9))]
        extra = [rng.choice(junk) if rng.random() < 0.4 else "" for _ in paras]
        kind = ["p", "p", "div", "p", "li"][layout]
        body = "".join(f"<{kind}>{p}</{kind}>{x if kind != 'li' else ''}" for p, x in zip(paras, extra))
        inner = f"<h1>{title}</h1>{'<ul>' + body + '</ul>' if kind == 'li' else body}"
        shell = ["<main>{}</main>", "<div class='post-content'><div>{}</div></div>", "<div id=page><div class=story>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "{}"][layout]
        yield f"<html><head><title>{words(3)}</title></head><body><header><a href=/>{words(2)}</a></header>{junk[0]}{shell.format(inner)}{rng.choice(junk)}{foot}</body></html>", "\n".join([title, *paras])


def test_five_layouts_without_an_article():
    import random
    from collections import Counter

    rng = random.Random(12)
    labelled: dict = {}
    for _ in range(40):
        for k, (a, b) in H.label_counts(PAGE.replace("First", rng.choice(["First", "Next"]))).items():
            t = labelled.setdefault(k, [0, 0])
            t[0], t[1] = t[0] + a, t[1] + b
    for model in ({}, H.weights({k: tuple(v) for k, v in labelled.items()})):
        had = got = extra = 0
        for _ in range(60):
            for page, want in _layouts(rng):
                a, b = Counter(want.split()), Counter(H.extract(page, model).split())
                had, got, extra = had + a.total(), got + (a & b).total(), extra + (b - a).total()
        assert got / had >= 0.98 and extra == 0, (got / had, extra)


def test_learned_weights_reach_pages_without_an_article():
    page = "<body><article>" + "<dt>term of art</dt>" * 30 + "</article></body>"
    model = H.weights({k: tuple(v) for k, v in H.label_counts(page).items()})
    assert model["any:w:dt"] == 1.0 and H.weight(model, "w:dt", False) > H.weight({}, "w:dt", False)
    assert not any(f.endswith("/a") for f in model if f.startswith("any:"))
