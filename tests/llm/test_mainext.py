from tidemark.llm import mainext

NAV = '<nav><ul><li><a href="/x">Home page</a></li></ul></nav>'
FOOT = "<footer>&copy; somebody, all rights reserved and some more words here</footer>"
PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>" + NAV + '<!-- ad --><div class="ad">Buy this now please</div><article><h1>{h}</h1>{b}</article>' + FOOT + "</body></html>"


def run(spark, pages):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in pages], "page_id long, url string, html string").withColumn("text", __import__("pyspark").sql.functions.lit("x"))
    rows = mainext.extracted(df, mainext.fit(df)).collect()
    assert len(rows) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    return {r["page_id"]: r["text"] for r in rows}


def test_articles(spark):
    long_ = "word " * 20_000
    pages = [
        (1, PAGE.format(h="Title &amp; more", b="<p>One <b>bold</b>ly\n said.</p><p>Two<br>three &#233;.</p>")),
        (2, PAGE.format(h="Short", b="")),
        (3, PAGE.format(h="L", b=f"<p>{long_}</p>")),
        (4, PAGE.format(h="A list", b="<ul><li>x y</li><li>z</li></ul><aside>not this</aside><div class='comments'><p>nor that</p></div><p>end</p>")),
        (5, None),
        (6, ""),
        (7, "<p>"),
        (8, PAGE.format(h="Cut", b="<p>off &am")[: PAGE.format(h="Cut", b="<p>off &am").index("</article>")]),
        (9, PAGE.format(h="Form", b="<form><label>Name</label><input></form><p>kept</p><p>also <i>kept</i></p>")),
    ]
    got = run(spark, pages)
    assert got[1] == "Title & more One boldly said. Two three é."
    assert got[2] == "Short" and got[4] == "A list x y z end" and got[5] == got[6] == got[7] == ""
    assert got[3] == "L " + long_.strip()
    assert got[8] == "Cut off &am" and got[9] == "Form kept also kept"


def test_without_labelled_pages(spark):
    html = f"<body>{NAV}<div id='content'><h2>Head</h2><p>Some text that is long enough to win.</p></div><div class='sidebar'>Other things</div>{FOOT}</body>"
    assert run(spark, [(1, html)])[1] == "Head Some text that is long enough to win."
    assert run(spark, []) == {}


def test_what_stands_in_articles_stays(spark):
    """Class names inside of articles, several articles, foreign elements: nothing but the marked blocks goes."""
    html = (
        "<body><article><h1>T</h1><p>Pasta is good to eat.</p><div class='menu-item'><p>Served with basil.</p></div><p class='share price'>Shares rose.</p>"
        "<div id=related-work><p>Others wrote too.</p></div><header><p>By someone</p></header><p>x<math><mi>y</mi></math></p><noscript>plain</noscript> end</article></body>"
    )
    text = "T Pasta is good to eat. Served with basil. Shares rose. Others wrote too. By someone xy plain end"
    pages = [(i, PAGE.format(h=f"Page {i}", b="<p>Some words of this page.</p>")) for i in range(5)]
    assert run(spark, [(9, html)])[9] == text
    assert run(spark, [(9, html), *pages])[9] == text
    two = PAGE.format(h="One", b="<p>First of two texts.</p></article><div class='ad'>Buy</div><article><h1>Two</h1><p>Second of them.</p>")
    assert run(spark, [(9, two), *pages])[9] == "One First of two texts. Two Second of them."


def test_articles_under_another_tag(spark):
    """Weights come from marked pages; the same pages without the tag give the same texts."""
    body = "<p>Some words of this page, number {i}.</p><h2>More</h2><ul><li>one</li><li>two</li></ul><blockquote>said {i}</blockquote><p>The end of it.</p>"
    marked = [(i, PAGE.format(h=f"Page {i}", b=body.format(i=i))) for i in range(6)]
    for tag in ("div", "section", "main"):
        other = [(10 + i, h.replace("article>", f"{tag}>")) for i, h in marked]
        got = run(spark, marked + other)
        for i in range(6):
            assert got[10 + i] == got[i] == f"Page {i} Some words of this page, number {i}. More one two said {i} The end of it."


def test_learned_names_go_also_inside(spark):
    """A class that marked pages have beside their articles is left out within one as well; unlike names stay."""
    page = PAGE.replace('<div class="ad">Buy', '<div class="zq7">Buy').replace("<article>", "<div class='crumbs'>You are here</div><article>")
    pages = [(10 + i, page.format(h=f"P{i}", b="<p>Words.</p>")) for i in range(15)]
    inner = page.format(h="In", b="<p>Start here.</p><div class='zq7'>Sold out</div><div class='crumbs'>Up</div><div class='zq8'>Stays.</div><p>Goes on.</p>")
    assert run(spark, [*pages, (9, inner)])[9] == "In Start here. Stays. Goes on."


def test_custom_elements_swallow_nothing(spark):
    """Elements whose names begin like a silent one's are elements of their own."""
    names = ["video-player", "title-bar", "style-guide", "select-all", "object-x", "head-line", "script-x", "audio-clip", "header"]
    pages = [(i, f"<article><h1>T</h1><p>First part here.</p><{n} src=x></{n}><p>Second part of the article.</p></article>") for i, n in enumerate(names)]
    pages += [(50, "<article><title-bar>Deck line</title-bar><p>Then all the rest of it.</p></article>")]
    got = run(spark, pages)
    assert {got[i] for i in range(len(names))} == {"T First part here. Second part of the article."}
    assert got[50] == "Deck line Then all the rest of it."


def test_long_and_malformed_pages_with_silent_elements(spark):
    words_ = "some words of it. " * 4_000
    many = "<script>if (a < b) { x('</p>'); }</script><style>p { }</style><p>kept here</p>" * 2_000
    pages = [
        (1, f"<article><p>{words_}</p><script src=a></script><p>end</p></article>"),
        (2, f"<article>{many}</article>"),
        (3, "<article><p>before</p><SCRIPT>var a = '<p>never</p>';</ScRiPt ><p>after</p></article>"),
        (4, "<article><p>before it all</p><script>var a = '<p>never closed</p></article>"),
        (5, "<article><p>one <video controls><p>no text</p></video> two</p><select><option>a<option>b</select><p>three</p></article>"),
        (6, "<article><p>before</p><style/><p>behind an empty one</p></article>"),
    ]
    got = run(spark, pages)
    assert got[1] == " ".join(words_.split()) + " end"
    assert got[2] == " ".join(["kept here"] * 2_000)
    assert got[3] == "before after" and got[4] == "before it all"
    assert got[5] == "one two three" and got[6] == "before behind an empty one"


def test_ties_repeats_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    html = "<div><p>same words here</p></div><aside>no</aside><hr class='ad'><hr class='ad'><hr class='ad'><hr class='ad'><p>same words there</p>"
    df = spark.createDataFrame([(1, "u", html)] * 3 + [(None, None, html)], "page_id long, url string, html string")
    df = df.withColumns({n: F.lit("x") for n in ("text", "n_chars", "h", "k")})
    rows = mainext.extracted(df, mainext.fit(df)).collect()
    assert len(rows) == 4 and {r["text"] for r in rows} == {"same words here"}


def test_linear_scan_is_the_best_region():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([1.0, 2.0, -0.5, -1.0, -3.0, 0.0]) for _ in range(rng.randrange(12))]
        best = max((sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2)), default=0)
        a, b = mainext.region(scores)
        assert sum(scores[a:b]) == max(best, 0)


def test_markup_of_all_pages(spark):
    """Whole table against texts cut out by the tags of its template."""
    import html as H
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in mainext.op8_main_text(spark, "/root/testdata/sf0.01").collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search("<article>(.*?)(?:</article>|<footer>|$)", r["html"] or "", re.S)
        text = re.sub("</?(?:b|i|a|em|strong|code|span)(?: [^>]*)?>", "", inner[1] if inner else "")
        want = " ".join(" ".join(H.unescape(x).split()) for x in re.split("<[^>]*>", text))
        assert got[r["page_id"]] == " ".join(want.split())
