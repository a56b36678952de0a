"""Main text of pages whose articles are known, templates against a plain count, broken markup, and both ways of lookup."""

import html
import os
import random
import re
from collections import defaultdict

import pytest

from yardspark.llm import html_text

SCHEMA = "page_id long, url string, html string, text string, host int"
DATA = os.environ.get("TEST_PAGES_DIR", "/root/testdata/sf0.1")


def texts(spark, rows, **how):
    table = spark.createDataFrame([(i, u, h, "clash", 1) for i, (u, h) in enumerate(rows)], SCHEMA).repartition(3)
    got = html_text.extract(table, **how).collect()
    assert all(r.n_chars == len(r.text) and r.host == 1 for r in got)
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def one(source):
    return html_text.Page(source).main_text(set())


def prose(rng, n=30):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]) + str(rng.randrange(99)) for _ in range(n))


def site(rng, k):
    """A page of a site whose markup names nothing: only its parts that recur tell the template."""
    body = [prose(rng) for _ in range(3)]
    top = '<div class="x1"><div><a href="/a">Start</a> <a href="/b?p=%d">Goods and more</a></div><p>A long sentence on the cookies of this site, which is longer than the shorter articles are.</p></div>' % k
    page = f'<html><head><title>t</title></head><body>{top}<div class="x2">{"".join(f"<p>{b}</p>" for b in body)}</div><div class="x3">Written for you &copy; 2020</div></body></html>'
    return page, " ".join(body)


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_templates_of_a_site_go(spark, most):
    rng = random.Random(1)
    made = [site(rng, k) for k in range(8)]
    rows = [("https://User@A.example:80/x?u=http://b/", p) for p, _ in made]
    rows += [("http://few.example/", site(rng, 1)[0]) for _ in range(4)]  # too few pages
    copy = site(rng, 2)
    rows += [("http://copies.example/", copy[0].replace("2020", str(k))) for k in range(9)]  # one article again and again
    rows += [(None, made[0][0]), ("no host", made[0][0]), ("https://a.example/", None), ("https://a.example/", "")]
    got = texts(spark, rows, most=most)
    assert got[:8] == [t for _, t in made]
    assert all("Start Goods and more" in t for t in got[8:12]) and all(copy[1] in t for t in got[12:21])
    assert "Goods" in got[21] and "Goods" in got[22] and got[23:] == ["", ""]
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_paragraphs_of_articles_stay(spark):
    rng, shared = random.Random(2), "A passage that many articles of one site share, word for word, for good reasons."
    rows, want = [], []
    for _ in range(7):
        own = [prose(rng) for _ in range(3)]
        rows.append(("http://s.example/1", f'<body><article><header><h1>{own[0]}</h1></header><p>{shared}</p><div class="q">Read our letter</div><p>{own[1]}<ul><li>{own[2]}</ul></article><p>Shown everywhere</p>'))
        want.append(" ".join([own[0], shared, own[1], own[2]]))
    assert texts(spark, rows) == want
    same = [("http://t.example/", rows[0][1])] * 7
    assert texts(spark, same) == [want[0].replace(shared, shared + " Read our letter")] * 7


def test_parts_that_markup_names():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><div id="siteHeader">Brand</div><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use</div>
    <main><article class="post no-comments"><h1>Title &amp; more</h1><p class=lead>First <b>bold</b>er<br>line</p>
    <aside>Side</aside><div class="adSlot ad">Buy</div><form><p>Mail <input></p></form><script>var t="</p><p>";</script><noscript>on</noscript>
    <figure><figcaption>Seen</figcaption></figure><table><tr><td>1<td>2</table><footer>By me</footer>
    <section id=comments><article><p>Great read</p></article></section></article><div class="related">Others</div></main>
    <div role="contentinfo">Legal</div><footer>&copy; us</footer></body></html>"""
    assert one(page) == "Title & more First bolder line Seen 1 2"
    assert one('<body><div class="menu">M</div><div itemprop="articleBody">In <i>it</i>.</div><div>Out</div>') == "In it."
    assert one('<form><div class="sidebar"><article><p>All in a form</article></div></form>') == "All in a form"
    assert one('<div class="banner"><p>Nothing but this</div>') == "Nothing but this"
    assert one('<div class="side-bar">S</div><div id="topBar">T</div><ins class="adsbygoogle">A</ins><p class="lead ad-free">Text<div class="reader_comments">C</div>') == "Text"
    assert one("<body><p>Loose<p hidden>no<p style='display: none'>no<p>end") == "Loose end"


def test_broken_markup():
    assert one("<p><b>a<br><p>b</p>c &amp;amp; &lt;i&gt; &#233;&#x41; &copy x&nbsp;&nbsp;y") == "a b c &amp; <i> éA © x y"
    assert one("a < b > c </ > <a title='x > y' href=\"q\">d</a> <p title=\"open>e") == "a < b > c d e"
    assert one("<div>a<!-- no <p>no --><!-->b<p>c<!-- open <p>d") == "ab c"
    assert one("x<script>if (a<b) '</p>'</script >y<script>open <p>z") == "xy"
    assert one("</div></p><p>a</section></b><div>b</p>c</div></div>d") == "a b c d"
    assert one("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><dl><dt>e<dd>f") == "a b c d e f"
    assert one("") == one("<p> \n&nbsp;</p>") == one("<!doctype html>") == ""
    assert one("<div>" * 20_000 + "deep") == "deep" and one("</div>" * 20_000 + "flat") == "flat"
    assert len(one("<p>" + "word " * 400_000)) == 5 * 400_000 - 1 and one("<a " * 50_000 + "end").endswith("end")
    assert one("<p>\ud800 &#xD800; &#0;</p>").count("�") == 2


def test_given_pages(spark):
    """The given pages hold one <article> each; templates are those of a plain count."""
    table = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = table.collect()
    got = {r.page_id: r.text for r in html_text.extract(table).collect()}
    for r in rows:
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        plain = html.unescape(re.sub("</?b>", "", re.sub("</?(?:p|br|h1)>", " ", inner)))
        assert got[r.page_id] == " ".join(plain.split())
    many, seen = 2, defaultdict(set)
    for r in rows:
        host, (before, after) = re.match("https?://([^/]*)", r.url)[1], (re.split("<article>.*</article>", r.html, flags=re.S) + [""])[:2]
        texts_of = [" ".join(re.sub("<[^>]*>", "\0", t).split("\0")) for t in re.findall("<article>.*</article>", r.html, re.S)]
        for part in re.findall("<nav>.*?</nav>|<div class=\"ad\">.*?</div>|<footer>.*?</footer>", before + after):
            seen[host, re.sub(' href="[^"]*"', "", part)].add(texts_of[0])
    found = html_text.site_templates(table, many=many).count()
    assert found >= sum(len(v) >= many for v in seen.values()) > 0
