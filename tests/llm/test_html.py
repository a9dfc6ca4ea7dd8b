"""Page text: what templates take and leave, counts against brute force, odd pages."""

import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from facetflow.llm import html_extract

SCHEMA = "page_id bigint, url string, html string"
#: Slots are filled anew on every page; only their places recur. {a}: the element around the article.
PAGE = "<html><head><title>t</title><script>var a='</p>'</script></head><body><div class='menu top'><ul><li>menu {n}</li></ul></div><div class='promo-{n}'>Buy {n}</div><div><p>Common line of the site</p></div><{a}><div class='post-header'><h1>T{n}</h1></div><p>One &amp; <b>two<br>three{n} and a good many more words about it<p>Four  five{n}</p><ul><li>point {n}</ul><div class=comments><p>me too {n}</p></div></{a}><div id='legal'>f{n}</div></body></html>"


def text_of(n):
    return f"T{n}\n\nOne & two three{n} and a good many more words about it\n\nFour five{n}\n\npoint {n}"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def texts(df):
    return {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}


@pytest.mark.parametrize("around", ["article", "div", "section class='body'"])
def test_templates_alone_find_the_text(spark, around):
    rows = [(n, f"http://h.example/{n}", PAGE.format(n=n, a=around).replace("</section class='body'>", "</section>")) for n in range(8)]
    found = texts(pages(spark, rows))
    assert found == {n: text_of(n) for n in range(8)}
    off = {n: html_extract.Page(h).result() for n, _, h in rows}
    assert all("menu" in off[n] and "Common line" in off[n] and off[n] != found[n] for n in off)


def test_named_paragraphs_stay(spark):
    page = "<body><div class='lead'>ad {n}</div><div class='text'><p class='par'>Story {n} of some length</p><p class='par'>and more of story {n}</p></div></body>"
    assert texts(pages(spark, [(n, f"http://h.example/{n}", page.format(n=n)) for n in range(5)])) == {n: f"Story {n} of some length\n\nand more of story {n}" for n in range(5)}


PARTS = ["<p class='lead'>X {n}</p>", "<h2 class='subtitle'>X {n}</h2>", "<figure class='shot'><img><figcaption>X {n}</figcaption></figure>", "<blockquote class='quote'>X {n}</blockquote>", "<section id='summary'><p>X {n}</p></section>", "<pre class='code'>X {n}</pre>", "<p>X {n}</p>", "<p role='note'><math><mi>X {n}</mi></math></p>"]


@pytest.mark.parametrize("around", ["article", "div", "form"])
def test_named_parts_of_an_article_stay(spark, around):
    """Whatever is named inside the article is its text, on every page of the host; a menu and comments beside or inside it go."""
    words = " ".join(f"word{k}" for k in range(120))
    rows, want = [], {}
    for h, part in enumerate(PARTS):
        for n in range(12):
            key = h * 100 + n
            body = f"<div class='menu'>go {n}</div><{around}><h1>T{n}</h1>{part.format(n=n)}<p>{words} {n}</p><div class='reader-comments'><p>me too {n}</p></div></{around}><div class='legal'>all {n} rights</div>"
            rows.append((key, f"http://h{h}.example/{n}", f"<html><body>{body}</body></html>"))
            want[key] = f"T{n}\n\nX {n}\n\n{words} {n}"
    assert texts(pages(spark, rows)) == want


def test_forms_go_but_for_those_that_hold_the_page():
    assert html_extract.Page("<h1>T</h1><p>a</p><form><p>name</p><input></form>").result() == "T\n\na"
    assert html_extract.Page("<body><form id='aspnet'><h1>T</h1><p>a</p></form></body>").result() == "T\n\na"


def test_hosts_of_few_pages_share_their_counts(spark):
    rows = [(n, f"http://h{n}.example/", PAGE.format(n=n, a="article")) for n in range(6)] + [(7, None, None), (8, "http://h8.example/8", ""), (9, None, PAGE.format(n=9, a="article"))]
    found = texts(pages(spark, rows))
    assert found == {n: text_of(n) for n in (*range(6), 9)} | {7: "", 8: ""}
    assert texts(pages(spark, rows[:2])) == {n: html_extract.Page(rows[n][2]).result() for n in range(2)}  # too few to tell


def test_site_templates(spark):
    page = "<body><div><p>Welcome to the site</p></div><p>Story {n}</p></body>"
    rows = [(i, f"http://h.example/{i}", page.format(n=i)) for i in range(6)] + [(6, "http://other.example/", page.format(n=6)), (7, None, None), (8, "http://h.example/8", "")]
    found = texts(pages(spark, rows))
    assert found[0] == "Story 0" and found[6] == "Welcome to the site\n\nStory 6" and found[7] == "" and found[8] == ""
    assert texts(pages(spark, [])) == {}


@pytest.mark.parametrize(("others", "copies"), [(2, 3), (6, 6)])
def test_copies_of_an_article_are_no_template(spark, others, copies):
    page = "<body><script>var x={k}</script><div><p>Welcome to the site</p></div><{a}><h1>T{n}</h1><p>Story {n}</p></{a}></body>"
    rows = [(i, f"http://{host}/{i}", page.format(a=a, n=max(0, i - copies + 1), k=k * i)) for host, a, k in (("a", "article", 0), ("b", "article", 1), ("c", "div", 0)) for i in range(others + copies)]
    for r in html_extract.extract(pages(spark, rows)).collect():
        n = max(0, r["page_id"] - copies + 1)
        assert r["text"] == f"T{n}\n\nStory {n}", r["url"]


def test_counts_are_those_of_brute_force(spark):
    """Repeated rows and copies count once; subtrees and places from half of a site's pages on."""
    bits = ["<div><p>every third page</p></div>", "<div class='x'>{n}</div>", "<p>always</p>", "<div id=q><p>often</p></div>"]
    rows = []
    for n in range(40):
        html = "".join(b.format(n=n // 2) for k, b in enumerate(bits) if (n // 2) % 3 >= k - 1) + f"<h1>{n // 2}</h1>"
        rows.append((n, f"http://{'abc'[n % 3]}.example/{n}", html))
    rows += [(100 + n, r[1], r[2]) for n, r in enumerate(rows[:9])]
    sites, found = html_extract.templates(pages(spark, rows))
    own = defaultdict(dict)
    for _, url, html in rows:
        page = html_extract.Page(html)
        key = (url.split("/")[2], page.result())
        own[key[0]][key] = min(own[key[0]].get(key, (1 << 64, None)), (html_extract.hash_of(html), html))
    got = {r["site"]: (set(r["subtrees"]), {p["path"]: (p["chars"], p["most"], p["kind"], p["heading"]) for p in r["places"]}) for r in found.collect()}
    assert set(got) == set(own) and {r["host"]: r["site"] for r in sites.collect()} == {h: h for h in own}
    for host, held in own.items():
        subtrees, places, data = Counter(), Counter(), {}
        for _, html in held.values():
            page = html_extract.Page(html)
            subtrees.update(page.hashes)
            places.update(page.places.keys())
            for k, (_, times, chars, kind, heading) in page.places.items():
                before = data.get(k, (0, 0, 0, False))
                data[k] = (before[0] + chars, max(before[1], times), max(before[2], kind), before[3] or heading)
        least = max(html_extract.PAGES, html_extract.SHARE * len(held))
        assert got[host] == ({h for h, n in subtrees.items() if n >= least}, {k: data[k] for k, n in places.items() if n >= least})


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(n % 4, f"http://h.example/{n}", PAGE.format(n=n % 4, a="div")) for n in range(8)]
    names = ["host", "template", "site", "text", "copy", "page", "__own", "subtrees", "n", "path"]
    df = pages(spark, rows).withColumns({c: F.lit(c) for c in names})
    out = html_extract.extract(df)
    assert out.columns == ["page_id", "url", *(c for c in names if c != "text"), "text"] and out.count() == 8
    assert {r["page_id"]: r["text"] for r in out.collect()} == {n: text_of(n) for n in range(4)} and out.filter("host <> 'host' or __own <> '__own'").isEmpty()


def test_odd_pages():
    for odd_html in ("", "<", "<p", "</div></p>", "<!-- open", "<div>" * 5000, "plain &lt;text", "<script>never closed", "<p>a<p>b</div>c", "<a 'x>y", '<a "x>y" >z'):
        html_extract.Page(odd_html).result()
    assert html_extract.Page("plain &lt;text").result() == "plain <text"
    assert html_extract.Page("a<!-- open").result() == "a"


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '>", "<b>", "<p><b>", "<!--", "<script>", '<a "x>', "</p>", "&lt;"])
def test_time_grows_in_proportion(piece):
    took = []
    for n in (40_000, 320_000):
        start = time.process_time()
        html_extract.Page(piece * (n // len(piece))).result()
        took.append(time.process_time() - start)
    assert took[1] < 8 * 4 * max(took[0], 0.01), took
