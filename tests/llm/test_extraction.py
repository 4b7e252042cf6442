"""Extraction against the article as its markup has it."""

import html
import re

from prosemill.llm import extraction


def article(source):
    body = re.search(r"<article>(.*?)</article>", source or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", body[1]) if body else []
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split())))


def test_articles_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: article(r.html) for r in df.collect()}
    got = {r.page_id: r.text for r in extraction.extract(df).collect()}
    assert got == want and all(want.values())


def test_odd_pages(spark):
    page = '<html><head><title>T</title></head><body><nav><a>Home</a></nav><header><h1>Site</h1></header><div class="post">{}</div><div id="comments"><p>nice</p></div><form><p>send</p></form><footer>(c)</footer></body></html>'
    rows = [(i, f"http://a.example/{i}", page.format(f"<p>first &amp; {i}</p><p>second\n  part <i>{i}</i> &lt;b&gt;")) for i in range(8)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://b.example/", "<article><p>one<p>two<aside>no</aside><div class='ad'>buy</div><section class=comments>c</section><script>var t='</p>';</script></article>tail"), (102, "http://b.example/", "just text < 3")]
    got = sorted((r.page_id, r.text) for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[:8] == [(i, f"first & {i}\nsecond part {i} <b>") for i in range(8)]
    assert got[8:] == [(100, ""), (101, ""), (102, "just text < 3"), (102, "one\ntwo")]
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_text_within_articles_is_no_content(spark):
    page = '<html><body><nav>Menu</nav><article><h1>Head {0}</h1><div class="zq7"><p>Read our other stories</p></div><p>first {0}</p><div class="zq8">Tell <b>everyone</b></div><p>second {0}</p></article></body></html>'
    copy = "<html><body><main><h1>One</h1><p>same text</p></main></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(8)] + [(100 + i, f"http://b.example/{i}", copy) for i in range(8)]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i}\nfirst {i}\nsecond {i}" for i in range(8)} | {100 + i: "One\nsame text" for i in range(8)}


def test_text_of_all_slots_in_page_order(spark):
    page = '<html><body><div class="post"><p>before {0}</p>{1}<p>after {0}</p></div></body></html>'
    table = "<table><tr><td>cell {0}</td></tr></table>"
    rows = [(i, f"http://a.example/{i}", page.format(i, table.format(i) if i % 2 else "")) for i in range(8)]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join([f"before {i}", *[f"cell {i}"] * (i % 2), f"after {i}"]) for i in range(8)}


def spun(i, n):
    return " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(n))


def extracted(spark, pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    return [r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_template_decides_without_article_class_or_id(spark):
    """Sites of bare div elements: menus, notes and footers differ from page to page; boilerplate within the content is shared."""
    page = "<html><head><title>T {0}</title></head><body><div><a>m {0}</a><a>n {0}</a></div><div><div><h2>{1}</h2><p>{2}</p><p>Follow us for more</p><p>{3}</p></div></div><div>note {0}</div><div><a>back {0}</a></div></body></html>"
    pages = [(f"http://bare.example/{i}", page.format(i, spun(i, 5), spun(i + 50, 40), spun(i + 90, 30))) for i in range(12)]
    assert extracted(spark, pages) == [f"{spun(i, 5)}\n{spun(i + 50, 40)}\n{spun(i + 90, 30)}" for i in range(12)]


def test_names_alone_do_not_drop_content(spark):
    page = '<html><body><nav><a>x</a></nav><article><h1>{0}</h1><p class="related-work">{1}</p><div class="side-by-side"><p>{2}</p></div><p class="hidden-gem">{3}</p></article><footer>f {4}</footer></body></html>'
    few = '<html><body><div id="wrap"><div class="ad">{4} buy</div><article><h1>{0}</h1><p>{1}</p></article><section class="comments"><p>{2} {3}</p></section></div></body></html>'
    pages = [(f"http://n{i % 3}.example/{i}", page.format(spun(i, 3), spun(i + 9, 20), spun(i + 99, 15), spun(i + 7, 9), i)) for i in range(9)] + [("http://single.example/", few.format(*(spun(k, 30) for k in range(4)), 1))]
    want = [f"{spun(i, 3)}\n{spun(i + 9, 20)}\n{spun(i + 99, 15)}\n{spun(i + 7, 9)}" for i in range(9)] + [f"{spun(0, 30)}\n{spun(1, 30)}"]
    assert extracted(spark, pages) == want


def brute_classes(pages):
    """Tokens by occurrence vector, classes of two or more in half the pages or more, in one order on all pages."""
    tokens = [[s for s, _, _ in extraction.Page(p).tokens if s] for p in pages]
    vectors = {}
    for t in {s for p in tokens for s in p}:
        vectors.setdefault(tuple(p.count(t) for p in tokens), set()).add(t)
    out = set()
    for vector, held in vectors.items():
        if len(held) > 1 and sum(v > 0 for v in vector) * 2 >= len(pages):
            orders = set()
            for p in tokens:
                mine = [t for t in p if t in held]
                orders.add(tuple(mine[: len(held)]) if mine and mine == mine[: len(held)] * (len(mine) // len(held)) else None if mine else ())
            if len(orders - {()}) == 1 and None not in orders:
                out |= held
    return out


def test_templates_against_plain_vectors(spark, sf):
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").withColumn("host", F.regexp_extract("url", "://([^/:?#]+)", 1))
    hosts = [r.host for r in rows.groupBy("host").count().where("count between 6 and 13").orderBy("host").collect()][:5]
    df = rows.where(F.col("host").isin(hosts))
    got = {r._host: set(r.template) for r in extraction.templates(df.select(F.col("page_id").alias("_key"), F.col("url").alias("_url"), F.col("html").alias("_html")), 0.5, 0, 1 << 24).collect()}
    for host in hosts:
        want = brute_classes([r.html for r in df.where(F.col("host") == host).collect()])
        assert {"<article>", "</article>", "<nav>", "<footer>"} <= want and got[host] <= want and {t for t in want if t[0] == "<"} - got[host] <= {"<br>", "<p>", "</p>", "<b>"}, host


def test_texts_change_without_the_template(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").limit(30).collect()]
    bare = [re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", p).replace(' class="ad"', "") for p in pages]
    assert sum(extraction.Page(p).text(set(), None, set()) != article(q) for p, q in zip(bare, pages, strict=True)) == len(pages)
    got = extracted(spark, [("http://one.example/", p) for p in bare])
    want = [article(p) for p in pages]
    assert sum(a.split("\n")[-1] == b.split("\n")[-1] or b in a for a, b in zip(got, want, strict=True)) >= 0.9 * len(pages)


def test_very_long_html(spark):
    page = "<html><body><div class='x'>" + "<p>" + "word " * 200_000 + "</p>" * 2 + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</div></body></html>"
    assert [len(t) for t in extracted(spark, [("http://long.example/", page)])] == [5 * 200_000 - 1 + 5]
