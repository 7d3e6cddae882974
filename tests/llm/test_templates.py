"""Main text of pages whose article is known."""

import html
import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import templates

WORDS = "the of light water under stone river over morning seven lamp quiet green field amber north".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def paragraphs(rng, n=6):
    return [sentence(rng, rng.randint(12, 40)) for _ in range(n)]


def extract(spark, rows):
    df = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(rows)], "page_id long, url string, html string")
    return {r["page_id"]: r for r in templates.extract(df).collect()}


def test_given_pages(spark, folder):
    """The given pages keep their article in one element."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    want = {}
    for r in pages:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
    got = {r["page_id"]: r for r in templates.query(spark, folder).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_marked_elements(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</article>";</script></head><body class="page with-sidebar">
      <header class="top"><h2>Site</h2></header><nav>Menu</nav><div class="cookie-notice">We use cookies</div>
      <div id="wrap" class="sidebar-layout"><article><header><h1>Real &amp; title</h1></header><p>One <b>bo</b>ld<br>two&nbsp;three
      <p>Second <a href="x">link</a> &lt;b&gt;<ul><li>item one<li>item two</ul><form>Name <input></form><aside>Aside</aside>
      <div class="advert-box">Buy</div><table><tr><td>c1<td>c2</table><!-- hidden --></article></div>
      <section id="comments"><h3>Comments</h3><article class="comment"><p>Great post</p></article></section><footer>&copy; me</footer>"""
    got = extract(spark, [("http://a.example/1", page)])[0]
    assert got["text"] == "Real & title One bold two three Second link <b> item one item two c1 c2"
    assert [b["text"] for b in got["blocks"] if not b["kept"]][:3] == ["Site", "Menu", "We use cookies"]


def host_pages(rng, n, body):
    return [(f"https://H.example/{i}?q", body(i, rng)) for i in range(n)]


def test_template_of_unmarked_elements(spark):
    """No element names help: what recurs on the pages is template, the fullest container is the article."""
    rng, truth = random.Random(5), []

    def body(i, rng):
        title, text = sentence(rng, 5), paragraphs(rng)
        truth.append(" ".join([title, *text]))
        talk = "".join(f"<div class=q7><span>{sentence(rng, 2)}</span><div class=q8>{sentence(rng, 8)}</div></div>" for _ in range(rng.randint(0, 3)))
        return (
            f"<html><body><div class=q1><div class=q2><a href=/>Home</a> <a href=/n>News</a></div></div><div class=q3><h1>{title}</h1>"
            f"<div class=q4>{''.join(f'<p>{t}</p>' for t in text[:3])}<div class=q9>Sign up for letter {i} of ours today.</div>"
            f"{''.join(f'<p>{t}</p>' for t in text[3:])}</div></div><div class=q5>{talk}</div><div class=q6>All rights kept {i}.</div></body></html>")

    got = extract(spark, host_pages(rng, 12, body))
    assert [got[i]["text"] for i in range(12)] == truth


def test_recurring_line_in_articles_stays(spark):
    """A line that many articles share stands among others in its element, so it is no template."""
    rng, truth = random.Random(6), []

    def body(i, rng):
        text = [*paragraphs(rng, 3), "The same line in all articles.", *paragraphs(rng, 2)]
        truth.append(" ".join(text))
        return f"<nav>Menu</nav><article>{''.join(f'<p>{t}</p>' for t in text)}</article><footer>End</footer>"

    got = extract(spark, host_pages(rng, 10, body))
    assert [got[i]["text"] for i in range(10)] == truth


def test_copies_of_one_page(spark):
    page = "<body><nav>Menu</nav><article><p>All alike.</p></article></body>"
    got = extract(spark, [("http://c.example/", page)] * 6)
    assert {r["text"] for r in got.values()} == {"All alike."}


def test_odd_pages(spark):
    long = "<article>" + "<p>word &amp; <i>wo</i>rd</p>" * 20_000
    broken = '<article><p>before <a href="x>after</a> more</article>' + "<a \"" * 3000
    rows = [(None, None), ("", ""), ("x", "no markup & <3 text"), ("http://h/", "<p>a<p>b"), ("http://h/", "<p>a<p>b"), ("http://l/", long), ("http://b/", broken),
            ("http://d/", "<div>" * 2000 + "deep"), ("http://e/", "<!-- open"), ("http://f/", "<script>x"), ("http://g/", "a\x00b<br>c")]
    df = spark.createDataFrame(rows, "url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1)).withColumn("page", F.lit(2)).withColumn("tokens", F.lit(3))
    got = templates.extract(df).collect()
    assert len(got) == len(rows)
    text = {(r["url"], r["html"]): r["text"] for r in got}
    assert text[(None, None)] == "" and text[("", "")] == "" and text[("x", "no markup & <3 text")] == "no markup & <3 text"
    assert text[("http://h/", "<p>a<p>b")] == "a b" and text[("http://l/", long)] == " ".join(["word & word"] * 20_000)
    assert text[("http://d/", "<div>" * 2000 + "deep")] == "deep" and text[("http://e/", "<!-- open")] == ""
    assert templates.extract(spark.createDataFrame([], "url string, html string")).collect() == []


def test_nesting():
    root, item = 1, 2
    good = [(10, root), (20, item), (21, item), (20, item), (21, item), (11, root)]
    verdict = templates.nesting(good)
    assert verdict[root] and verdict[item]
    assert templates.nesting([(20, item), (21, item), (21, item), (20, item)])[item] == 0
    crossed = [(10, root), (20, item), (11, root), (21, item)]
    assert 0 in templates.nesting(crossed).values()


def test_vectors_do_not_depend_on_batches(spark, folder):
    """Sums of vectors are the same however pages are dealt out."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select(templates.host_of(F.col("url")).alias("host"), F.col("html").alias("page"))
    few = {(r["host"], tuple(sorted((t["token"], t["class"]) for t in r["tokens"]))) for r in templates.classes(pages.coalesce(1)).collect()}
    many = {(r["host"], tuple(sorted((t["token"], t["class"]) for t in r["tokens"]))) for r in templates.classes(pages.repartition(13)).collect()}
    assert few == many and few
    assert np.all([len({c for _, c in t}) <= len(t) // 2 for _, t in few])
