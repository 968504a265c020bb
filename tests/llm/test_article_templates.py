import random
import time

import pytest

from lumenfold.llm import html


@pytest.fixture(scope="module")
def pages():
    """A host whose articles hold a block of a neutral class, and a host with near copies of one article."""
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    block = "<div class='k7'><p>Read our other stories and write to us about them whenever you like to</p><ul><li>One</li><li>Two</li></ul></div>"
    links = "<ul><li>Link a</li><li>Link b</li></ul>"
    data, want = [], {}

    def add(host, body, lines):
        i = len(data)
        data.append((i, f"http://{host}.example/{i}", f"<html><body><nav>Menu {i}</nav>{body}<footer>f</footer></body></html>"))
        want[i] = "\n".join(lines)

    for i in range(12):
        p, q, own = text(20), text(30), text(6)
        add("a", f"<article><h1>Title {i}</h1><div class='body'><p>{p}</p>{block}<p>{q}</p><div class='k8'>{own}</div></div>{links}</article>", [f"Title {i}", p, q, own])
    p, q = text(20), text(30)
    for i in range(12):
        add("b", f"<article><h1>Title</h1><p>{p}</p><div class='k9'><p>Facts of this article</p></div><p>{q}</p><p>Day {i}</p></article>", ["Title", p, "Facts of this article", q, f"Day {i}"])
    for i in range(3):
        p = text(20)
        add("c", f"<main><p>{p}</p>{block}</main>", [p, "Read our other stories and write to us about them whenever you like to", "One", "Two"])
    for i in range(6):
        add("d", f"<article><div class='all'><p>The same story on six pages</p></div></article><p>page {i}</p>", ["The same story on six pages"])
    return data, want


@pytest.mark.parametrize("limit", [1000, 0])
def test_blocks_that_recur_in_articles_go_and_copied_articles_stay(spark, pages, limit):
    data, want = pages
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in html.main_text(df, broadcast_rows=limit).collect()} == want


def test_an_article_of_many_containers_takes_linear_time():
    root = html.tree("<article>" + "".join(f"<div>text number {i} of it</div>" for i in range(20_000)) + "</article>")
    html.name_subtrees(root)
    start = time.perf_counter()
    rows, keys = html.inside(root)
    assert time.perf_counter() - start < 5 and len(keys) == 1
    assert len(rows) == 20_000 and {r[0] for r in rows} == {2}  # nothing stands beside the containers


@pytest.mark.parametrize("name", ["ad", "ad-slot", "top_ads", "site-header", "share", "share-buttons", "related-posts", "side", "cookie-notice", "comment-author", "main menu", "skip-link", "widget-2"])
def test_names_of_boilerplate(name):
    assert html.boilerplate_name(name)


@pytest.mark.parametrize("name", ["", "-", "share-price", "side-by-side", "overflow-hidden", "related-work", "social-history", "menu-of-the-day", "reader", "adelaide", "article-content", "k7"])
def test_names_of_content(name):
    assert not html.boilerplate_name(name)


def test_a_header_named_in_an_article_stays():
    page = "<div class='page-header'>Site</div><article><div class='entry-header'><h1>Title</h1></div><p class='share-price'>Ten</p><div class='share'>Share</div></article>"
    assert html.blocks(html.tree(page), frozenset()) == ["Title", "Ten"]
