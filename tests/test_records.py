"""Records of pages against the values they were made from."""

import random

from lumenfold.operators.records import Field, Find, page_records, page_tree, walk

POST = Find("div", attrs=(("id", r"^M_"),))
LINK = lambda name: Find("a", attrs=(("href", f"/{name}"),), nth=0)
FIELDS = {
    "mid": Field(attr="id", pattern="M_(.*)"),
    "text": Field((Find("span", attrs=(("class", r"(^|\s)ctt(\s|$)"),), nth=0),)),
    "votes": Field((Find("div", nth=-1), LINK("attitude")), pattern=r"\[(\d+)\]"),
    "reposts": Field((Find("div", nth=-1), LINK("repost")), pattern=r"\[(\d+)\]"),
    "device": Field((Find("div", nth=-1), Find("span", attrs=(("class", "^ct$"),))), pattern=r"via (.*)"),
}


def page(posts, broken):
    out = ["<html><body><div class=top><input name=mp type=hidden value=7>"]
    for mid, text, votes, reposts, device in posts:
        out.append(f"<div class='c' id=\"M_{mid}\"><div><span class='x ctt'>{text}</span></div><div>see <a href='/attitude/{mid}'>like[{votes}]</a> <a href='/repost/{mid}'>repost[{reposts}]</a>")
        out.append(f"<span class=ct>today{' via ' + device if device else ''}</span>")
        out.append("</div></div>" if not broken else "</b></div><p></div>")
    return "".join(out) + "</body>"


def test_posts(spark):
    rng = random.Random(5)
    pages, want = [], []
    for n in range(30):
        posts = [(f"z{n}q{i}", f"post &amp; {i} é  x", rng.randint(0, 99), rng.randint(0, 9), rng.choice(["a phone", None])) for i in range(n % 5)]
        pages.append((n, page(posts, n % 2), "old"))
        want += [(n, i, m, f"post & {i} é x", str(v), str(r), d) for i, (m, _, v, r, d) in enumerate(posts)]
    pages += [(90, None, "o"), (91, "", "o"), (92, "<div id=M_<<", "o"), (93, "<div>" * 3000 + "x", "o")]
    df = spark.createDataFrame(pages, "page int, html string, text string")
    got = [tuple(r) for r in page_records(df, "html", [POST], FIELDS).collect() if r["page"] != 92]
    assert sorted(got) == sorted(want)
    hidden = page_records(df, "html", [Find("input", attrs=(("name", "^mp$"),))], {"pages": Field(attr="value")}).collect()
    assert len(hidden) == 30 and all(r["pages"] == "7" for r in hidden)
    assert page_records(df.limit(0), "html", [POST], FIELDS).count() == 0


def test_steps():
    top = page_tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>one<p>two<b>x</b><td>k<br>l")
    assert [e.text() for e in walk(top, [Find("li")])] == ["a", "bc", "c", "d"]
    assert [e.text() for e in walk(top, [Find("ul"), Find("li", nth=-1)])] == ["d", "c"]
    assert [e.tag for e in walk(top, [Find(text="^tw")])] == ["p"] and [e.text() for e in walk(top, [Find("p", nth=1), Find("b")])] == ["x"]
    assert walk(top, [Find("p", nth=9)]) == [] and Field((Find("i"),)).of(top) is None


def test_heads_of_odd_pages(spark, tmp_path):
    """Equal to SQL also where a page has no or other elements, open references and other spaces."""
    from lumenfold import catalog
    from oracle import compare

    odd = [
        None, "", "x", "<html><title>a</title>", '<HTML lang="en"><title>b</title>', '<html lang="fr" class="x"><head><meta charset="utf-8"><title> R&amp;D&amp;amp; &amp </title><h1>a<b>c</b>\n d</h1>',
        '<html class="x" lang="de"><h1 id="y">no</h1><h1>&#39;&lt;&quot;&gt;&copy;&nbsp;</h1><title></title>', "<title> 　a  b\t  </title><h1>\n x \n</h1>", "<title>open", '<html lang="a"><html lang="b"><meta charset="">',
        "<!-- <title>in a comment</title> --><title>later</title>", "<h1>one</h1><h1>two</h1>", "<title>a&amp;lt;b&amp;amp;lt;</title>", '<script>var charset="z"</script><meta charset="utf-8">',
    ]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(odd)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    compare(spark, catalog.queries()["page_heads"], catalog.oracle_sql()["page_heads"], str(tmp_path))
