"""Main text of web pages, with site templates removed.

Pages are read into a light tree of elements.  Every subtree gets a hash; Spark counts on how many different pages of a
host it stands, and subtrees that recur on many of them are templates and go.  What the markup itself names as menu,
header, footer, sidebar, notice, advert, form or comment goes as well, and the text of the rest is cut into blocks.

A page's article (the `article` or `main` element) is never a template: copies of an article on one host are content.
Containers inside it (`div`, `ul` and so on) are templates if they recur with many different articles of the host; copies
of an article count as one, told by their longest text beside the container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_slices
from .common import save, small_batches

MIN_PAGES = 5
MIN_SHARE = 0.05
BROADCAST_ROWS = 200_000
MAX_DEPTH = 200  # deeper elements become siblings
NO_TEXT = (0, "", 0)

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())  # their content is no markup
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"option", "legend", "html", "body"}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table".split())
CONTAINERS = frozenset("div section ul ol dl table details address".split())
INSIDE = 0x5BD1E9955BD1E995  # names of subtrees inside an article are kept apart from those outside
GONE = RAW | frozenset("head nav footer aside form menu dialog button fieldset audio video canvas datalist noscript template svg object select".split())

# Words of class and id names.  The first mean boilerplate wherever they stand in a name, the second as its last word
# ("site-menu"), the third only as the whole name; words of form are no part of it ("share-buttons" is "share").
ANYWHERE = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies disqus footer gdpr nav navbar navigation newsletter pager pagination promo"
    " sidebar sponsor sponsored".split()
)
AT_END = frozenset("banner masthead header menu modal notice popup sharing subscribe toolbar widget".split())
ALONE = frozenset("consent hidden recommended related replies respond share side skip social".split())
OF_FORM = frozenset(
    "area articles bar block bottom box button buttons col column container content form grid group icon icons inner item items left link links list main outer panel posts right"
    " row section slot stories text title top unit widget wrap wrapper".split()
)
# Words that may stand beside those above in a name of boilerplate inside an article, where any other word keeps the element.
BESIDE = OF_FORM | frozenset("body consent count cta inline policy replies reply share sharing signup social thread".split())
_JOINT = re.compile(r"[_-]+")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
_NAME = re.compile(r"</?([a-zA-Z][^\s/><]*)")
_PLAIN = re.compile(r"[^<>\"']+")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "items", "name")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.items, self.name = tag, attrs, [], 0


class Scanner:
    """Cuts a page into texts and tags in one pass: what is not closed is never searched for again."""

    def __init__(self, page: str):
        self.page = page
        self.last = {x: page.rfind(x) for x in ('"', "'", ">", "-->", "]]>")}

    def find(self, what: str, at: int) -> int:
        return self.page.find(what, at) if at <= self.last[what] else -1

    def attributes(self, at: int) -> tuple[int, int]:
        """End of a tag's attributes, and where the page goes on.

        A quote counts only after an equals sign and if it is closed; a tag that is not closed ends at the next one.
        """
        page, n = self.page, len(self.page)
        while at < n:
            c = page[at]
            if c == ">":
                return at, at + 1
            if c == "<":
                return at, at
            if c in "\"'":
                close = self._value(at, c)
                at = close + 1 if close >= 0 else at + 1
            else:
                at = _PLAIN.match(page, at).end()
        return n, n

    def _value(self, at: int, quote: str) -> int:
        before = at - 1
        while before >= 0 and self.page[before].isspace():
            before -= 1
        return self.find(quote, at + 1) if before >= 0 and self.page[before] == "=" else -1

    def parts(self) -> Iterator[tuple[str, bool, str, int]]:
        """Text, or (name, whether it ends an element, attributes, where it ends); `skip` moves on."""
        page, n, at = self.page, len(self.page), 0
        while at < n:
            start = page.find("<", at)
            if start < 0:
                yield "", False, page[at:], n
                return
            if page.startswith("<!--", start):
                stop = self.find("-->", start + 4)
                after, text = (stop + 3 if stop >= 0 else n), ""
            elif page.startswith("<![CDATA[", start):
                stop = self.find("]]>", start + 9)
                after, text = (stop + 3 if stop >= 0 else n), html.escape(page[start + 9 : stop if stop >= 0 else n], quote=False)
            elif page.startswith(("<!", "<?"), start):
                stop = self.find(">", start)
                after, text = (stop + 1 if stop >= 0 else n), ""
            else:
                m = _NAME.match(page, start)
                if m is None:
                    yield "", False, page[at : start + 1], start + 1
                    at = start + 1
                    continue
                end, after = self.attributes(m.end())
                if start > at:
                    yield "", False, page[at:start], start
                self.at = after
                yield m[1].lower(), page[start + 1] == "/", page[m.end() : end], after
                at = self.at
                continue
            if start > at:
                yield "", False, page[at:start], start
            if text:
                yield "", False, text, after
            at = after


def tree(page: str) -> Node:
    """Elements and texts.  Tags that are not closed end where their parent or a later block ends them."""
    root = Node("#page", "")
    stack, n = [root], len(page)
    scanner, ends = Scanner(page), {}
    for tag, closing, attrs, at in scanner.parts():
        if not tag:
            stack[-1].items.append(attrs)
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body", "td", "th", "table") and tag not in BLOCK:
                    break  # a stray end tag of an inline element does not close a section
            continue
        if tag in CLOSES_P:
            # An open p, with the inline elements in it, ends where a block begins.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in same:
                    del stack[i:]
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "select", "menu"):
                    break
        node = Node(tag, attrs)
        stack[-1].items.append(node)
        if tag in RAW and not attrs.endswith("/"):
            close = ends.setdefault(tag, re.compile(rf"</{tag}\s*/?>", re.I)).search(page, at)
            node.items.append(page[at : close.start()] if close else page[at:])
            scanner.at = close.end() if close else n
        elif tag not in VOID and not attrs.endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def boilerplate_name(names: str, in_article: bool = False) -> bool:
    """Whether one of the class or id names means boilerplate.

    Inside an article a name counts only if all of its words do ("ad-slot", "comment-list"), as an article may well hold a
    "cookie-recipe" or its "comment-history"; a header holds the title.
    """
    for name in names.lower().split():
        words = [w for w in _JOINT.split(name) if w]
        if in_article:
            own = [w for w in words if w in ANYWHERE or (w in AT_END and w != "header")]
            if (own and all(w in ANYWHERE or w in AT_END or w in BESIDE or w.isdigit() for w in words)) or (len(words) == 1 and words[0] in ALONE):
                return True
            continue
        if not ANYWHERE.isdisjoint(words):
            return True
        while len(words) > 1 and (words[-1] in OF_FORM or words[-1].isdigit()):
            words.pop()
        if words and (words[-1] in AT_END or (len(words) == 1 and words[0] in ALONE)):
            return True
    return False


def _holds_prose(node: Node) -> bool:
    return node.tag in PROSE or any(not isinstance(x, str) and _holds_prose(x) for x in node.items)


def named_boilerplate(node: Node, in_article: bool = False) -> bool:
    """What the markup itself names as no content.

    A header inside an article holds its title and stays, and so does an element there that only one word such as "share"
    names and that holds paragraphs.
    """
    if node.tag in GONE or (node.tag == "header" and not in_article):
        return True
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(node.attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id") and boilerplate_name(value, in_article):
            if not (in_article and ALONE.issuperset(w for w in value.lower().split() if boilerplate_name(w, True)) and _holds_prose(node)):
                return True
    return False


def name_subtrees(node: Node) -> int:
    """Hash of tag, attributes and content of every element, white space in texts counted as one blank."""
    parts = [node.tag, _SPACE.sub(" ", node.attrs).strip()]
    for x in node.items:
        parts.append(_SPACE.sub(" ", x).strip() if isinstance(x, str) else f"<{name_subtrees(x)}>")
    node.name = xxhash.xxh3_64_intdigest("\x1f".join(parts)) - 2**63
    return node.name


def candidates(node: Node, inside: bool = False) -> set[int]:
    """Subtrees that may be templates: block elements with content that are no article and hold none."""

    def walk(x: Node) -> bool:
        holds = x.tag in ("article", "main", "html", "body", "#page")
        if x.tag in ("article", "main"):
            return True
        for y in x.items:
            if not isinstance(y, str):
                holds = walk(y) or holds
        if not holds and x.tag in BLOCK and x.items:
            out.add(x.name)
        return holds

    out: set[int] = set()
    walk(node)
    return out


def articles_of(root: Node) -> list[Node]:
    """The outermost article and main elements."""
    out: list[Node] = []

    def find(x: Node) -> None:
        for y in x.items:
            if not isinstance(y, str) and not named_boilerplate(y):
                if y.tag in ("article", "main"):
                    out.append(y)
                else:
                    find(y)

    find(root)
    return out


def sections(article: Node) -> tuple[list[tuple[int, str, int]], list[tuple[int, int, int, int]], list[int]]:
    """Text blocks (length, text, container), containers with text (name, first block, block after the last, container around
    it), and the container around each container, all numbered in page order from the article's 0."""
    texts: list[tuple[int, str, int]] = []
    found: list[tuple[int, int, int, int]] = []
    around = [0]
    now: list[str] = []

    def flush(owner: int) -> None:
        if now:
            text = _SPACE.sub(" ", "".join(now)).strip()
            if text:
                texts.append((len(text), text, owner))
            now.clear()

    def walk(x: Node, owner: int) -> bool:
        holds = False
        for y in x.items:
            if isinstance(y, str):
                now.append(y)
                continue
            if named_boilerplate(y, True):
                continue
            if y.tag in BLOCK:
                flush(owner)
            own, a = owner, len(texts)
            if y.tag in CONTAINERS:
                own = len(around)
                around.append(owner)
            inner = walk(y, own)
            if y.tag in BLOCK:
                flush(own)
            if own != owner and not inner and len(texts) > a:
                found.append((y.name, a, len(texts), owner))
            holds = holds or inner or y.tag in ("article", "main")
        return holds

    walk(article, 0)
    flush(0)
    return texts, found, around


def inside(root: Node) -> tuple[list[tuple[int, int, int]], set[int]]:
    """Containers inside the page's articles as (kind, key of the article, name), and the articles' keys.

    A key is the hash of the longest text outside the container: of kind 1 among the texts that stand directly in the
    article or in a container around it, of kind 2 among all.  A container without any text beside it is the article.
    """
    rows: set[tuple[int, int, int]] = set()
    keys: set[int] = set()
    key = lambda best: xxhash.xxh3_64_intdigest(best[1]) - 2**63
    for article in articles_of(root):
        texts, found, around = sections(article)
        if not texts:
            continue
        keys.add(key(max(texts)))
        # The longest text before and after each place, and in each container or one around it: one pass each.
        before = list(accumulate(texts, max, initial=NO_TEXT))
        after = list(accumulate(reversed(texts), max, initial=NO_TEXT))[::-1]
        own = [NO_TEXT] * len(around)
        for t in texts:
            own[t[2]] = max(own[t[2]], t)
        for i in range(1, len(own)):
            own[i] = max(own[i], own[around[i]])
        for name, a, b, owner in found:
            for kind, best in ((1, own[owner]), (2, max(before[a], after[b]))):
                if best is not NO_TEXT:
                    rows.add((kind, key(best), name ^ INSIDE))
    return list(rows), keys


def blocks(root: Node, templates: set[int] | frozenset[int]) -> list[str]:
    """Text blocks of the article, or of the page if it names none, in page order."""
    articles = articles_of(root)
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            text = _SPACE.sub(" ", html.unescape("".join(now))).strip()
            if text:
                out.append(text)
            now.clear()

    def walk(x: Node, in_article: bool) -> None:
        for y in x.items:
            if isinstance(y, str):
                now.append(y)
            elif y.tag in ("br", "wbr", "img"):
                now.append(" " if y.tag == "br" else "")
            elif not named_boilerplate(y, in_article) and (y.name ^ INSIDE if in_article else y.name) not in templates:
                if y.tag in BLOCK:
                    flush()
                walk(y, in_article or y.tag in ("article", "main"))
                if y.tag in BLOCK:
                    flush()

    for a in articles or [root]:
        walk(a, bool(articles))
        flush()
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "html"):
            rows: list[tuple[str, int, int, int | None]] = []
            for h, text in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                root = tree(text)
                name_subtrees(root)
                rows += [(h, 0, root.name, x) for x in candidates(root)]
                within, keys = inside(root)
                rows += [(h, *x) for x in within]
                rows += [(h, 1, k, None) for k in keys]  # without a name: to count the host's articles
            host, kind, page, name = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(kind, pa.int32()), pa.array(page, pa.int64()), pa.array(name, pa.int64())], ["host", "kind", "page", "name"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host and name of the subtrees that stand on many different pages of the host, or in many different articles."""
    seen = pages.mapInArrow(_rows, "host string, kind int, page long, name long")
    counted = seen.groupBy("host", "kind", "name", "page").agg(F.lit(1).alias("one")).groupBy("host", "kind", "name").agg(F.count("*").alias("pages"))
    counted = save(counted.filter((F.col("pages") >= min_pages) | F.col("name").isNull()), "counted")
    total = pages.groupBy("host", F.xxhash64("html").alias("page")).agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("all"))
    total = total.withColumn("within", F.lit(False)).unionByName(counted.filter("name is null").select("host", F.col("pages").alias("all"), F.lit(True).alias("within")))
    named = counted.filter("name is not null").withColumn("within", F.col("kind") > 0).join(total, ["host", "within"])
    return named.filter(F.col("pages") >= F.col("all") * min_share).select("host", "name").distinct()


def _extract(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = known.value if known is not None else None
        for batch in batches:
            for part in text_slices(batch, "html"):
                own = part.column("names").to_pylist() if shared is None else None
                texts = []
                for i, (host, text) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist())):
                    root = tree(text)
                    name_subtrees(root)
                    texts.append("\n".join(blocks(root, shared.get(host, frozenset()) if own is None else set(own[i] or ()))))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; other columns are ignored.

    Null html counts as empty and gives an empty text; pages with a null url share one host.  Repeated pages count once
    when templates are counted.  Up to `broadcast_rows` templates are broadcast; more are joined to the pages by the row.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"), F.xxhash64("page_id", "url", "html").alias("row"))
    schema = "page_id long, url string, text string, n_chars long"
    templates = save(site_templates(rows), "templates")
    if templates.count() <= broadcast_rows:
        table: dict[str, set[int]] = {}
        for r in templates.collect():
            table.setdefault(r["host"], set()).add(r["name"])
        return rows.mapInArrow(_extract(spark.sparkContext.broadcast(table)), schema)
    # Only the templates that a page holds travel with it.
    held = rows.select("row", "host", "html").mapInArrow(_held, "row long, host string, name long")
    mine = held.join(templates, ["host", "name"]).groupBy("row").agg(F.collect_set("name").alias("names"))
    return rows.join(mine, "row", "left").mapInArrow(_extract(None), schema)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hosts, names = [], [], []
        for row, host, text in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "html"))):
            root = tree(text)
            name_subtrees(root)
            mine = candidates(root) | {x[2] for x in inside(root)[0]}
            ids += [row] * len(mine)
            hosts += [host] * len(mine)
            names += mine
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(names, pa.int64())], ["row", "host", "name"])
