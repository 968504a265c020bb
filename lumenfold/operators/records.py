"""Records of web pages: elements found by tag, attributes, text and place, and the fields below them.

A page is read into a tree that forgives what is not closed; `Find` steps lead from the page to the elements that are
records and from a record to each field.  Pages are rows of their own, so this is one pass in batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
HOLDS = frozenset("ul ol table dl select div section article body html".split())


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    items: list = field(default_factory=list)

    def text(self) -> str:
        return "".join(x if isinstance(x, str) else x.text() for x in self.items if isinstance(x, str) or x.tag not in ("script", "style"))

    def below(self) -> Iterator[Element]:
        """All elements below, in the order of the page."""
        todo = [x for x in reversed(self.items) if isinstance(x, Element)]
        while todo:
            x = todo.pop()
            yield x
            todo += [y for y in reversed(x.items) if isinstance(y, Element)]


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Element("#page", {})]

    def handle_starttag(self, tag, attrs):
        closed = CLOSES.get(tag, ())
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in closed:
                del self.open[i:]
                break
            if self.open[i].tag in HOLDS:
                break
        new = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].items.append(new)
        if tag not in VOID and len(self.open) < 400:  # deeper elements become siblings
            self.open.append(new)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].items.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].items.append(data)


def page_tree(html: str) -> Element:
    r = _Reader()
    r.feed(html)
    r.close()
    return r.open[0]


@dataclass(frozen=True)
class Find:
    """A step down: elements at any depth with this tag, whose attributes and own text match these patterns.

    `nth` picks one of those found, from 0, or from the end if negative; without it all go on.
    """

    tag: str | None = None
    attrs: tuple[tuple[str, str], ...] = ()
    text: str | None = None
    nth: int | None = None

    def of(self, top: Element) -> list[Element]:
        found = [x for x in top.below() if self.fits(x)]
        if self.nth is None:
            return found
        return found[self.nth : self.nth + 1 or None]

    def fits(self, x: Element) -> bool:
        if self.tag is not None and x.tag != self.tag:
            return False
        if any(k not in x.attrs or not re.search(p, x.attrs[k]) for k, p in self.attrs):
            return False
        return self.text is None or any(isinstance(t, str) and re.search(self.text, t) for t in x.items)


def walk(top: Element, steps: Sequence[Find]) -> list[Element]:
    """The elements that the steps lead to, each once, in the order of the page."""
    now = [top]
    for s in steps:
        seen: set[int] = set()
        now = [y for x in now for y in s.of(x) if not (id(y) in seen or seen.add(id(y)))]
    return now


@dataclass(frozen=True)
class Field:
    """The first element of the steps (the record itself without any): its text or an attribute, and a group of a pattern in it."""

    steps: tuple[Find, ...] = ()
    attr: str | None = None
    pattern: str | None = None

    def of(self, record: Element) -> str | None:
        for x in walk(record, self.steps) if self.steps else [record]:
            value = x.attrs.get(self.attr) if self.attr else re.sub(r"\s+", " ", x.text()).strip()
            if value is None or self.pattern is None:
                return value
            if m := re.search(self.pattern, value):
                return m[1] if m.re.groups else m[0]
        return None


def page_records(pages: DataFrame, html: str, records: Sequence[Find], fields: Mapping[str, Field]) -> DataFrame:
    """One row for each record of a page: the page's other columns, nth (from 0) and a text column for each field.

    A field that a record does not have is null.  Null and empty pages have no records; repeated pages are read each.
    Columns of a page with the names of fields or nth are replaced.
    """
    names = [c for c in pages.columns if c != html and c not in fields and c != "nth"]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    records, fields = tuple(records), dict(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, nth, out = [], [], {c: [] for c in fields}
            for i, page in enumerate(b.column("html").to_pylist()):
                for n, r in enumerate(walk(page_tree(page), records)):
                    at.append(i)
                    nth.append(n)
                    for c, f in fields.items():
                        out[c].append(f.of(r))
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(at, pa.int32())), pa.array(nth, pa.int32()), *[pa.array(v, pa.string()) for v in out.values()]], ["row", "nth", *out])

    found = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("nth", IntegerType()), *[StructField(c, StringType()) for c in fields]]))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "nth", *fields)
