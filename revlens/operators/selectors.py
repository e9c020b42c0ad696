"""Typed records from saved pages by a selector specification.

A ``Records`` specification names the container element of a record and its
fields: where a field's element stands inside the container (tag, class,
attributes, one step inside the other), what is read of it, and its type.  It
is checked once, travels to the tasks as a plain object, and every page is parsed once; all
fields of all containers are read off that one parse.  A record whose field is
missing or not of its type is bad: ``skip`` leaves it out, ``stop`` leaves
out the rest of its page as well, ``keep`` returns it with nulls.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Opening one of these ends an open element of the named kinds, unless one of LIMITS stands between.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "div": ("p",), "ul": ("p",), "ol": ("p",), "table": ("p",), "section": ("p",), "article": ("p",)}
LIMITS = frozenset("article body div section main nav ul ol dl table td th form blockquote".split())
TYPES = {"string": (T.StringType(), str), "int": (T.IntegerType(), int), "double": (T.DoubleType(), float)}


class Element:
    """An element with its children (elements and texts) in order."""

    __slots__ = ("tag", "attributes", "inside")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.inside = tag, attributes, []

    def below(self) -> Iterator[Element]:
        """All elements inside, in the page's order."""
        stack = [iter(self.inside)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Element):
                yield child
                stack.append(iter(child.inside))

    def text(self) -> str:
        """Text inside, scripts and styles left out, white space runs as one space."""
        out, stack = [], [iter(self.inside)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                out.append(child)
            elif child.tag not in ("script", "style"):
                stack.append(iter(child.inside))
        return " ".join("".join(out).split())


class _Tree(HTMLParser):
    """One pass over a page; unclosed elements end where browsers end them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = ENDS.get(tag, ())
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in ends:
                del self.open[k:]
                break
            if self.open[k].tag in LIMITS:
                break
        made = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].inside.append(made)
        if tag not in VOID:
            self.open.append(made)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def parse(page: str | None) -> Element:
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    return tree.root


@dataclass(frozen=True)
class Step:
    """An element: its tag, its class (one name of several, or the whole value if it has a space) and other attributes
    (a value, or None for any)."""

    tag: str
    cls: str | None = None
    attributes: tuple[tuple[str, str | None], ...] = ()

    def fits(self, e: Element) -> bool:
        if e.tag != self.tag:
            return False
        if self.cls is not None:
            value = e.attributes.get("class", "")
            if value != self.cls and (" " in self.cls or self.cls not in value.split()):
                return False
        return all(k in e.attributes and (v is None or e.attributes[k] == v) for k, v in self.attributes)


def first(e: Element, path: tuple[Step, ...]) -> Element | None:
    """The first element of the last step inside the first of the step before, and so on; ``e`` itself for no step."""
    for step in path:
        e = next(filter(step.fits, e.below()), None)
        if e is None:
            return None
    return e


@dataclass(frozen=True)
class Field:
    """A column: the element's text, an attribute's value, or the part after the last "_" of its last class name.

    ``scale`` divides numbers.  An ``optional`` field may be missing, but not of another type."""

    name: str
    path: tuple[Step, ...] = ()
    take: str = "text"
    kind: str = "string"
    scale: float = 1
    optional: bool = False

    def __post_init__(self):
        if self.kind not in TYPES or not (self.take in ("text", "class suffix") or self.take.startswith("@")):
            raise ValueError(f"field {self.name}: {self.kind}, {self.take}")

    def read(self, e: Element):
        """The typed value; raises if the element, the attribute or the type is not there."""
        found = first(e, self.path)
        if found is None:
            raise LookupError(self.name)
        if self.take == "text":
            raw = found.text()
        elif self.take == "class suffix":
            raw = found.attributes["class"].split()[-1].split("_")[-1]
        else:
            raw = found.attributes[self.take[1:]]
        value = TYPES[self.kind][1](raw)
        return value if self.scale == 1 else TYPES[self.kind][1](value / self.scale)


@dataclass(frozen=True)
class Pairs:
    """A map column: one entry for each element that fits, its label and its value; the later of equal labels holds."""

    name: str
    each: Step
    label: Field
    value: Field

    def read(self, e: Element) -> list[tuple]:
        return list({self.label.read(x): self.value.read(x) for x in e.below() if self.each.fits(x)}.items())


@dataclass(frozen=True)
class Records:
    """Records of a page: every element of the last step of ``path`` inside any of the step before."""

    path: tuple[Step, ...]
    fields: tuple[Field | Pairs, ...]
    on_error: str = "skip"
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        names = tuple(f.name for f in self.fields)
        if self.on_error not in ("skip", "stop", "keep") or len(set(names)) < len(names) or not self.path:
            raise ValueError("a specification needs a container, fields of different names and an error policy")
        object.__setattr__(self, "names", names)

    def containers(self, root: Element) -> list[Element]:
        found = [root]
        for step in self.path:
            seen, inner = set(), []
            for e in found:
                for x in e.below():
                    if id(x) not in seen and step.fits(x):
                        seen.add(id(x))
                        inner.append(x)
            found = inner
        return found

    def read(self, page: str | None) -> Iterator[tuple[int, list]]:
        """(place among the page's containers, values) of the records that the error policy lets through."""
        for i, e in enumerate(self.containers(parse(page))):
            row, bad = [], False
            for f in self.fields:
                try:
                    row.append(f.read(e))
                except LookupError:
                    row.append(None)
                    bad |= not getattr(f, "optional", False)
                except ValueError:
                    row.append(None)
                    bad = True
            if bad and self.on_error == "stop":
                return
            if not bad or self.on_error == "keep":
                yield i, row

    def schema(self, key: T.StructField) -> T.StructType:
        def kind(f):
            return T.MapType(TYPES[f.label.kind][0], TYPES[f.value.kind][0]) if isinstance(f, Pairs) else TYPES[f.kind][0]
        return T.StructType([key, T.StructField("block_idx", T.IntegerType()), *[T.StructField(f.name, kind(f)) for f in self.fields]])


def extract(pages: DataFrame, spec: Records, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, block_idx, fields): the records of every page; a null or empty page has none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = spec.schema(pages.schema[page])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [(k, i, *row) for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for i, row in spec.read(text)]
                columns = list(zip(*rows)) if rows else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return pages.select(page, html).mapInArrow(run, schema)
