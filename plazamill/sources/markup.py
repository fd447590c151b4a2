"""A page's markup as a tree that column expressions can ask.

``tree`` parses each page once, in Arrow batches, into an array of nodes in document order and an array of the strings
between the tags. A node knows its parent, its last descendant, its depth and the range of its strings, so a subtree is
a slice of the node array and its text is a slice of the strings; no text is stored twice. ``node_rows`` gives the
same as one row a node.

References are decoded, any quoting of attributes is read, missing end tags are implied (li, dt, dd, p, tr, td, th,
option and their groups), and end tags that close nothing are left out. Text of script, style and template counts as
`data` of their node, not as text. Null and empty markup give a tree of no nodes; whatever is broken gives what could
be read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazamill.functions.context import let
from plazamill.functions.text import clean

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MUTE = frozenset(("script", "style", "template"))
#: Start tag: the open elements that it ends, unless one of the others stands between.
_LIST, _TABLE = ("ul", "ol", "menu"), ("table",)
_BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
IMPLIED = {
    "li": (("li",), _LIST), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), _TABLE), "td": (("td", "th"), ("tr", *_TABLE)), "th": (("td", "th"), ("tr", *_TABLE)),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "tr", "td", "th"), _TABLE)),
    **dict.fromkeys(_BLOCKS, (("p",), ("td", "th", "li", "div", "section", "article", "button"))),
}
NODE = pa.struct([
    ("at", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
    ("first", pa.int32()), ("past", pa.int32()), ("data", pa.string()),
])
TREE = pa.struct([("nodes", pa.list_(NODE)), ("texts", pa.list_(pa.string()))])
_INT, _TEXT = T.IntegerType(), T.StringType()
_KINDS = {"at": _INT, "parent": _INT, "last": _INT, "depth": _INT, "tag": _TEXT, "classes": T.ArrayType(_TEXT), "attrs": T.MapType(_TEXT, _TEXT), "first": _INT, "past": _INT, "data": _TEXT}
_TREE = T.StructType([T.StructField("nodes", T.ArrayType(T.StructType([T.StructField(k, v) for k, v in _KINDS.items()]))), T.StructField("texts", T.ArrayType(_TEXT))])


class _Parser(HTMLParser):
    """Nodes and strings of one page."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.texts: list[str] = []
        self.open: list[dict] = []
        self.feed(markup)
        self.close()
        self.shut(0)

    def shut(self, keep: int) -> None:
        """Ends the open elements but the outermost `keep`."""
        for node in self.open[keep:]:
            node["last"], node["past"] = len(self.nodes) - 1, len(self.texts)
        del self.open[keep:]

    def handle_starttag(self, tag, attrs):
        ends, walls = IMPLIED.get(tag, ((), ()))
        while ends:
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i]["tag"] in ends or self.open[i]["tag"] in walls), None)
            if at is None or self.open[at]["tag"] in walls:
                break
            self.shut(at)
        held = {k: v or "" for k, v in reversed(attrs)}
        up = self.open[-1]["at"] if self.open else -1
        node = {"at": len(self.nodes), "parent": up, "depth": len(self.open), "tag": tag, "classes": held.get("class", "").split(), "attrs": list(held.items()), "first": len(self.texts), "data": None}
        node["last"], node["past"] = node["at"], node["first"]
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i]["tag"] == tag), None)
        if at is not None:
            self.shut(at)

    def handle_data(self, data):
        if any(n["tag"] in MUTE for n in self.open):
            self.open[-1]["data"] = (self.open[-1]["data"] or "") + data
        elif data:
            self.texts.append(data)


@F.arrow_udf(_TREE)
def _trees(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        found = [_Parser(page.as_py() or "") for page in batch]
        yield pa.array([{"nodes": p.nodes, "texts": p.texts} for p in found], TREE)


@F.arrow_udf(_TEXT)
def _texts(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        yield pa.array([None if page is None else " ".join(_Parser(page).texts) for page in batch.to_pylist()], pa.string())


_tree, _text = _trees.asNondeterministic(), _texts.asNondeterministic()  # else the optimizer may parse a page once for every use


def tree(html: Column) -> Column:
    """struct(nodes, texts) of the page."""
    return _tree(html)


def text(html: Column) -> Column:
    """All text of the markup, single blanks; null stays null."""
    return clean(_text(html))


def said(page: Column, node: Column | None = None) -> Column:
    """The text of a node (null: of the page): its strings with blanks between, single blanks."""
    if node is None:
        return clean(F.array_join(page["texts"], " "))
    return let(node, lambda n: clean(F.array_join(_strings(page, n), " ")))


def joined(page: Column, node: Column) -> Column:
    """The text of a node with nothing put between its strings, single blanks."""
    return let(node, lambda n: clean(F.array_join(_strings(page, n), "")))


def _strings(page: Column, node: Column) -> Column:
    return F.slice(page["texts"], node["first"] + 1, node["past"] - node["first"])


def under(page: Column, node: Column) -> Column:
    """The descendants of a node, in document order."""
    return F.slice(page["nodes"], node["at"] + 2, node["last"] - node["at"])


def up(page: Column, node: Column, fits: Callable[[Column], Column]) -> Column:
    """The nearest ancestor that fits, or null."""
    nodes = page["nodes"]
    climb = lambda i, _: F.when(i < 0, i).otherwise(let(F.get(nodes, i), lambda x: F.when(fits(x), i).otherwise(x["parent"])))
    at = F.aggregate(F.sequence(F.lit(1), F.greatest(node["depth"], F.lit(1))), node["parent"], climb)
    return let(at, lambda i: let(F.get(nodes, i), lambda x: F.when(fits(x), x)))


def has_class(node: Column, *names: str) -> Column:
    return F.arrays_overlap(node["classes"], F.array(*[F.lit(n) for n in names]))


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def is_link(node: Column) -> Column:
    return (node["tag"] == "a") & attr(node, "href").isNotNull()


def hrefs(page: Column) -> Column:
    """Addresses of the links, as they stand."""
    return F.transform(F.filter(page["nodes"], is_link), lambda n: attr(n, "href"))


def title(page: Column) -> Column:
    """The text of the first title that has one; null without."""
    return F.get(F.filter(F.transform(F.filter(page["nodes"], lambda n: n["tag"] == "title"), lambda n: said(page, n)), lambda t: t != ""), F.lit(0))


def count(page: Column, *tags: str) -> Column:
    return F.size(F.filter(page["nodes"], lambda n: n["tag"].isin(*tags)))


def scripts(page: Column, kind: str | None = None) -> Column:
    """The texts of scripts, or of those of a type."""
    found = F.filter(page["nodes"], lambda n: (n["tag"] == "script") & n["data"].isNotNull() & (F.lit(True) if kind is None else F.lower(F.coalesce(attr(n, "type"), F.lit(""))) == kind))
    return F.transform(found, lambda n: n["data"])


def node_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row a node: the other columns, at, parent, last, depth, tag, classes, attrs, href and own_text (its strings
    outside of elements within it)."""
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    rows = pages.select(*others, tree(F.col(html)).alias("page"))
    page = F.col("page")

    def own(n: Column) -> Column:
        inner = F.filter(under(page, n), lambda x: x["parent"] == n["at"])
        spans = F.concat(F.array(F.struct(n["first"].alias("a"), n["first"].alias("b"))), F.transform(inner, lambda x: F.struct(x["first"].alias("a"), x["past"].alias("b"))), F.array(F.struct(n["past"].alias("a"), n["past"].alias("b"))))
        gaps = F.transform(F.slice(spans, 2, F.size(spans) - 1), lambda s, i: F.slice(page["texts"], F.get(spans, i)["b"] + 1, s["a"] - F.get(spans, i)["b"]))
        return clean(F.array_join(F.flatten(gaps), " "))

    nodes = F.transform(page["nodes"], lambda n: F.struct(*[n[c].alias(c) for c in ("at", "parent", "last", "depth", "tag", "classes", "attrs")], attr(n, "href").alias("href"), own(n).alias("own_text")))
    return rows.select(*others, F.explode(nodes).alias("node")).select(*others, "node.*")
