"""Products of listing pages: a table function over stored HTML, joined laterally with the pages.

A site's pattern names the element around each product (container), the link in it, and the element of its name, by simple selectors:
a tag, classes and an id (`li.item`, `a`, `#grid`), with a space for "within". One page is one call, so nothing is held beyond a page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Attributes of an image's address, best first, and the endings of image files.
SOURCES = ("src", "srcset", "data-src", "data-lazy-src", "data-original", "data-lazy-original", "data-srcset")
ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".svg", ".bmp", ".tiff")
#: Levels of a lineage: the container and what it stands in.
LEVELS = 3
UNKNOWN = "Unknown"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Element:
    def __init__(self, tag: str, attributes: dict[str, str], parent: _Element | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[_Element | str] = []

    def within(self) -> Iterator[_Element]:
        """All elements below, in page order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, _Element):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        own = [c for e in (self, *self.within()) for c in e.children if isinstance(c, str)]
        return " ".join(" ".join(own).split())

    def step(self) -> str:
        names = ".".join(self.attributes.get("class", "").split())
        return self.tag + (f".{names}" if names else "") + (f"#{self.attributes['id']}" if self.attributes.get("id") else "")


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        new = _Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in _VOID:
            self.at = new

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        self.at = e.parent if e.parent is not None else self.at

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _fits(e: _Element, simple: str) -> bool:
    tag = re.match(r"[\w-]*", simple)[0]
    own = set(e.attributes.get("class", "").split())
    return (not tag or e.tag == tag.lower()) and own.issuperset(re.findall(r"\.([\w-]+)", simple)) and all(e.attributes.get("id") == i for i in re.findall(r"#([\w-]+)", simple))


def select(root: _Element, selector: str) -> Iterator[_Element]:
    """The elements below root that a selector means, in page order."""
    steps = selector.split()
    for e in root.within() if steps else ():
        if not _fits(e, steps[-1]):
            continue
        up, left = e.parent, len(steps) - 1
        while left and up is not None:
            left -= _fits(up, steps[left - 1])
            up = up.parent
        if not left:
            yield e


def image_source(img: _Element) -> str | None:
    """The first address of an image element that is one of an image file; no SVG, as these are icons."""
    for name in SOURCES:
        value = img.attributes.get(name, "")
        if name.endswith("srcset"):
            value = (value.split(",")[0].split() or [""])[0]
        if any(x in value.lower() for x in ENDINGS):
            return None if ".svg" in value.lower() else value
    return None


def name_of_url(url: str) -> str:
    """A readable name from a URL's last segment; UNKNOWN where that is short or looks like an id."""
    last = re.sub(r"\.(jpg|jpeg|png|webp|gif|svg)$", "", url.split("/")[-1].split("?")[0], flags=re.I)
    if len(last) < 3 or re.fullmatch(r"[0-9a-fA-F]+", last):
        return UNKNOWN
    name = re.sub(r"([a-z])([A-Z])", r"\1 \2", re.sub(r"[-_]", " ", last))
    name = re.sub(r"(?a:\b\w)", lambda m: m[0].upper(), " ".join(name.split()))
    return name if len(name) > 2 and name != last.upper() else UNKNOWN


@udtf
class ListingProducts:
    """html, container, link, name selector -> pos, href, name, images, lineage, one row per product (href) in page order.

    A container without a link's href is passed over. The name comes from the URL, else from the name selector's text, else from an
    image's alt text. Containers of one href are one product with all of their images, each once. Null or empty html: no rows. The pattern's
    selectors are constants of the query, and a name column is there only if the pattern has a selector or images can name a product.
    """

    @staticmethod
    def analyze(html: AnalyzeArgument, container: AnalyzeArgument, link: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
        for what, argument in (("container", container), ("link", link), ("name", name)):
            if not argument.isConstantExpression:
                raise ValueError(f"the selector of the {what} must be a constant")
        if not (container.value or "").strip():
            raise ValueError("a pattern needs the selector of its container")
        return AnalyzeResult(StructType().add("pos", IntegerType()).add("href", StringType()).add("name", StringType()).add("images", ArrayType(StringType())).add("lineage", StringType()))

    def eval(self, html: str, container: str, link: str, name: str):  # noqa: ANN201
        tree = _Tree()
        tree.feed(html or "")
        tree.close()
        products: dict[str, dict] = {}
        for box in select(tree.root, container):
            anchor = box if not link or link == container else next(select(box, link), None)
            href = anchor.attributes.get("href") if anchor is not None else None
            if not href:
                continue
            found = [(s, e.attributes.get("alt", "")) for e in select(box, "img") if (s := image_source(e))]
            product = products.setdefault(href, {"name": name_of_url(href), "images": [], "lineage": self._lineage(box)})
            if product["name"] == UNKNOWN:
                named = next(select(box, name), None) if name else None
                text = named.text() if named is not None else ""
                product["name"] = text or next((alt.strip() for _, alt in found if alt.strip()), UNKNOWN)
            product["images"] += [s for s, _ in found if s not in product["images"]]
        for pos, (href, p) in enumerate(products.items()):
            yield pos, href, p["name"], list(dict.fromkeys(p["images"])), p["lineage"]

    @staticmethod
    def _lineage(e: _Element) -> str:
        path: list[str] = []
        at: _Element | None = e
        while at is not None and at.tag and at.tag != "body" and len(path) < LEVELS:
            path.insert(0, at.step())
            at = at.parent
        return " > ".join(path)


def listing_products(pages: DataFrame, container: str, link: str = "a", name: str = "", html: str = "html") -> DataFrame:
    """pages with pos, href, name, images and lineage of every product that the pattern finds in them; pages without any have no row."""
    spark: SparkSession = pages.sparkSession
    spark.udtf.register("listing_products", ListingProducts)
    quoted = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in (container, link, name))
    return spark.sql(f"SELECT p.*, l.* FROM {{pages}} p, LATERAL listing_products(p.`{html}`, {quoted}) l", pages=pages)
