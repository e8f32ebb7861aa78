"""Tolerant reading of HTML pages, batch-wise in Arrow; a page that fails has an error and never fails the job."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.pieces import spans
from siltstone.schemas import PARSED

#: Elements without content, elements that are dropped whole, elements that are blocks.
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
JUNK = frozenset("script style noscript header footer nav aside form".split())
BLOCKS = ("h1", "h2", "h3", "p", "li")
#: Elements that hold the main content, best first.
MAIN = ("main", "article", "body")
#: Bytes of pages that a worker holds as Python objects at once, or one page.
PIECE_BYTES = 1_000_000

#: An ampersand, and the reference it begins if that ends with a semicolon.
_REFERENCE = re.compile("&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))?")


def _whole_references(html: str) -> str:
    """The page with every ampersand escaped that begins no known reference with a semicolon."""
    return _REFERENCE.sub(lambda m: m[0] if len(m[0]) > 1 and (m[1] is None or m[1] in html5) else "&amp;" + m[0][1:], html)


class _Page(HTMLParser):
    """Elements and texts in document order; an end tag closes the nearest open element of its name, if any.

    An element is [tag, first text, text after its last, position after its last descendant, dropped].
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.texts: list[tuple[str, bool]] = []
        self.open: list[int] = []
        self.links: list[str] = []
        self.run: list[str] = []

    def _flush(self) -> None:
        if self.run:
            self.texts.append(("".join(self.run), bool(self.open) and self.elements[self.open[-1]][4]))
            self.run = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag == "a":
            self.links += [v or "" for k, v in attrs if k == "href"][-1:]
        dropped = tag in JUNK or bool(self.open) and self.elements[self.open[-1]][4]
        self.elements.append([tag, len(self.texts), None, None, dropped])
        if tag in VOID:
            self._close(len(self.elements) - 1)
        else:
            self.open.append(len(self.elements) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, k: int) -> None:
        self.elements[k][2:4] = len(self.texts), len(self.elements)

    def handle_endtag(self, tag):
        self._flush()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[depth]][0] == tag:
                for k in self.open[depth:]:
                    self._close(k)
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.run.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def done(self) -> _Page:
        self.close()
        self._flush()
        for k in self.open:
            self._close(k)
        self.open = []
        return self


def parse(html: str, bare_references: bool = True) -> tuple[list[dict], str, list[str]]:
    """Blocks of the main content, its whole text with normal white space, and the links of the page.

    ``bare_references``: whether ``&amp`` without a semicolon, as where a text was cut within it, is read as browsers do
    (``&``), or stays as it is.
    """
    page = _Page()
    page.feed(html if bare_references else _whole_references(html))
    page.done()
    live = [(k, e) for k, e in enumerate(page.elements) if not e[4]]
    root = next(((k, e) for name in MAIN for k, e in live if e[0] == name), None)
    first, last, lo, hi = (root[0] + 1, root[1][3], root[1][1], root[1][2]) if root else (0, len(page.elements), 0, len(page.texts))
    stripped = [None if dropped else text.strip() for text, dropped in page.texts]
    blocks = []
    for _, e in ((k, e) for k, e in live if first <= k < last and e[0] in BLOCKS):
        own = [t for t in stripped[e[1] : e[2]] if t]
        if own:
            blocks.append({"pos": len(blocks), "tag": e[0], "text": " ".join(own), "plain": "".join(own)})
    clean = " ".join(" ".join(text for text, dropped in page.texts[lo:hi] if not dropped).split())
    return blocks, clean, page.links


def _reader(others: list[str], bare_references: bool):
    """Arrow batches with the columns ``others`` and __html to what :func:`parsed` returns, in pieces."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        block = pa.struct([("pos", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("plain", pa.string())])
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column("__html")), 0).to_numpy(zero_copy_only=False)
            for a, b in spans(sizes, PIECE_BYTES):
                batch, rows = whole.slice(a, b - a), []
                for html in batch.column("__html").to_pylist():
                    try:
                        rows.append((*parse(html, bare_references), None))
                    except Exception as e:  # noqa: BLE001 one bad page must not end the job
                        rows.append(([], None, [], f"{type(e).__name__}: {e}"))
                blocks, clean, links, error = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in others), pa.array(blocks, pa.list_(block)), pa.array(clean, pa.string()), pa.array(links, pa.list_(pa.string())), pa.array(error, pa.string())],
                    names=[*others, "blocks", "clean", "links", "error"],
                )

    return run


def parsed(pages: DataFrame, html_col: str = "html", *, bare_references: bool = True) -> DataFrame:
    """``pages`` without the HTML, with blocks, clean, links and error (see :func:`parse`). A null page has an error."""
    others = [c for c in pages.columns if c not in (html_col, "blocks", "clean", "links", "error")]
    source = pages.select(*others, F.col(html_col).alias("__html"))
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others), PARSED])
    return source.mapInArrow(_reader(others, bare_references), schema)


def _joined(base, href):
    import pandas as pd

    def one(b, h):
        try:
            return urljoin(b, h).split("#")[0]
        except ValueError:
            return None

    return pd.Series([one(b, h) if isinstance(b, str) and isinstance(h, str) else None for b, h in zip(base, href, strict=True)])


def resolved(base: Column, href: Column) -> Column:
    """The absolute URL of a link without its fragment; null if it has none."""
    return F.pandas_udf(_joined, "string")(base, href)
