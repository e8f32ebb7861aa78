"""Structure-aware chunks of the blocks of a page, as one pass over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.html import PIECE_BYTES, parsed
from siltstone.functions.pieces import spans
from siltstone.operators.crawl import saved_pages

#: Characters after which a chunk is closed, characters of it that begin the next, section before any heading.
CHUNK_SIZE, OVERLAP, FIRST_SECTION = 800, 150, "General"
#: The marks around a heading in linear text.
SECTION_START, SECTION_END = "___SECTION_START___", "___SECTION_END___"


def _fold(tags: list[str], texts: list[str], size: int, overlap: int, section: str) -> list[tuple[str, str, str]]:
    """The chunks of one page's blocks, in one pass; the parts of an open chunk are joined once, when it closes."""
    out, parts, length = [], [], 0
    for tag, text in zip(tags, texts, strict=True):
        if tag.startswith("h"):
            if parts:
                out.append(("".join(parts).strip(" "), text, section))
            section, parts, length = text, [], 0
            continue
        for part in (text, " ") if parts else (f"[{section}] ", text, " "):
            parts.append(part)
            length += len(part)
        if length > size:
            whole = "".join(parts)
            out.append((whole.strip(" "), section, section))
            parts = [f"[{section}] ... ", whole[-overlap:] if length > overlap and overlap else ""]
            length = sum(map(len, parts))
    if parts:
        out.append(("".join(parts).strip(" "), section, section))
    return out


def chunked(blocks: Column, *, size: int = CHUNK_SIZE, overlap: int = OVERLAP, first_section: str = FIRST_SECTION) -> Column:
    """array of (text, section, section_of_text) from an array of (tag, text), in time linear in the blocks.

    A heading closes the chunk before it, which by then bears the new heading as its ``section``; the heading under
    which its text stood is ``section_of_text``. A chunk is closed once it is longer than ``size``, and the next begins
    with its end, which is emitted even if nothing follows. Null blocks have null chunks.
    """

    def run(lists):
        import pyarrow as pa
        import pyarrow.compute as pc

        ends, inner, valid = lists.offsets.to_numpy(), lists.values, lists.is_valid().to_pylist()
        columns = [inner.field(inner.type.get_field_index(c)) for c in ("tag", "text")]
        before = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(columns[1]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]
        kind = pa.list_(pa.struct([pa.field(c, pa.string()) for c in ("text", "section", "section_of_text")]))
        out = []
        for a, b in spans(before[ends[1:]] - before[ends[:-1]], PIECE_BYTES):
            at = ends[a]
            tags, texts = ([x or "" for x in c.slice(at, ends[b] - at).to_pylist()] for c in columns)
            pages = [_fold(tags[i - at : j - at], texts[i - at : j - at], size, overlap, first_section) if v else None for i, j, v in zip(ends[a:b], ends[a + 1 : b + 1], valid[a:b], strict=True)]
            out.append(pa.array([None if p is None else [dict(zip(("text", "section", "section_of_text"), c, strict=True)) for c in p] for p in pages], kind))
        return pa.concat_arrays([pa.array([], kind), *out])

    return F.arrow_udf(run, "array<struct<text:string,section:string,section_of_text:string>>")(blocks)


def marked_text(blocks: Column) -> Column:
    """All blocks on one line, headings between marks."""
    return F.array_join(F.transform(blocks, lambda b: F.when(b["tag"].startswith("h"), F.concat(F.lit(f"{SECTION_START} "), b["plain"], F.lit(f" {SECTION_END}"))).otherwise(b["text"])), " ")


def blocks(pages: DataFrame, *, bare_references: bool = True) -> DataFrame:
    """page_id, pos, tag, text of every block of the main content."""
    return parsed(pages.select("page_id", "html"), bare_references=bare_references).select("page_id", F.inline("blocks")).drop("plain")


def page_chunks(pages: DataFrame, *, bare_references: bool = True, **options) -> DataFrame:
    """page_id, ordinal, section, text of every page's chunks."""
    return parsed(pages.select("page_id", "html"), bare_references=bare_references).select("page_id", F.posexplode(chunked(F.col("blocks"), **options)).alias("ordinal", "c")).select("page_id", "ordinal", "c.section", "c.text", "c.section_of_text")


def relative_path(path: Column, root: str) -> Column:
    """Below the root without it, elsewhere whole."""
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 2_147_483_647)).otherwise(path)


def _of_files(files: DataFrame, source: str, first: list[str], bare_references: bool = True) -> DataFrame:
    """Chunks with their metadata from name, source_path, html; ids begin with the columns ``first``."""
    doc_id = F.replace(F.regexp_replace("name", r"\.html$", ""), F.lit("-"), F.lit("_"))
    read = parsed(files.select("name", "source_path", "html"), bare_references=bare_references).where("error is null")
    out = read.select(doc_id.alias("doc_id"), F.lit(source).alias("source"), "source_path", F.posexplode(chunked(F.col("blocks"))).alias("ordinal", "c"))
    return out.select(F.concat_ws("_", *first, F.col("ordinal").cast("string")).alias("chunk_id"), "doc_id", "source", "source_path", "c.section", "c.text", "ordinal")


def corpus(pages: DataFrame, *, source: str = "Knowledge Base", folder: str = "data/raw/", bare_references: bool = True) -> DataFrame:
    """Chunks with their metadata from the saved files of all pages; a page that fails has none."""
    return _of_files(saved_pages(pages).select("name", F.concat(F.lit(folder), F.col("name")).alias("source_path"), "html"), source, ["doc_id"], bare_references)


def folder_corpus(files: DataFrame, root: str, *, source: str = "Knowledge Base") -> DataFrame:
    """The same from files (path, html) below ``root``; ``source_path`` is the path below it.

    Files of one name in two folders share a ``doc_id``; the path tells their chunks' ids apart.
    """
    below = relative_path(F.col("path"), root.rstrip("/") + "/")
    named = files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), below.alias("source_path"), "html")
    return _of_files(named, source, ["source_path"])
