"""Structure-aware chunkers, applied per document in Arrow batches.

All take a size and overlap in code points.  A carried overlap is the tail of the chunk before,
shortened to the room that the next piece leaves and never crossing an oversized piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.constants import TRIM_CHARS
from lodestone.functions.text import chunk_params

_SPACE = TRIM_CHARS
_BLANK = re.compile(r"\n[\t\n\f\r ]*\n+")
_SENTENCE = re.compile(r"[^。！？.!?]*+(?:[。！？.!?]++|\Z)")  # the rest after the last mark too: a text without marks is read once, not from every place
_HEADING = re.compile(r"(#{1,6})[\t\n\f\r ]+(.*)")
_ITEM = re.compile(r"[\t\n\f\r ]*([-*+]|[0-9]+[.)])[\t\n\f\r ]+")
_DELIMITER = re.compile(r"\|?[\t\n\f\r ]*:?-+:?[\t\n\f\r ]*(\|[\t\n\f\r ]*:?-+:?[\t\n\f\r ]*)*\|?")


def trim(text: str) -> str:
    return text.strip(_SPACE)


def windows(text: str, size: int, overlap: int) -> list[str]:
    size, overlap = chunk_params(size, overlap)
    out, start = [], 0
    while start < len(text):
        if piece := trim(text[start : start + size]):
            out.append(piece)
        if start + size >= len(text):
            break
        start += size - overlap
    return out


@dataclass
class Gatherer:
    """Joins pieces up to a room; what a full chunk hands on is the tail of its text."""

    glue: str
    lead: str  # between a carried tail and the piece after it
    overlap: int

    def __post_init__(self) -> None:
        self.held: list[str] = []
        self.length = 0  # of the pieces held, each with the glue behind it
        self.carried = ""

    def release(self, hand_on: bool) -> str | None:
        """The text held, if any; keeps its tail for the next piece or forgets all tails."""
        body = self.glue.join(self.held) if self.held else None
        if body is not None or not hand_on:
            self.carried = body[-self.overlap :] if body and hand_on and self.overlap > 0 else ""
        self.held, self.length = [], 0
        return body

    def put(self, piece: str, room: int) -> str | None:
        """Adds a piece of at most ``room``; returns the chunk that had to close before it."""
        closed = self.release(True) if self.held and self.length + len(piece) > room else None
        if not self.held and self.carried:
            spare = room - len(piece) - len(self.lead)
            if spare > 0:
                piece = self.carried[-spare:] + self.lead + piece
            self.carried = ""
        self.held.append(piece)
        self.length += len(piece) + len(self.glue)
        return closed


def _gather(pieces: list[str], size: int, overlap: int, glue: str, lead: str, oversize) -> list[str]:
    own, out = Gatherer(glue, lead, overlap), []

    def add(body: str | None) -> None:
        if body and (body := trim(body)):
            out.append(body)

    for piece in pieces:
        if len(piece) > size:
            add(own.release(False))
            out.extend(oversize(piece, size, overlap))
        else:
            add(own.put(piece, size))
    add(own.release(False))
    return out


def by_sentence(text: str, size: int, overlap: int) -> list[str]:
    size, overlap = chunk_params(size, overlap)
    return _gather([s for s in map(trim, _SENTENCE.findall(text)) if s], size, overlap, " ", " ", windows)


def by_paragraph(text: str, size: int, overlap: int) -> list[str]:
    size, overlap = chunk_params(size, overlap)
    if len(text) <= size and "\n" not in text:
        return [whole] if (whole := trim(text)) else []
    parts = [p for p in map(trim, _BLANK.split(text.replace("\r\n", "\n"))) if p]
    return _gather(parts, size, overlap, "\n\n", "\n", by_sentence)


def markdown_blocks(text: str) -> list[tuple[str, int, str]]:
    """(kind, heading level, text) of headings, fenced code, tables, list items and paragraphs.

    A list item with its further lines, and a paragraph, last until the next line of another
    kind; a fence that is not closed lasts to the end, blank lines included.
    """
    lines, blocks, at = text.replace("\r\n", "\n").split("\n"), [], 0

    def kind_at(i: int) -> str:
        line = trim(lines[i])
        if not line:
            return "blank"
        if line[:3] in ("```", "~~~"):
            return "code"
        if _HEADING.fullmatch(line):
            return "heading"
        if "|" in line and i + 1 < len(lines) and _DELIMITER.fullmatch(trim(lines[i + 1])):
            return "table"
        return "list" if _ITEM.match(lines[i]) else "paragraph"

    while at < len(lines):
        kind, start = kind_at(at), at
        if kind == "blank":
            at += 1
            continue
        if kind == "heading":
            marks, title = _HEADING.fullmatch(trim(lines[at])).groups()
            blocks.append(("heading", len(marks), trim(title)))
            at += 1
            continue
        at += 1
        if kind == "code":
            fence = trim(lines[start])[:3]
            while at < len(lines) and trim(lines[at])[:3] != fence:
                at += 1
            at += 1
        elif kind == "table":
            while at < len(lines) and trim(lines[at]) and "|" in lines[at]:
                at += 1
        else:
            while at < len(lines) and kind_at(at) == "paragraph":
                at += 1
        blocks.append((kind, 0, "\n".join(lines[start:at])))
    return blocks


def with_headings(titles: list[str], body: str, size: int) -> str:
    """Body under its heading path; outer headings go first, then the innermost is cut, so that the size holds."""
    room = size - len(body) - 2
    if not titles or room <= 0:
        return body
    paths = (" > ".join(titles[outer:]) for outer in range(len(titles)))
    shown = next((path for path in paths if len(path) <= room), titles[-1][:room])
    return f"{shown}\n\n{body}"


def by_markdown(text: str, size: int, overlap: int) -> list[tuple[str, str | None]]:
    """(content, section title); overlap stays within a heading, and a text of headings only is chunked as their path."""
    size, overlap = chunk_params(size, overlap)
    stack: list[tuple[int, str]] = []
    own, out, seen = Gatherer("\n\n", "\n", overlap), [], []

    def add(body: str | None) -> None:
        if body is not None:
            titles = [t for _, t in stack]
            out.append((with_headings(titles, body, size), titles[-1] if titles else None))

    for kind, level, block in markdown_blocks(text):
        if kind == "heading":
            add(own.release(False))
            seen.append(block)
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, block))
            continue
        path = " > ".join(t for _, t in stack)
        room = max(size - len(path) - 2, max(size // 2, 1)) if path else size
        if len(block) > room:
            add(own.release(False))
            for piece in windows(block, room, overlap):
                add(piece)
        else:
            add(own.put(block, room))
    add(own.release(False))
    return out or [(piece, seen[-1]) for piece in windows(" > ".join(seen), size, overlap)]


def chunk_one(kind: str | None, text: str | None, size: int, overlap: int) -> list[tuple[str, str | None]]:
    if not text:
        return []
    if kind == "md":
        return by_markdown(text, size, overlap)
    if kind == "sentence":
        return [(c, None) for c in by_sentence(text, size, overlap)]
    return [(c, None) for c in by_paragraph(text, size, overlap)]


def chunk_documents(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """``document_id, file_type, text, page_number`` (and ``document_version``, if there) to chunks, indexed from 0 in page order within a document and version.

    ``md`` goes by markdown, ``sentence`` by sentences, all else by paragraphs; pages are rows
    of their own, so no chunk and no overlap crosses a page.
    """
    keys = [c for c in ("document_id", "document_version") if c in docs.columns]
    names = [*keys, "page_number", "chunk_index", "content", "section_title"]
    kinds = [*[pa.int64()] * len(keys), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text")):
                rows = []
                for *own, kind, text, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if own != last:
                        last, n = own, 0
                    for content, title in chunk_one(kind, text, size, overlap):
                        rows.append((*own, page, n, content, title))
                        n += 1
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "".join(f"{k} long, " for k in keys) + "page_number int, chunk_index int, content string, section_title string"
    own = docs.select(*(F.col(k).cast("long").alias(k) for k in keys), "file_type", "text", F.col("page_number").cast("int"))
    # the texts are dealt out, not the chunks, and a document's chunks are counted as they are made
    return own.repartition(*keys).sortWithinPartitions(*keys, "page_number", "text").mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have up to ``most`` bytes, one row at least: a task holds the Python texts of one part."""
    first, held = 0, 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if at > first and held + size > most:
            yield batch.slice(first, at - first)
            first, held = at, 0
        held += size
    if batch.num_rows:
        yield batch.slice(first)
