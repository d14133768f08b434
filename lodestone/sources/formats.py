"""Python data sources: glyph layers of pages, test sets and reports, read file by file in tasks.

Files are found by Spark's own file listing on the driver and read in tasks, one partition a
group of files; a file that is broken gives one row with its ``problem`` instead of ending the job.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GLYPHS = "path string, document_id long, page int, seq int, x double, y double, w double, s string, problem string"
CASES = "path string, name string, agent_id string, prompt string, turns array<string>, rubric string, expected_document_ids array<string>, expected_facts array<string>, forbidden_facts array<string>, require_citation boolean, problem string"
REPORTS = "path string, name string, score double, reasoning string, metrics map<string,double>, problem string"


GLYPH_PAGES = "path string, document_id long, page int, glyphs array<struct<x: double, y: double, w: double, s: string>>, problem string"
GLYPH_KINDS = {"path": pa.string(), "document_id": pa.int64(), "page": pa.int32(), "seq": pa.int32(), "x": pa.float64(), "y": pa.float64(), "w": pa.float64(), "s": pa.string(), "problem": pa.string()}


def _open(uri: str) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as stream:
        return stream.read()


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class FilesReader(DataSourceReader):
    """Rows of ``parse(path, data)`` of each file; ``files`` of them make a partition."""

    def __init__(self, paths: list[str], parse, width: int, files: int) -> None:
        self.paths, self.parse, self.width, self.files = paths, parse, width, files

    def partitions(self) -> list[Files]:
        return [Files(self.paths[i : i + self.files]) for i in range(0, len(self.paths), self.files)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                rows = list(self.parse(path, _open(path)))
            except Exception as error:  # noqa: BLE001  one bad file is a row of its own
                rows = [(path, *[None] * (self.width - 2), f"{type(error).__name__}: {error}")]
            yield from self.shown(rows)

    def shown(self, rows: list[tuple]) -> Iterator:
        return iter(rows)


class ColumnsReader(FilesReader):
    """The same in Arrow batches, for sources of many small rows."""

    def shown(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, GLYPH_KINDS.values(), strict=True)], list(GLYPH_KINDS))


class BatchesReader(FilesReader):
    """The same for sources that parse a file into Arrow batches: no row of it is a Python object for long."""

    def shown(self, rows: list) -> Iterator[pa.RecordBatch]:
        for row in rows:
            yield row if isinstance(row, pa.RecordBatch) else _pages([row[:3]], [None], row[-1])


class _Source(DataSource):
    columns, parse, reading = "", None, FilesReader

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> FilesReader:
        paths = json.loads(self.options["paths"])
        return type(self).reading(paths, type(self).parse, len(schema.fields), int(self.options.get("files", "16")))


def _number(value) -> float | None:
    return None if value is None else float(value)


def _lines(path: str, data: bytes) -> Iterator[tuple[str, int | None, int, list]]:
    """Path, document, page and glyphs of each line; only line feeds end a line, as a text may hold other separators."""
    for line in io.BytesIO(data):
        if line.strip():
            page = json.loads(line)
            document = page["document_id"]
            yield path, None if document is None else int(document), int(page["page"]), page.get("glyphs") or []


def glyphs(path: str, data: bytes) -> Iterator[tuple]:
    """A JSON object a line: ``document_id, page`` and ``glyphs``, a list of [x, y, w, s]; a page without glyphs has one null row."""
    for *own, marks in _lines(path, data):
        if not marks:
            yield (*own, 0, 0.0, 0.0, 0.0, None, None)
        for seq, (x, y, w, s) in enumerate(marks):
            yield (*own, seq, _number(x), _number(y), _number(w), s, None)


def glyph_pages(path: str, data: bytes) -> Iterator[pa.RecordBatch]:
    """The same lines, a row each, with their glyphs in a list."""
    own, marks, held = [], [], 0
    for *place, found in _lines(path, data):
        own.append(place)
        marks.append(found)
        held += len(found)
        if held > 10_000 or len(own) == 1000:
            yield _pages(own, marks)
            own, marks, held = [], [], 0
    if own:
        yield _pages(own, marks)


def _pages(own: list, marks: list[list | None], problem: str | None = None) -> pa.RecordBatch:
    """Rows of GLYPH_PAGES."""
    flat = [m for page in marks for m in page or []]
    x, y, w, s = zip(*flat, strict=True) if flat else ((),) * 4
    parts = pa.StructArray.from_arrays([*(pa.array(c, pa.float64()) for c in (x, y, w)), pa.array(s, pa.string())], ["x", "y", "w", "s"])
    ends = [0]
    for page in marks:
        ends.append(ends[-1] + len(page or []))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
    columns = [pa.array(c, k) for c, k in zip(zip(*own, strict=True), (pa.string(), pa.int64(), pa.int32()), strict=True)]
    return pa.RecordBatch.from_arrays([*columns, lists, pa.array([problem] * len(own), pa.string())], ["path", "document_id", "page", "glyphs", "problem"])


def cases(path: str, data: bytes) -> Iterator[tuple]:
    """A YAML or JSON test set: a list of cases, or an object with ``cases``."""
    import yaml

    loaded = yaml.safe_load(data.decode("utf-8"))
    for case in (loaded.get("cases") if isinstance(loaded, dict) else loaded) or []:
        text = lambda name: None if case.get(name) is None else str(case[name])  # noqa: B023, E731
        many = lambda name: [str(x) for x in case.get(name) or []]  # noqa: B023, E731
        yield (path, text("name"), text("agent_id"), text("prompt"), many("turns"), text("rubric"), many("expected_document_ids"), many("expected_facts"), many("forbidden_facts"), bool(case.get("require_citation")), None)


def reports(path: str, data: bytes) -> Iterator[tuple]:
    """A JSON report with ``results``: name, score, reasoning and metrics (numbers by name; others are left out)."""
    loaded = json.loads(data.decode("utf-8"))
    for r in loaded["results"]:
        metrics = {str(k): float(v) for k, v in (r.get("metrics") or {}).items() if isinstance(v, (int, float, bool)) and v is not None}
        yield (path, r.get("name"), _number(r.get("score")), r.get("reasoning"), metrics, None)


class GlyphSource(_Source):
    columns, parse, reading = GLYPHS, staticmethod(glyphs), ColumnsReader

    @classmethod
    def name(cls) -> str:
        return "lodestone_glyphs"


class GlyphPageSource(_Source):
    columns, parse, reading = GLYPH_PAGES, staticmethod(glyph_pages), BatchesReader

    @classmethod
    def name(cls) -> str:
        return "lodestone_glyph_pages"


class CaseSource(_Source):
    columns, parse = CASES, staticmethod(cases)

    @classmethod
    def name(cls) -> str:
        return "lodestone_cases"


class ReportSource(_Source):
    columns, parse = REPORTS, staticmethod(reports)

    @classmethod
    def name(cls) -> str:
        return "lodestone_reports"


def read(spark: SparkSession, source: type[_Source], path: str, files: int = 16):
    """The files below ``path`` (a folder or a pattern) through a source of this module, ``files`` of them a task."""
    spark.dataSource.register(source)
    listed = spark.read.format("binaryFile").load(path).inputFiles()
    return spark.read.format(source.name()).option("paths", json.dumps(sorted(listed))).option("files", str(files)).load()
