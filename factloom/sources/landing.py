"""Where documents come from and where results go: landing directories, page sources, traces and exports."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "doc_id string, filename string, collection string, page_index int, page_label string, text string, text_plain string, warning string"
MOST_BYTES = 80 * 1024 * 1024


class PageSource(Protocol):
    """Reads one file's pages: (label, text, plain text)."""

    def __call__(self, content: bytes) -> list[tuple[str | None, str, str | None]]: ...


def text_pages(content: bytes) -> list[tuple[str | None, str, str | None]]:
    """Plain text files, pages parted by form feeds."""
    return [(str(i + 1), t, t) for i, t in enumerate(content.decode("utf-8", "replace").split("\f"))]


def pdf_pages(content: bytes) -> list[tuple[str | None, str, str | None]]:
    """PDF files, where a PDF library is installed on the executors."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("no PDF library is installed; give another page source") from e
    with pymupdf.open(stream=content, filetype="pdf") as doc:
        return [(p.get_label() or str(i + 1), p.get_text(), p.get_text()) for i, p in enumerate(doc)]


def scan_directory(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """Files under ``root``, at any depth: ``doc_id`` (digest of the bytes), ``filename, collection`` (the folder), ``content``.

    Empty files and those over 80 MiB are left out, as an upload of them would be refused.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    files = files.filter((F.col("length") > 0) & (F.col("length") <= MOST_BYTES))
    return files.select(F.sha2("content", 256).alias("doc_id"), F.element_at(parts, -1).alias("filename"), F.element_at(parts, -2).alias("collection"), "path", "content").dropDuplicates(["doc_id"])


def read_pages(files: DataFrame, source: PageSource = text_pages) -> DataFrame:
    """One row a page; a file that can't be read gives one row with a warning and no text."""
    names = [f.split()[0] for f in PAGE_SCHEMA.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, name, coll, content in zip(*(b.column(c).to_pylist() for c in ("doc_id", "filename", "collection", "content"))):
                try:
                    rows = [(doc, name, coll, i, label, text, plain, None) for i, (label, text, plain) in enumerate(source(content))]
                except Exception as e:  # noqa: BLE001
                    rows = [(doc, name, coll, 0, None, None, None, f"{type(e).__name__}: {e}"[:600])]
                types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.select("doc_id", "filename", "collection", "content").mapInArrow(read, PAGE_SCHEMA)


def append_trace(events: DataFrame, path: str) -> None:
    """Trace events as lines of JSON."""
    events.write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str, schema: str, kind: str | None = None, limit: int = 500) -> DataFrame:
    """The last ``limit`` events (of a ``kind``) by ``at``; broken lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    return rows.orderBy(F.desc("at")).limit(limit)


def export_tables(tables: dict[str, DataFrame], path: str, limit: int = 100_000, drop: tuple[str, ...] = ("text", "embedding")) -> None:
    """Each table as JSON lines below ``path``, without the heavy columns."""
    for name, df in tables.items():
        df.drop(*drop).limit(limit).write.mode("overwrite").json(f"{path}/{name}")


def export_json(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text a row."""
    return df.drop(*drop).select(F.to_json(F.struct(*[c for c in df.columns if c not in drop]), {"ignoreNullFields": "false"}).alias("json"))
