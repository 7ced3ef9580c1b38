"""Pages to chunks: tables stay whole, prose is cut at natural breaks, every chunk is a slice of its page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import _c, chunk_id

#: Lines of a table; breaks from the strongest to the weakest.
_TABLE = re.compile(r"\s*(?:\|.*\||\[table \d+\])\s*")
_BREAKS = ("\n\n", "\n", ". ", " ")


@dataclass(frozen=True)
class ChunkOptions:
    target: int = 1800
    overlap: int = 200
    least: int = 120
    slide: int = 3600


def table_runs(text: str) -> list[tuple[int, int, bool]]:
    """The page as runs of table lines and other lines: (start, end, is table)."""
    runs: list[list] = []
    at = 0
    for line in text.splitlines(keepends=True):
        table = _TABLE.fullmatch(line) is not None
        if runs and runs[-1][2] == table:
            runs[-1][1] = at + len(line)
        else:
            runs.append([at, at + len(line), table])
        at += len(line)
    return [tuple(r) for r in runs] or [(0, len(text), False)]


def _cut(text: str, start: int, end: int, o: ChunkOptions) -> Iterator[tuple[int, int]]:
    while True:
        stop = start + o.target
        if stop >= end:
            yield start, end
            return
        tail = (text.rfind(b, start, stop) for b in _BREAKS)
        stop = next((i + len(b) for i, b in zip(tail, _BREAKS) if i - start > o.target // 2), stop)
        yield start, stop
        start = max(start + 1, stop - o.overlap)


def page_spans(text: str, whole: bool = False, o: ChunkOptions = ChunkOptions()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a page's chunks; blank pages have none.

    A table joins the chunk before it if that keeps within the target and half the table; a piece shorter than ``least``
    is joined to the chunk before; a short slide (``whole``) is one chunk.
    """
    if not text.strip():
        return []
    runs = table_runs(text)
    spans: list[tuple[int, int]] = []
    if whole and len(text) <= o.slide:
        spans = [(0, len(text))]
    else:
        for start, end, table in runs:
            if not table:
                spans += _cut(text, start, end, o)
            elif spans and end - spans[-1][0] <= o.target + (end - start) // 2:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
    joined: list[tuple[int, int]] = []
    for start, end in spans:
        size = len(text[start:end].strip())
        if joined and size < o.least:
            joined[-1] = (joined[-1][0], end)
        elif size:
            joined.append((start, end))
    out = []
    for start, end in joined:
        share = sum(max(0, min(end, e) - max(start, s)) for s, e, table in runs if table) / max(1, end - start)
        out.append((start, end, "table" if share >= 0.7 else "mixed" if share else "prose"))
    return out


def chunk_pages(pages: DataFrame, o: ChunkOptions = ChunkOptions(), whole_col: str | None = None) -> DataFrame:
    """Chunks of all pages (``doc_id, page_index, char_start, text``); repeated texts of a document count once, the first wins.

    Null texts have no chunks. Pages are independent; only the chunks' ids are compared across a document.
    """
    whole = _c(whole_col) if whole_col else F.lit(False)
    rows = pages.select("doc_id", "page_index", "char_start", "text", whole.alias("whole")).filter(F.col("text").isNotNull())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, start, end, kind, body = [], [], [], [], []
            for i, (text, w) in enumerate(zip(b.column("text").to_pylist(), b.column("whole").to_pylist())):
                for s, e, k in page_spans(text, bool(w), o):
                    at.append(i)
                    start.append(s)
                    end.append(e)
                    kind.append(k)
                    body.append(text[s:e])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(take) for c in ("doc_id", "page_index", "char_start")] + [pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(kind, pa.string()), pa.array(body, pa.string())],
                names=["doc_id", "page_index", "page_start", "s", "e", "kind", "text"],
            )

    doc = pages.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(cut, f"doc_id {doc}, page_index int, page_start bigint, s bigint, e bigint, kind string, text string")
    out = out.select(
        chunk_id("doc_id", "text").alias("chunk_id"), "doc_id", F.col("page_index").alias("page_index_start"), F.col("page_index").alias("page_index_end"),
        "text", (F.col("page_start") + F.col("s")).alias("char_start"), (F.col("page_start") + F.col("e")).alias("char_end"), "kind",
    )
    first = Window.partitionBy("doc_id", "chunk_id").orderBy("page_index_start", "char_start", "char_end")
    return out.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


#: Phrases of pages without facts.
NOTICES = (
    "safe harbour", "safe harbor", "disclaimer", "forward-looking statement", "forward looking statement", "no representation or warranty",
    "table of contents", "this page has been intentionally left blank", "all rights reserved",
)


def boilerplate_reason(text, kind, least: int = 120, min_alpha: float = 0.35):
    """Why a chunk can't hold facts: too_short, table_of_contents, low_alpha_ratio, boilerplate_notice; null if it can."""
    t = F.trim(F.regexp_replace(_c(text), r"^\s+|\s+$", ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    leaders = F.filter(lines, lambda x: x.rlike(r"\.{4,}|\s\.\s\.\s\."))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace(t, r"[^\p{Nd}]", ""))
    size = F.greatest(F.length(t), F.lit(1))
    return (
        F.when(F.length(t) < least, "too_short")
        .when(F.size(leaders) / F.greatest(F.size(lines), F.lit(1)) > 0.3, "table_of_contents")
        .when((letters / size < min_alpha) & ~F.coalesce(_c(kind) == "table", F.lit(False)), "low_alpha_ratio")
        .when(F.lower(t).rlike("|".join(NOTICES)) & (digits / size < 0.01), "boilerplate_notice")
    )


def page_offsets(pages: DataFrame) -> DataFrame:
    """``char_start, char_end`` of each page in its document's buffer, pages being joined by an empty line."""
    before = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("text", F.lit("")))
    rows = pages.dropDuplicates(["doc_id", "page_index"])
    start = F.coalesce(F.sum(size + 2).over(before), F.lit(0)).cast("bigint")
    return rows.select("doc_id", "page_index", start.alias("char_start"), (start + size).alias("char_end"))


def resolve_pages(points: DataFrame, pages: DataFrame, point_col: str = "char_start") -> DataFrame:
    """Adds ``page_index, page_label`` of the page whose closed range holds the point; the lowest page of several, null of none.

    A range join within a document: both sides are partitioned by it.
    """
    p = pages.select(F.col("doc_id").alias("_d"), F.col("page_index").alias("_i"), F.col("page_label").alias("_l"), F.col("char_start").alias("_s"), F.coalesce("char_end", F.col("char_start") + F.length("text")).alias("_e")).distinct()
    keys = points.columns
    hit = (F.col("doc_id") == F.col("_d")) & F.col(point_col).between(F.col("_s"), F.col("_e"))
    joined = points.withColumn("_row", F.monotonically_increasing_id()).join(p, hit, "left")
    return joined.groupBy("_row", *keys).agg(F.min("_i").alias("page_index"), F.min_by("_l", "_i").alias("page_label")).drop("_row")


def table_is_useful(rows) -> object:
    """At least 2 rows and 2 columns, half the cells filled, 60% of those distinct; ``rows`` is array<array<string>>."""
    cells = F.flatten(_c(rows))
    filled = F.filter(cells, lambda x: x.isNotNull() & (F.trim(x) != ""))
    width = F.aggregate(_c(rows), F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    return (F.size(_c(rows)) >= 2) & (width >= 2) & (F.size(filled) / F.greatest(F.size(cells), F.lit(1)) >= 0.5) & (
        F.size(F.array_distinct(filled)) / F.greatest(F.size(filled), F.lit(1)) >= 0.6
    )


def looks_like_slides(pages: DataFrame, most: int = 1800) -> DataFrame:
    """``doc_id, is_slides``: the median page is short."""
    return pages.groupBy("doc_id").agg((F.median(F.length(F.coalesce("text", F.lit("")))) <= most).alias("is_slides"))


def sparse_pages(pages: DataFrame, least: int = 50) -> DataFrame:
    """Pages with hardly any text: ``doc_id, page_index, warning``."""
    n = F.length(F.trim(F.coalesce("text_plain", "text", F.lit(""))))
    return pages.filter(n < least).select("doc_id", "page_index", F.when(n == 0, "image_only_page").otherwise("empty_page").alias("warning")).distinct()
