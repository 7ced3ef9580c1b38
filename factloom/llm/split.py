"""Cutting oversized items at natural boundaries with overlap.

Sizes are prefix sums over the item's units (one per code point, or one weight per code point from a tokenizer); each
separator's start offsets are a sorted array, and the last one inside the limit is found by binary search.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators from the strongest break to the weakest.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def boundary_arrays(text: str, separators: Sequence[str] = SEPARATORS) -> list[list[int]]:
    """Sorted start offsets of every (also overlapping) occurrence of each separator."""
    return [[m.start() for m in re.finditer(f"(?={re.escape(s)})", text)] for s in separators]


def split_spans(
    text: str,
    limit: int = 1800,
    overlap: int = 200,
    separators: Sequence[str] = SEPARATORS,
    offsets: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Pieces ``[start, end)`` of ``text`` (code points), each within ``limit`` size units.

    ``offsets`` is the prefix sum of sizes, ``len(text) + 1`` long; without it one code point is one unit. A break counts
    if it lies wholly inside the window and begins more than half the limit after the start. The next piece starts
    ``overlap`` units before the cut, and at least one code point later than the last one did.
    An empty text gives one empty piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n = len(text)
    unit = offsets is None
    total = n if unit else int(offsets[-1])
    if total <= limit:
        return [(0, n)]
    at = boundary_arrays(text, separators)
    spans, start = [], 0
    while True:
        used = start if unit else int(offsets[start])
        if total - used <= limit:
            spans.append((start, n))
            return spans
        stop = start + limit if unit else max(start + 1, int(np.searchsorted(offsets, used + limit, "right")) - 1)
        half = start + limit // 2 if unit else int(np.searchsorted(offsets, used + limit // 2, "right")) - 1
        end = stop
        for sep, starts in zip(separators, at):
            i = bisect_right(starts, stop - len(sep)) - 1
            if i >= 0 and starts[i] > half:
                end = starts[i] + len(sep)
                break
        spans.append((start, end))
        back = end - overlap if unit else int(np.searchsorted(offsets, int(offsets[end]) - overlap, "left"))
        start = max(start + 1, back)


def token_offsets(text: str, weigh: Callable[[str], Sequence[int]]) -> np.ndarray:
    """Prefix sums of the sizes that ``weigh`` gives for the code points of ``text``."""
    return np.concatenate([[0], np.cumsum(np.asarray(weigh(text), dtype=np.int64))])


def byte_sizes(text: str) -> np.ndarray:
    """UTF-8 bytes of each code point: the tokens of a byte tokenizer."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def split_items(
    df: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    limit: int = 1800,
    overlap: int = 200,
    whole: bool = False,
    start_col: str | None = None,
    kind_col: str | None = None,
    weigh: Callable[[str], Sequence[int]] | None = None,
) -> DataFrame:
    """One row per piece: ``id_col``, ``piece_no``, ``piece_start``, ``piece_end``, ``abs_start``, ``abs_end``, with ``kind_col`` also that.

    ``limit`` and ``overlap`` count code points, or with ``weigh`` the sizes it gives each code point (``byte_sizes``: tokens of
    a byte tokenizer). Items within the limit come out only with ``whole``. ``abs_*`` add the item's own ``start_col`` and are
    null without one; the item's kind, in lower case, is that of all its pieces. Null ids are kept, null texts give no row, rows given twice count once, other columns are ignored. Rows are
    independent of one another: no shuffle but that of the small result, which removes rows given twice.
    """
    base = F.col(start_col).cast("bigint") if start_col else F.lit(None).cast("bigint")
    label = F.lower(F.col(kind_col)) if kind_col else F.lit(None).cast("string")
    items = df.select(F.col(id_col).alias("_id"), base.alias("_base"), label.alias("_kind"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    kind = df.schema[id_col].dataType.simpleString()
    large = items.filter(F.length("_text") > limit) if weigh is None else items

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, no, starts, ends = [], [], [], []
            for i, text in enumerate(b.column("_text").to_pylist()):
                spans = split_spans(text, limit, overlap, offsets=None if weigh is None else token_offsets(text, weigh))
                if weigh is not None and len(spans) == 1 and not whole:
                    continue
                for k, (s, e) in enumerate(spans):
                    rows.append(i)
                    no.append(k)
                    starts.append(s)
                    ends.append(e)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in ("_id", "_base", "_kind")), pa.array(no, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["_id", "_base", "_kind", "piece_no", "piece_start", "piece_end"],
            )

    out = large.mapInArrow(cut, f"_id {kind}, _base bigint, _kind string, piece_no int, piece_start bigint, piece_end bigint")
    if whole and weigh is None:
        out = out.unionByName(
            items.filter(F.length("_text") <= limit).select(
                "_id", "_base", "_kind", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("piece_start"), F.length("_text").cast("bigint").alias("piece_end")
            )
        )
    return out.select(
        F.col("_id").alias(id_col),
        "piece_no",
        "piece_start",
        "piece_end",
        (F.col("_base") + F.col("piece_start")).alias("abs_start"),
        (F.col("_base") + F.col("piece_end")).alias("abs_end"),
        *([F.col("_kind").alias(kind_col)] if kind_col else []),
    ).distinct()
