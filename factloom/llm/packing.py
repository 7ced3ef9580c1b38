"""Filling fixed-capacity containers with whole items.

The plan is made on the histogram of sizes, which has at most ``capacity`` rows however many items there are: for each
size, the gap to the capacity is looked up among single, pair and triple sums of the sizes still available, and exact
fits are consumed as often as the counts allow; what is left is filled best-fit, again by whole counts. The plan is then
handed out to the items by their rank within their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import materialise

#: A pattern: (containers of this kind, {size: items of that size in each container}).
Pattern = tuple[int, dict[int, int]]


def _times(need: dict[int, int], have: np.ndarray) -> int:
    return min(int(have[s]) // k for s, k in need.items())


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that no plan can do without: for each size t, what is over capacity - t stands alone, and the rest from t on fills up."""
    sizes = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        sizes[size] += n
    items, units = np.cumsum(sizes), np.cumsum(sizes * np.arange(capacity + 1))
    best = -(-int(units[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):
        over, half = capacity - t, capacity // 2
        alone, large = int(items[-1] - items[over]), int(items[over] - items[half])
        middle = int(units[half] - units[t - 1])  # from t to half the capacity, beside what the large ones leave
        room = large * capacity - int(units[over] - units[half])
        best = max(best, alone + large + max(0, -(-(middle - room) // capacity)))
    return best


def plan_patterns(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Containers by kind for ``counts`` items of each size (1..capacity). Every item is placed exactly once.

    Exact fits of two, three and four items use up small items that would fill gaps later, so plans that look for exact fits
    up to each of these depths are compared, and the one of the fewest containers is taken.
    """
    return min((_plan(counts, capacity, depth) for depth in (3, 2, 1, 0)), key=lambda plan: sum(n for n, _ in plan))


def _plan(counts: dict[int, int], capacity: int, depth: int) -> list[Pattern]:
    have = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if not 1 <= size <= capacity:
            raise ValueError(f"size {size} is not within 1..{capacity}")
        have[size] += n
    out: list[Pattern] = []

    def consume(parts: list[int]) -> int:
        need: dict[int, int] = {}
        for p in parts:
            need[p] = need.get(p, 0) + 1
        n = _times(need, have)
        if n:
            for s, k in need.items():
                have[s] -= n * k
            out.append((n, need))
        return n

    consume([capacity]) if have[capacity] else None
    for k in range(1, depth + 1):  # complements of one, two, three items
        for a in range(capacity - 1, -(-capacity // (k + 1)) - 1, -1):  # the largest item of an exact fit is at least the mean
            if k == 3 and have[a]:
                thirds = _thirds(have, capacity - a)
            while have[a]:
                gap = capacity - a
                found = None
                if k == 1:
                    found = [gap] if have[gap] >= (2 if gap == a else 1) else None
                elif k == 2:
                    found = _pair(have, gap, [a])
                else:
                    while thirds and not found:  # counts only fall: a third without a fit has none later
                        if rest := _pair(have, gap - thirds[0], [a, thirds[0]]):
                            found = [thirds[0], *rest]
                        else:
                            thirds.pop(0)
                if not found or not consume([a, *found]):
                    break
    while have.any():  # best fit: the largest items first, each gap by the largest that fits
        gap, need = capacity, {}
        top = int(np.flatnonzero(have)[-1])
        s = top
        while s > 0 and gap > 0:
            s = min(s, gap)
            if not have[s]:
                below = np.flatnonzero(have[: s + 1])
                if not len(below):
                    break
                s = int(below[-1])
            need[s] = min(int(have[s]), gap // s)
            gap -= need[s] * s
            s -= 1
        n = _times(need, have)
        for s, k in need.items():
            have[s] -= n * k
        out.append((n, need))
    return out


def _thirds(have: np.ndarray, gap: int) -> list[int]:
    """The available sizes, largest first, that some two available sizes, counts aside, fill up to ``gap``."""
    size = 2 * len(have)
    f = np.fft.rfft((have > 0).astype(float), size)
    pairs = np.fft.irfft(f * f, size) > 0.5
    c = np.flatnonzero(have[: gap // 3 + 1])
    return c[pairs[gap - c]][::-1].tolist()


def _pair(have: np.ndarray, gap: int, beside: list[int]) -> list[int] | None:
    """Two available sizes that add up to ``gap``, the larger as large as can be, next to the items of ``beside``."""
    if gap < 2:
        return None
    left = have.copy()
    np.subtract.at(left, beside, 1)
    low = np.arange(1, gap // 2 + 1)
    ok = np.flatnonzero((left[low] > 0) & (left[gap - low] > 0) & ((2 * low != gap) | (left[low] > 1)))
    return [int(low[ok[0]]), int(gap - low[ok[0]])] if len(ok) else None


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Assign items to containers: ``id_col, piece_no, n_pieces, unit_start, unit_end, container_id``.

    An item larger than ``capacity`` is divided into full pieces and a remainder, and no other is. Null or negative sizes
    count as 0; items of size 0 take a container's place of size 1. An id given twice counts once, with its largest size;
    null ids are one item. Ranks are counted within (size, hash bucket), so that a size held by a third of all items is
    spread over many tasks; only the histogram (at most ``capacity`` rows) comes to the driver.
    """
    spark = df.sparkSession
    sizes = df.select(F.col(id_col).alias("_id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(1)).cast("bigint").alias("_n")).groupBy("_id").agg(F.max("_n").alias("_n"))
    cap = F.lit(capacity).cast("bigint")
    full = F.floor((F.col("_n") - 1) / cap)  # pieces before the last
    parts = sizes.select("_id", "_n", full.alias("_full"), F.explode(F.sequence(F.lit(0).cast("bigint"), full)).alias("piece_no"))
    start = F.col("piece_no") * cap
    pieces = parts.select(
        "_id", "piece_no", (F.col("_full") + 1).alias("n_pieces"), start.alias("unit_start"), F.least(start + cap, F.col("_n")).alias("unit_end")
    ).withColumn("_len", (F.col("unit_end") - F.col("unit_start")).cast("int"))
    pieces = materialise(pieces, "pieces")
    buckets = max(1, -(-pieces.count() // rows_per_bucket))
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64("_id", "piece_no"), F.lit(buckets)).cast("int"))
    per = pieces.groupBy("_len", "_b").agg(F.count("*").alias("_c"))
    hist = {r._len: r.n for r in per.groupBy("_len").agg(F.sum("_c").alias("n")).collect()}
    slots, base = [], 0
    taken: dict[int, int] = {}
    for n, need in plan_patterns(hist, capacity):
        for s, k in need.items():
            slots.append((s, taken.get(s, 0), n, base))
            taken[s] = taken.get(s, 0) + n * k
        base += n
    slots.sort()
    key = np.array([(s << 44) + r for s, r, _, _ in slots], np.int64)
    first, many, at = (np.array([x[i] for x in slots], np.int64) for i in (1, 2, 3))

    by = Window.partitionBy("_len").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = per.withColumn("_off", F.coalesce(F.sum("_c").over(by), F.lit(0)))
    ranked = pieces.withColumn("_r", F.row_number().over(Window.partitionBy("_len", "_b").orderBy("_id", "piece_no")))
    ranked = ranked.join(offset.select("_len", "_b", "_off"), ["_len", "_b"]).withColumn("_rank", F.col("_r") - 1 + F.col("_off"))
    kind = df.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("_len").to_numpy(zero_copy_only=False).astype(np.int64), b.column("_rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, (size << 44) + rank, "right") - 1
            box = at[i] + (rank - first[i]) % many[i] if len(key) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("_id", "piece_no", "n_pieces", "unit_start", "unit_end")] + [pa.array(box)], names=["_id", "piece_no", "n_pieces", "unit_start", "unit_end", "container_id"])

    out = ranked.select("_id", "piece_no", "n_pieces", "unit_start", "unit_end", "_len", "_rank").mapInArrow(
        place, f"_id {kind}, piece_no bigint, n_pieces bigint, unit_start bigint, unit_end bigint, container_id bigint"
    )
    return out.withColumnRenamed("_id", id_col)
