"""Long stretches of text that different documents share word for word.

1. Winnowing picks anchors (hashes of ``gram`` code points) so that every stretch of ``min_chars`` holds at least one, the
   smallest hash of that stretch, in whichever text it stands. Anchors of two or more different texts are the recurring
   passages; only hashes are shuffled for this.
2. The passages' strings are compiled into Aho-Corasick automata, sharded by the text they come from, and every text with
   a recurring anchor is streamed through the shards its passages belong to. A shard's texts are salted over several
   tasks, and read one at a time. Every occurrence is located, and its whole string compared with the passage's.
3. Each window of ``min_chars`` around a located occurrence gives a 128-bit digest of its own text; windows of one digest
   are one stretch. This is exact down to ``min_chars``, and linear in the text.

A text without a recurring anchor shares nothing: two texts that share a stretch have all its windows alike, so the same
anchors are picked in both. Texts that share a window are a group; groups are told apart by combined hashes of their texts, so no group is ever collected, and texts that share many windows with the same others are one row of a group.
Exact copies are one text from the start; they are expanded at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialise, small_or_shuffled

#: Passages in one automaton (of PATTERN code points each), and texts streamed through one task's copy of it.
SHARD_PASSAGES, SHARD_TEXTS, PATTERN = 20_000, 2_000, 40
#: Code points hashed at once.
BLOCK = 1 << 19

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, BLOCK + 1)
        for k, b in enumerate((_B, _BINV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class Hashes:
    """Hashes of all grams of a code point array, by prefix sums of a polynomial mod 2^64."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        pw, self.inv = _powers(self.n + 1)
        x = _mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))
        x *= pw[: self.n]
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(x, out=self.prefix[1:])

    def grams(self, k: int) -> np.ndarray:
        if self.n < k:
            return np.zeros(0, np.uint64)
        g = self.prefix[k:] - self.prefix[: self.n + 1 - k]
        g *= self.inv[: len(g)]
        return _mix(g)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every window of ``width``, by doubling."""
    m, span = x, 1
    while span * 2 <= width:
        m = f(m[:-span], m[span:])
        span *= 2
    n = len(x) - width + 1
    return m[:n] if span == width else f(m[:n], m[width - span : width - span + n])


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    return _slide(h, width, np.minimum) if len(h) >= width else np.zeros(0, np.uint64)


def codes_of(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(texts: list[str], min_chars: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position in it, hash) of the winnowed grams; of equal hashes in a text the first."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    h = Hashes(codes_of(texts)).grams(gram)
    width = min_chars - gram + 1
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = window_minima(h, width)
    room = np.repeat(ends, sizes)[: len(low)] - np.arange(len(low))
    low[room < min_chars] = 0  # windows that cross from one text into the next
    top = _slide(np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    at = np.flatnonzero((top == h) & (top > 0))
    doc = np.searchsorted(ends, at, "right")
    order = np.lexsort((at, h[at], doc))
    at, doc = at[order], doc[order]
    first = np.ones(len(at), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[at][1:] != h[at][:-1])
    at, doc = at[first], doc[first]
    return doc, at - (ends - sizes)[doc], h[at].view(np.int64)


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > BLOCK:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, texts[start:]


@dataclass(frozen=True)
class SharedSpans:
    members: DataFrame  # _id, t1, t2: documents of at least min_chars, and their text's key
    texts: DataFrame  # tid, t1, t2: the texts that share a passage with another one
    windows: DataFrame  # g1, g2, tid, pos, first: windows around an occurrence of a recurring passage, by their digest; first of its text
    sharded: bool  # a text may have been streamed in several shards, and have a first window in each


def shared_windows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 400, gram: int = 256) -> SharedSpans:
    """Stages 1 to 3. Null texts and texts under ``min_chars`` share nothing; ids given twice with one text count once."""
    if not PATTERN <= gram <= min_chars:
        raise ValueError("gram must lie between the pattern length and min_chars")
    text = F.col(text_col)
    base = documents.filter(F.length(text) >= min_chars).select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text")
    )
    members = materialise(base.select("_id", "t1", "t2").distinct(), "members")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, t1, t2 = b.column("text").to_pylist(), b.column("t1"), b.column("t2")
            for start, part in _blocks(texts):
                doc, pos, h = anchors(part, min_chars, gram)
                take = pa.array(doc + start)
                yield pa.RecordBatch.from_arrays([pa.array(h), t1.take(take), t2.take(take), pa.array(pos.astype(np.int32))], names=["h", "t1", "t2", "pos"])

    picked = materialise(base.select("t1", "t2", "text").mapInArrow(pick, "h bigint, t1 bigint, t2 bigint, pos int"), "anchors")
    recurring = materialise(
        picked.groupBy("h").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).filter(F.col("a") != F.col("b")).select("h"), "recurring"
    )
    hits = picked.join(small_or_shuffled(recurring), "h").distinct()
    hits = materialise(hits, "hits")
    keys = materialise(hits.select("t1", "t2").distinct(), "text-keys")
    held = base.join(small_or_shuffled(keys), ["t1", "t2"], "left_semi").select("t1", "t2", "text").dropDuplicates(["t1", "t2"])
    cand = materialise(held.withColumn("tid", F.monotonically_increasing_id()), "texts")

    hits = hits.join(cand.select("t1", "t2", "tid"), ["t1", "t2"]).select("h", "tid", "pos")
    n_passages = recurring.count()
    shards = max(1, -(-n_passages // SHARD_PASSAGES))
    source = hits.groupBy("h").agg(F.min("tid").alias("src"))
    passages = source.withColumn("shard", F.pmod(F.xxhash64("src"), F.lit(shards)).cast("int"))
    routed = materialise(hits.join(passages, "h").withColumn("first", F.col("tid") == F.col("src")), "routed")
    strings = routed.filter("first").join(cand, "tid").select("shard", F.substring("text", F.col("pos") + 1, F.lit(gram)).alias("body"))
    routes = routed.select("tid", "shard").distinct()
    salts = routes.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_TEXTS).cast("int").alias("n_salts"))
    docs = (
        routes.join(salts, "shard")
        .join(cand, "tid")
        .select("shard", F.pmod(F.xxhash64("tid"), "n_salts").cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("tid").alias("key"), F.col("text").alias("body"))
    )
    words = strings.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("key"), "body")
    # as many partitions as units of work, by number: coalescing by bytes would put all of them into one task
    units = shards + -(-routes.count() // SHARD_TEXTS)
    stream = words.unionByName(docs).repartition(max(2, min(units, 100_000)), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    skip = (gram - PATTERN) // 2

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        at, held, auto, fresh = None, {}, None, False
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for shard, salt, kind, key, body in zip(*(b.column(c).to_pylist() for c in ("shard", "salt", "kind", "key", "body"))):
                if (shard, salt) != at:
                    at, held, auto, fresh = (shard, salt), {}, None, True
                if kind == 0:
                    held.setdefault(body[skip : skip + PATTERN], set()).add(body)
                    continue
                if fresh:
                    auto, fresh = ahocorasick.Automaton(), False
                    for p, whole in held.items():
                        auto.add_word(p, whole)
                    auto.make_automaton()
                near = np.zeros(len(body) + 1, np.int32)
                for end, whole in auto.iter(body):
                    i = end + 1 - PATTERN - skip
                    if i >= 0 and body[i : i + gram] in whole:
                        near[max(0, i + gram - min_chars)] += 1
                        near[i + 1] -= 1
                pos = np.flatnonzero(np.cumsum(near[: len(body) - min_chars + 1]) > 0)
                if not len(pos):
                    continue
                data = memoryview(body.encode("utf-32-le", "surrogatepass"))
                g = np.frombuffer(b"".join(blake2b(data[4 * p : 4 * (p + min_chars)], digest_size=16).digest() for p in pos.tolist()), np.int64).reshape(-1, 2)
                first = np.zeros(len(pos), bool)
                first[np.unique(g, axis=0, return_index=True)[1]] = True
                for o, x in zip(out, (g[:, 0], g[:, 1], np.full(len(pos), key, np.int64), pos.astype(np.int32), first)):
                    o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["g1", "g2", "tid", "pos", "first"])

    windows = materialise(stream.mapInArrow(locate, "g1 bigint, g2 bigint, tid bigint, pos int, first boolean"), "windows")
    return SharedSpans(members, cand.select("tid", "t1", "t2"), windows, shards > 1)


def text_groups(shared: SharedSpans) -> DataFrame:
    """Materialised ``n, ga, gb, tid``: the different sets of texts that share a window, each set once, a row a text.

    A set is known by its size and by the exclusive or and the sum of its texts' hashes, pre-aggregated before the shuffle.
    """
    w = shared.windows.filter("first").select("g1", "g2", "tid")
    w = w.distinct() if shared.sharded else w
    part = F.shiftrightunsigned(F.xxhash64("tid", F.lit(7)), 32)
    sets = w.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("tid")).alias("ga"), F.sum(part).alias("gb")).filter("n > 1")
    one = sets.groupBy("n", "ga", "gb").agg(F.min(F.struct("g1", "g2")).alias("g")).select("n", "ga", "gb", "g.g1", "g.g2")
    return materialise(w.join(small_or_shuffled(materialise(one, "text-sets")), ["g1", "g2"]).select("n", "ga", "gb", "tid"), "text-groups")


def text_pairs(shared: SharedSpans) -> DataFrame:
    """Pairs of different texts (``ta < tb``) that share a window, from groups: many windows of the same texts are one."""
    g = text_groups(shared)
    return g.withColumnRenamed("tid", "ta").join(g.withColumnRenamed("tid", "tb"), ["n", "ga", "gb"]).filter("ta < tb").select("ta", "tb").distinct()


def document_groups(shared: SharedSpans, documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``id_col, class_id, n_copies, n_groups``, linear however many documents share a stretch.

    ``class_id`` is the smallest id of the documents with the same text, ``n_copies`` their number, ``n_groups`` the number of
    different sets of texts this one shares a window with. Documents that are too short or null are a class of their own.
    """
    per = text_groups(shared).groupBy("tid").agg(F.count("*").alias("n_groups"))
    classes = shared.members.groupBy("t1", "t2").agg(F.min("_id").alias("class_id"), F.count("*").alias("n_copies"))
    grouped = shared.texts.join(per, "tid").select("t1", "t2", "n_groups")
    rows = shared.members.join(classes.join(grouped, ["t1", "t2"], "left"), ["t1", "t2"]).select(F.col("_id").alias(id_col), "class_id", "n_copies", F.coalesce("n_groups", F.lit(0)).alias("n_groups"))
    every = documents.select(id_col).filter(F.col(id_col).isNotNull()).distinct().join(rows, id_col, "left")
    return every.select(id_col, F.coalesce("class_id", id_col).alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"))


def document_pairs(shared: SharedSpans) -> DataFrame:
    """``doc_a < doc_b``: all pairs of documents whose texts share a stretch, exact copies expanded.

    This is the whole list, which grows with the square of what a group holds; ``document_groups`` has the same links linearly.
    """
    m = shared.members
    owner = m.join(shared.texts, ["t1", "t2"]).select("tid", "_id")
    pairs = materialise(text_pairs(shared), "text-pairs")
    cross = pairs.join(owner.select(F.col("tid").alias("ta"), F.col("_id").alias("a")), "ta").join(owner.select(F.col("tid").alias("tb"), F.col("_id").alias("b")), "tb").select("a", "b")
    copies = m.groupBy("t1", "t2").agg(F.count("*").alias("n")).filter("n > 1").select("t1", "t2")
    again = m.join(copies, ["t1", "t2"])
    same = again.select("t1", "t2", F.col("_id").alias("a")).join(again.select("t1", "t2", F.col("_id").alias("b")), ["t1", "t2"]).filter("a < b").select("a", "b")
    return cross.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).unionByName(same.toDF("doc_a", "doc_b")).filter("doc_a <> doc_b").distinct()


def document_spans(shared: SharedSpans, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 400) -> DataFrame:
    """The maximal shared stretches of each document: ``id_col, span_start, span_end``; a text with exact copies is one."""
    from pyspark.sql import Window

    w = shared.windows
    common = w.groupBy("g1", "g2").agg(F.min("tid").alias("a"), F.max("tid").alias("b")).filter("a <> b").select("g1", "g2")
    starts = w.join(common, ["g1", "g2"], "left_semi").select("tid", "pos").distinct()
    by = Window.partitionBy("tid").orderBy("pos")
    isle = starts.withColumn("new", (F.col("pos") - F.coalesce(F.lag("pos").over(by), F.lit(-(1 << 30))) > min_chars).cast("int")).withColumn("isle", F.sum("new").over(by))
    spans = isle.groupBy("tid", "isle").agg(F.min("pos").cast("bigint").alias("span_start"), (F.max("pos") + min_chars).cast("bigint").alias("span_end"))
    keyed = spans.join(shared.texts, "tid").select("t1", "t2", "span_start", "span_end")
    copies = shared.members.groupBy("t1", "t2").agg(F.count_distinct("_id").alias("n")).filter("n > 1")
    sizes = documents.select(F.col(id_col).alias("_id"), F.length(text_col).cast("bigint").alias("size"))
    partial = shared.members.join(keyed, ["t1", "t2"]).join(copies, ["t1", "t2"], "left_anti").select("_id", "span_start", "span_end")
    whole = shared.members.join(copies, ["t1", "t2"], "left_semi").join(sizes, "_id").select("_id", F.lit(0).cast("bigint").alias("span_start"), F.col("size").alias("span_end"))
    return partial.unionByName(whole).distinct().withColumnRenamed("_id", id_col)


def shared_coverage(spans: DataFrame, id_col: str = "doc_id", documents: DataFrame | None = None) -> DataFrame:
    """How many characters of each document stand elsewhere too: ``id_col, shared_chars, n_spans``.

    With ``documents``, each of their ids has a row, of 0 where nothing is shared.
    """
    parts = spans.select(id_col, (F.col("span_end") - F.col("span_start")).alias("_n"), F.lit(1).alias("_s"))
    if documents is not None:
        parts = parts.unionByName(documents.select(id_col, F.lit(0).cast("bigint").alias("_n"), F.lit(0).alias("_s")))
    return parts.groupBy(id_col).agg(F.sum("_n").alias("shared_chars"), F.sum("_s").alias("n_spans"))
