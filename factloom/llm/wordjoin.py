"""Joining records by words that people spell differently, without a cap on how common a word is.

``near_words`` relates the distinct words of both sides. A word of six letters or more that may differ by k edits is cut into
k + 1 segments, of which at least one stands unchanged in any variant, and these are joined with the substrings of the other
word that may hold them (position-shifted); shorter words meet on their one-letter deletions, since segments of two letters
would be hot keys. Abbreviations meet on three letters in order. What meets is verified by banded edit distance.

``candidates`` joins records on those words. A record needs most of its weight explained, so at least one word of the smallest
set that weighs more than the rest may lack has to be found: only that set is looked up. A word that more than HOT entities
hold is no key by itself; it is extended by a second word of the record, by a third where the pair is still common, and so on:
the index of pairs holds only those common words that are asked for. Where nothing is left to extend by, entities that hold
all of it differ only in what else they have, so the shortest of each ``legal`` decide, and two of them are enough to see a tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.similar import abbreviates, banded_distance, edits_allowed
from factloom.session import cores, materialise

#: Entities that may hold a key before it is extended by a further word.
HOT = 64


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 segments of a word of ``n`` letters, as even as can be."""
    base, extra = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - extra)
        out.append((at, size))
        at += size
    return out


def _deletions(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def index_keys(word: str) -> list[str]:
    """Keys under which an index word is found: itself, its deletions, or its length, a segment's number and letters."""
    n, k = len(word), edits_allowed(len(word))
    if k == 0:
        return ["e." + word]
    if k == 1:
        return sorted("d." + v for v in _deletions(word))
    return [f"{n}.{i}.{word[s : s + size]}" for i, (s, size) in enumerate(segments(n, k))]


def probe_keys(word: str) -> list[str]:
    """Keys that hold every index word within its allowed edits of ``word``: substrings at shifted positions."""
    out, m = set(), len(word)
    if m <= 3:
        out.add("e." + word)
    if 3 <= m <= 6:
        out |= {"d." + v for v in _deletions(word)}
    for n in range(max(6, m - 3), m + 4):
        k = edits_allowed(n)
        d = m - n
        if abs(d) > k:
            continue
        for i, (s, size) in enumerate(segments(n, k)):
            for at in range(max(0, s - i, s + d - (k - i)), min(m - size, s + i, s + d + (k - i)) + 1):
                out.add(f"{n}.{i}.{word[at : at + size]}")
    return sorted(out)


def short_keys(word: str) -> list[str]:
    """Keys of what may abbreviate ``word``: its first letter and any two later ones in order."""
    return sorted({f"a.{word[0]}{word[i]}{word[j]}" for i in range(1, len(word)) for j in range(i + 1, len(word))}) if len(word) > 3 else []


def short_probe(word: str) -> list[str]:
    return [f"a.{word[0]}{word[1]}{word[-1]}"] if len(word) > 2 else []


def spread(df: DataFrame) -> DataFrame:
    """Over all cores before Python runs: adaptive coalescing counts bytes, not the work behind them."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, cores(), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def near_words(queries: DataFrame, targets: DataFrame, spellings: dict[str, list[str]] | None = None, name: str = "near") -> DataFrame:
    """Materialised ``q, word``: each ``queries.q`` with every ``targets.word`` it may be a spelling of.

    ``spellings`` gives further accepted forms of some words (nicknames, irregular abbreviations). A true ``single`` on both
    sides marks what is one word, which may be abbreviated, and not several joined. Both sides are made distinct first, so
    the work grows with the two vocabularies, not with the rows that use them.
    """
    spellings = spellings or {}

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (w, v, k)
                for w, single in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for v in (w, *spellings.get(w, ()))
                for k in index_keys(v) + (short_keys(w) if single and v == w else [])
            ]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["word", "via", "key"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(q, k) for q, single in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k in probe_keys(q) + (short_probe(q) if single else [])]
            cols = list(zip(*rows)) if rows else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["q", "key"])

    held = targets.groupBy("word").agg(F.max("single").alias("single")).mapInArrow(forms, "word string, via string, key string")
    probes = spread(queries.groupBy("q").agg(F.max("single").alias("single"))).mapInArrow(probe, "q string, key string")
    met = probes.join(held.hint("shuffle_hash"), "key").select("q", "word", "via").distinct()
    edits = F.when(F.length("via") <= 3, 0).when(F.length("via") <= 5, 1).when(F.length("via") <= 9, 2).otherwise(3)
    beside = lambda a, b: F.expr(f"length(translate({a}, {b}, ''))")  # noqa: E731  letters that only one side has: each takes an edit
    met = met.filter((beside("q", "via") <= edits) & (beside("via", "q") <= edits) | (F.col("via") == F.col("word")) & (beside("q", "word") == 0))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for q, w, v in zip(*(b.column(i).to_pylist() for i in range(3))):
                k = edits_allowed(len(v)) if v == w else min(1, edits_allowed(len(v)))
                keep.append(banded_distance(q, v, k) <= k or v == w and abbreviates(q, w))
            yield b.filter(pa.array(keep, pa.bool_()))

    found = spread(met).mapInArrow(verify, "q string, word string, via string")
    return materialise(found.select("q", "word").distinct(), name)


TOKENS = "array<struct<at:int,end:int,q:string,u:double,hi:double,near:array<struct<w:string,df:bigint>>>>"


def needed(tokens: list[dict], loss: float) -> list[dict]:
    """The fewest rare tokens of which at least one must be explained, if at most ``loss`` of the weight may stay unexplained.

    ``u`` is what a token weighs where it is unexplained, ``hi`` at most where it is explained. Only tokens with near words
    can be looked up; tokens that join others are alternatives to these and always looked up. A record whose words without
    any near word weigh too much already can't be explained and needs no look-up.
    """
    single = [t for t in tokens if t["end"] - t["at"] == 1]
    wide = [t for t in tokens if t["end"] - t["at"] > 1 and t["near"]]
    lost = [t for t in single if not t["hi"] and not any(x["at"] <= t["at"] < x["end"] for x in wide)]
    order = sorted((t for t in single if t["near"]), key=lambda t: (min(n["df"] for n in t["near"]) > HOT, -t["u"], min(n["df"] for n in t["near"]), t["at"]))
    taken, inside, rest = [], sum(t["u"] for t in lost), sum(t["hi"] for t in single)
    for t in order:
        if inside > loss * (inside + max(rest, 0.0)) + 1e-9:
            break
        taken.append(t)
        inside += t["u"]
        rest -= t["hi"]
    return taken + wide


def _join(parts: list[str]) -> str:
    return " ".join(sorted(parts))


def candidates(queries: DataFrame, forms: DataFrame, loss: float, name: str = "pairs") -> DataFrame:
    """Materialised distinct ``query, eid`` worth scoring.

    ``queries``: ``query, tokens`` (TOKENS); ``forms``: ``eid, fid, words, need, legal``, one row a name, ``need`` its weight.
    Keys are words of a form; ``x*`` stands for any word with the first letter x, for tokens too short to be looked up.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for query, tokens in zip(b.column("query").to_pylist(), b.column("tokens").to_pylist()):
                for t in needed(tokens, loss):
                    rows += [(query, n["w"], sum(1 << i for i in range(t["at"], t["end"]))) for n in t["near"]]
            yield _probes(rows)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for query, tokens, key, used in zip(*(b.column(c).to_pylist() for c in ("query", "tokens", "key", "used"))):
                have = key.split(" ")
                used = int(used, 16)
                for t in tokens:
                    mask = sum(1 << i for i in range(t["at"], t["end"]))
                    if used & mask:
                        continue
                    for w in [n["w"] for n in t["near"]] if len(t["q"]) > 2 or t["near"] else [t["q"][0] + "*"]:
                        if w not in have:
                            rows.add((query, _join([*have, w]), used | mask))
                    if len(t["q"]) <= 2 and t["near"]:
                        rows.add((query, _join([*have, t["q"][0] + "*"]), used | mask))
            yield _probes(sorted(rows))

    schema = "query string, key string, used string"
    forms = forms.select("eid", "fid", "words", "need", "legal")
    postings = forms.select("eid", "fid", F.explode(F.array_distinct("words")).alias("key"))
    probes = materialise(spread(queries).mapInArrow(first, schema).distinct(), f"{name}-probes")
    out, level = [], 1
    while True:
        asked = postings.join(probes.select("key").distinct(), "key", "left_semi")
        sizes = materialise(asked.groupBy("key").agg(F.count_distinct("eid").alias("df")), f"{name}-sizes-{level}")
        cold = asked.join(sizes.filter(F.col("df") <= HOT), "key").select("key", "eid").distinct()
        out.append(materialise(probes.select("query", "key").distinct().join(cold, "key").select("query", "eid").distinct(), f"{name}-{level}"))
        hot = probes.join(sizes.filter(F.col("df") > HOT).select("key"), "key", "left_semi")
        if sizes.filter(F.col("df") > HOT).isEmpty():
            break
        keys = sizes.filter(F.col("df") > HOT).select("key")
        held = materialise(postings.join(keys, "key", "left_semi").join(forms, ["eid", "fid"]), f"{name}-hot-{level}")
        # the lightest entities of each legal form: of several names of an entity the lightest
        per = held.groupBy("key", "legal", "eid").agg(F.min("need").alias("need"))
        light = per.withColumn("_r", F.row_number().over(Window.partitionBy("key", "legal").orderBy("need", "eid"))).filter("_r <= 2").select("key", "eid")
        out.append(materialise(hot.select("query", "key").distinct().join(light, "key").select("query", "eid").distinct(), f"{name}-light-{level}"))
        have = F.split("key", " ")
        rest = F.filter(F.array_distinct("words"), lambda w: ~F.array_contains(have, w))
        more = F.array_distinct(F.concat(rest, F.transform(rest, lambda w: F.concat(F.substring(w, 1, 1), F.lit("*")))))
        grown = held.select("eid", "fid", F.explode(more).alias("x"), have.alias("have")).filter(~F.array_contains("have", F.col("x")))
        postings = grown.select("eid", "fid", F.array_join(F.array_sort(F.concat("have", F.array("x"))), " ").alias("key")).distinct()
        probes = materialise(spread(hot).join(queries, "query").select("query", "tokens", "key", "used").mapInArrow(further, schema).distinct(), f"{name}-probes-{level}")
        if probes.isEmpty():
            break
        level += 1
    both = out[0]
    for one in out[1:]:
        both = both.unionByName(one)
    return both.distinct()


def _probes(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array([f"{x:x}" for x in cols[2]], pa.string())], names=["query", "key", "used"])
