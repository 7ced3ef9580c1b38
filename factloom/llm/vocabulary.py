"""Mapping freely typed values to a canonical list of any length.

Aho-Corasick automata over the canonical names (and aliases) find embedded mentions, the longest not overlapping first; a
mention settles a value if only filler words are left around it. The rest goes to token-set similarity, in which words may
be misspelt, abbreviated or in another order.

The list is a table, never read to the driver. Its names are sharded by their rarest word, and a value is streamed only
through the shards of words it holds, its hits of all shards meeting before the longest are chosen. Candidates for similarity
come from ``wordjoin``: a value meets the entries that share its rare words, however these are spelt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.similar import IRREGULAR, align, fold
from factloom.llm.wordjoin import candidates, near_words, spread
from factloom.session import materialise

UNMATCHED = "unmatched"
#: Entries in one automaton, and values streamed through one task's copy of it.
ENTRIES, VALUES = 20_000, 5_000

#: Words that carry no meaning in a name of a measure, and what reports remark on a figure.
FILLERS = frozenset("the a an of for in at on to from and per by as with".split())
REMARKS = "stated restated reported revised audited unaudited provisional estimated".split()
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\*+")
_REMARK = re.compile(r"[-,;\s]*\b(?:as\s+)?(?:" + "|".join(REMARKS) + r")(?![a-z])", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")


def readings(value: str, remarks: bool = True) -> list[list[str]]:
    """The words of a value; a second reading breaks words at capitals, where the first has them joined.

    Brackets and, with ``remarks``, remarks on the figure are dropped if anything is left.
    """
    bare = value
    for pattern in (_BRACKETS, _REMARK) if remarks else (_BRACKETS,):
        less = pattern.sub(" ", bare)
        bare = less if re.search(r"\w", less) else bare
    out = [_SPLIT.split(fold(bare)), _SPLIT.split(fold(_CAMEL.sub(" ", bare)))]
    words = [[w for w in r if w] for r in out]
    return words[:1] if words[0] == words[1] else words


def content(words: list[str]) -> list[str]:
    return [w for w in words if w not in FILLERS] or words


def chosen(text: str, hits: list[tuple[int, int, str]]) -> str | None:
    """The name that the longest hits (start, end, name) which do not overlap agree on, if only fillers stand around them."""
    taken: list[tuple[int, int, str]] = []
    for h in sorted(hits, key=lambda h: (h[0] - h[1], h[0], h[2])):
        if all(h[1] - 1 <= t[0] or h[0] >= t[1] - 1 for t in taken):  # the space between two names belongs to both
            taken.append(h)
    if len({h[2] for h in taken}) != 1:
        return None
    rest = text
    for h in sorted(taken, key=lambda h: -h[0]):
        rest = rest[: h[0]] + " " + rest[h[1] :]
    return taken[0][2] if all(w in FILLERS for w in rest.split()) else None


def _mentions(entries: DataFrame, read: DataFrame, entries_per_shard: int) -> DataFrame:
    """``vid, name``: values that a name of the list settles. ``entries``: ``name, text, words``; ``read``: ``vid, r, words``."""
    phrases = entries.groupBy("text").agg(F.min("name").alias("name"), F.first("words").alias("words"))
    each = phrases.select("text", F.explode(F.array_distinct("words")).alias("w"))
    rare = each.join(each.groupBy("w").agg(F.count("*").alias("n")), "w").groupBy("text").agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    phrases = materialise(phrases.select("text", "name").join(rare, "text"), "phrases")
    shards = max(1, -(-phrases.count() // entries_per_shard))
    shard = F.pmod(F.xxhash64("w"), F.lit(shards)).cast("int")
    words = read.select("vid", "r", F.explode(F.array_distinct("words")).alias("w"))
    routes = words.join(phrases.select("w").distinct(), "w", "left_semi").select(shard.alias("shard"), "vid", "r").distinct()
    routes = materialise(routes, "routes")
    salts = routes.groupBy("shard").agg(F.ceil(F.count("*") / VALUES).cast("int").alias("n_salts"))
    none = F.lit(None)
    docs = routes.join(salts, "shard").join(read, ["vid", "r"]).select(
        "shard", F.pmod(F.xxhash64("vid"), "n_salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "vid", "r", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("body"), none.cast("string").alias("name")
    )
    held = phrases.withColumn("shard", shard).join(salts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"), F.lit(0).alias("kind"), none.cast("bigint").alias("vid"), none.cast("int").alias("r"), F.col("text").alias("body"), "name"
    )
    stream = held.unionByName(docs).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        at, auto, fresh = None, ahocorasick.Automaton(), False
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for s, salt, kind, vid, r, body, name in zip(*(b.column(c).to_pylist() for c in ("shard", "salt", "kind", "vid", "r", "body", "name"))):
                if (s, salt) != at:
                    at, auto, fresh = (s, salt), ahocorasick.Automaton(), True
                if kind == 0:
                    auto.add_word(body, (len(body), name))
                    continue
                if fresh:
                    auto.make_automaton()
                    fresh = False
                for end, (size, found) in auto.iter(body):
                    for o, x in zip(out, (vid, r, end + 1 - size, end + 1, found, body)):
                        o.append(x)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=["vid", "r", "s", "e", "name", "body"])

    hits = stream.mapInArrow(locate, "vid bigint, r int, s int, e int, name string, body string")
    per = hits.groupBy("vid", "r").agg(F.first("body").alias("body"), F.collect_set(F.struct("s", "e", "name")).alias("hits"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [chosen(body, [(h["s"], h["e"], h["name"]) for h in hs]) for body, hs in zip(b.column("body").to_pylist(), b.column("hits").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("r"), pa.array(names, pa.string())], names=["vid", "r", "name"])

    settled = spread(per).mapInArrow(choose, "vid bigint, r int, name string").filter("name is not null")
    return materialise(settled.groupBy("vid").agg(F.min_by("name", "r").alias("name")), "mentions")


def map_values(
    values: DataFrame,
    value_col: str,
    registry: DataFrame,
    name_col: str,
    alias_col: str | None = None,
    threshold: float = 0.7,
    margin: float = 0.02,
    entries_per_shard: int | None = None,
) -> DataFrame:
    """Each distinct value with its entry: ``value_col, name_col, how, score``; ``unmatched`` where none fits.

    Null and blank values come out unmatched, as does everything if the list is empty; equal scores of two entries within
    ``margin`` are no match, and of two entries with one phrase the smaller name has it. Distinct values are found first, so
    a value that a third of all rows hold is looked up once. How the list is sharded changes nothing in the result.
    A value and an entry are compared if they share a word within its edits or as an abbreviation of three letters or more.
    """
    rows = registry.select(F.col(name_col).alias("name"), (F.col(alias_col) if alias_col else F.array().cast("array<string>")).alias("al")).filter("name is not null")
    rows = rows.select("name", F.explode(F.concat(F.array("name"), F.coalesce("al", F.array().cast("array<string>")))).alias("phrase")).filter("phrase is not null").distinct()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [readings(p, remarks=False)[-1] for p in b.column("phrase").to_pylist()]
            cols = [pa.array([f" {' '.join(w)} " for w in words], pa.string()), pa.array(words, pa.list_(pa.string())), pa.array([content(w) for w in words], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("name"), *cols], names=["name", "text", "words", "content"])

    entries = rows.mapInArrow(parse, "name string, text string, words array<string>, content array<string>").filter(F.size("words") > 0)
    entries = materialise(entries.distinct(), "entries")
    distinct = materialise(values.select(F.col(value_col).cast("string").alias("_v")).distinct().withColumn("vid", F.monotonically_increasing_id()), "values")

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(vid, r, w, content(w)) for vid, v in zip(b.column("vid").to_pylist(), b.column("_v").to_pylist()) for r, w in enumerate(readings(v)) if w]
            cols = list(zip(*out)) if out else [[], [], [], []]
            types = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["vid", "r", "words", "content"])

    read = spread(distinct.filter("_v is not null")).mapInArrow(take_apart, "vid bigint, r int, words array<string>, content array<string>")
    read = materialise(read, "readings")
    settled = _mentions(entries.select("name", "text", "words"), read.select("vid", "r", "words"), entries_per_shard or ENTRIES)

    open_ = read.join(settled.select("vid"), "vid", "left_anti").select(F.concat_ws(".", "vid", "r").alias("query"), "content")
    open_ = materialise(open_, "open-values")
    forms = entries.select("name", "content").distinct()
    counts = materialise(forms.select("name", F.explode("content").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("df")), "word-counts")
    spellings: dict[str, list[str]] = {}
    for short, full in IRREGULAR.items():
        spellings.setdefault(full, []).append(short)
    parts = open_.select("query", F.posexplode("content").alias("at", "q"))
    one = F.lit(True).alias("single")
    near = near_words(parts.select("q", one), counts.select("word", one), spellings, "near-values")
    by_q = near.join(counts, "word").groupBy("q").agg(F.collect_list(F.struct(F.col("word").alias("w"), "df")).alias("near"))
    hi = F.when((F.length("q") <= 2) | F.col("near").isNotNull(), 1.0).otherwise(0.0)
    token = F.struct("at", (F.col("at") + 1).alias("end"), "q", F.lit(1.0).alias("u"), hi.alias("hi"), F.coalesce("near", F.array().cast("array<struct<w:string,df:bigint>>")).alias("near"))
    tokens = materialise(parts.join(by_q, "q", "left").groupBy("query").agg(F.collect_list(token).alias("tokens")), "value-tokens")
    low = threshold - margin  # rivals within the margin have to be found as well
    shape = forms.select(F.col("name").alias("eid"), F.xxhash64("content").alias("fid"), F.col("content").alias("words"), F.size("content").cast("double").alias("need"), F.lit(None).cast("string").alias("legal"))
    pairs = materialise(candidates(tokens, shape, (2 - 2 * low) / (2 - low), "value-pairs"), "candidates")
    text = lambda c: F.array_join(c, " ")
    full = pairs.join(shape.select("eid", text("words").alias("form")), "eid").join(open_.select("query", text("content").alias("value")), "query").select("query", "eid", "form", "value")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for form, value in zip(b.column("form").to_pylist(), b.column("value").to_pylist()):
                q, t = value.split(" "), form.split(" ")
                scores.append(2 * sum(s for s, _, _ in align(q, t)) / (len(q) + len(t)))
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("eid"), pa.array(scores, pa.float64())], names=["query", "name", "score"])

    judged = spread(full).mapInArrow(judge, "query string, name string, score double").select(F.split("query", r"\.")[0].cast("bigint").alias("vid"), "name", "score")
    ranked = judged.groupBy("vid", "name").agg(F.max("score").alias("score"))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("score"), "name"))).filter("_r <= 2")
    best = ranked.groupBy("vid").agg(F.max("score").alias("score"), F.max_by("name", -F.col("_r")).alias("name"), F.min(F.when(F.col("_r") == 2, F.col("score"))).alias("next"))
    ok = (F.col("score") >= threshold) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= margin)
    near_ = best.select("vid", F.when(ok, F.col("name")).alias("s_name"), "score")
    out = distinct.join(settled.withColumnRenamed("name", "m_name"), "vid", "left").join(near_, "vid", "left")
    how = F.when(F.col("m_name").isNotNull(), "mention").when(F.col("s_name").isNotNull(), "similarity").otherwise("none")
    score = F.when(F.col("m_name").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return out.select(F.col("_v").alias(value_col), F.coalesce("m_name", "s_name", F.lit(UNMATCHED)).alias(name_col), how.alias("how"), score.alias("score"))
