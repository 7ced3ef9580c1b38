"""Held-out evaluation passages inside training documents.

A generalised suffix automaton over the words of all items is sent to the executors; every document's words are streamed
through it once, tracking the longest match that ends at each word. The automaton lies in flat arrays, about 140 bytes
a word on each worker; its size is checked, and items beyond the bound go through further automata, one pass each, of which
the driver builds and sends one at a time.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most words one automaton may hold.
WORDS_PER_AUTOMATON = 400_000

_DROP = regex.compile(r"[^\p{L}\p{Nd}\s]+")
_ASCII_DROP = re.compile(r"[^a-z0-9\s]+")
_WORD = regex.compile(r"\S+")


def words_of(text: str | None) -> list[str]:
    """Lower-case, delete what is neither letter, digit nor white space, split at white space."""
    if not text:
        return []
    low = text.lower()
    return (_ASCII_DROP.sub("", low) if low.isascii() else _DROP.sub("", low)).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Offsets in ``text`` of the words that ``words_of`` gives, in order."""
    spans = []
    for m in _WORD.finditer(text):
        spans += [m.span()] * len(words_of(m.group()))
    return spans


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, in flat arrays: most states go on by one word, the others keep the rest in ``more``.

    After ``close``, ``sets[held[v]]`` are the items that hold the phrases of state v; equal sets are one object, so items that
    share a long text cost no more than their words.
    """

    def __init__(self):
        self.vocab: dict[str, int] = {}
        self.word, self.to, self.link, self.length = (array("i", [x]) for x in (-1, -1, -1, 0))
        self.more: dict[int, dict[int, int]] = {}
        self.names: list = []
        self.ends = array("i"), array("i")  # state, item's number: a prefix of the item ends there

    def step(self, v: int, w: int) -> int:
        """The state that ``w`` leads to from ``v``, or -1."""
        if self.word[v] == w:
            return self.to[v]
        return self.more[v].get(w, -1) if v in self.more else -1

    def _set(self, v: int, w: int, to: int) -> None:
        if self.word[v] in (-1, w):
            self.word[v], self.to[v] = w, to
        else:
            self.more.setdefault(v, {})[w] = to

    def _state(self, length: int, link: int) -> int:
        for a, x in ((self.word, -1), (self.to, -1), (self.link, link), (self.length, length)):
            a.append(x)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        while p >= 0 and self.step(p, w) == q:
            self._set(p, w, clone)
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, item, words: list[str]) -> None:
        last, number = 0, len(self.names)
        self.names.append(item)
        for word in words:
            w = self.vocab.setdefault(word, len(self.vocab))
            p, q = last, self.step(last, w)
            if q >= 0:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            else:
                last = self._state(self.length[p] + 1, 0)
                while p >= 0 and (q := self.step(p, w)) < 0:
                    self._set(p, w, last)
                    p = self.link[p]
                if p >= 0:
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            self.ends[0].append(last)
            self.ends[1].append(number)

    def close(self, min_words: int) -> None:
        """Pass items down to the suffixes of their phrases, as far as these have ``min_words`` words."""
        known: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.held = array("i", bytes(4 * len(self.link)))
        joined: dict[tuple[int, int], int] = {}

        def number(s: frozenset) -> int:
            if s not in known:
                known[s] = len(self.sets)
                self.sets.append(s)
            return known[s]

        def join(a: int, b: int) -> int:
            if a == b or not b:
                return a
            if (a, b) not in joined:
                joined[a, b] = number(self.sets[a] | self.sets[b])
            return joined[a, b]

        state, item = (np.frombuffer(x, np.int32) for x in self.ends)
        order = np.lexsort((item, state))
        state, item = state[order].tolist(), item[order].tolist()
        at = 0
        for v, same in itertools.groupby(state):
            n = sum(1 for _ in same)
            self.held[v] = number(frozenset(self.names[i] for i in set(item[at : at + n])))
            at += n
        self.ends = array("i"), array("i")
        by_length = np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist()
        for v in reversed(by_length):
            if self.length[self.link[v]] >= min_words:
                self.held[self.link[v]] = join(self.held[self.link[v]], self.held[v])
        # the shortest phrase of at least min_words words that ends where v's do: the most items
        self.top = array("i", range(len(self.link)))
        for v in by_length:
            if self.length[self.link[v]] >= min_words:
                self.top[v] = self.top[self.link[v]]

    def items(self, v: int) -> frozenset:
        return self.sets[self.held[v]]

    def matches(self, ids: np.ndarray, min_words: int) -> dict:
        """Item -> its matching spans [first word, end word); ids are -1 outside the vocabulary.

        A span grows word by word; where the match's start moves on, a new span begins.
        """
        known = np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        out: dict = {}
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s < min_words:
                continue
            v = n = 0
            for i, w in enumerate(ids[s:e].tolist(), int(s)):
                while (to := self.step(v, w)) < 0 and v:
                    v = self.link[v]
                    n = self.length[v]
                if to >= 0:
                    v = to
                    n += 1
                else:
                    n = 0
                if n < min_words:
                    continue
                u = self.link[v]
                at = v if n > self.length[u] else u
                for item in self.items(self.top[at]):
                    span = (i + 1 - self._longest(at, n, item), i + 1)
                    spans = out.setdefault(item, [])
                    if spans and spans[-1] == (span[0], i):
                        spans[-1] = span
                    else:
                        spans.append(span)
        return out

    def _longest(self, v: int, n: int, item) -> int:
        """Words of the longest match of ``item`` that ends here: the longest suffix whose state still has the item."""
        while item not in self.items(v):
            v = self.link[v]
            n = self.length[v]
        return n


def build_automata(items: Iterable[tuple], min_words: int, words_per_automaton: int = WORDS_PER_AUTOMATON) -> Iterator[SuffixAutomaton]:
    """One automaton after the other, each of at most ``words_per_automaton`` words (or one longer item)."""
    a, held = SuffixAutomaton(), 0
    for item, text in items:
        words = words_of(text)
        if len(words) < min_words:
            continue
        if held and held + len(words) > words_per_automaton:
            a.close(min_words)
            yield a
            a, held = SuffixAutomaton(), 0
        a.add(item, words)
        held += len(words)
    if held:
        a.close(min_words)
        yield a


def leaked_items(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = 15
) -> DataFrame:
    """One row per document, item and maximal matching span: ``id_col, item_col, first_word, end_word, char_start, char_end``.

    A span is at least ``min_words`` consecutive words of the item that are consecutive words of the document. Null and
    short texts match nothing, items given twice count once, no items give an empty result. Documents are streamed, never
    shuffled; of the items only the automata are sent.
    """
    spark = documents.sparkSession
    rows = items.select(item_col, item_text).filter(f"{item_text} is not null").distinct().toLocalIterator()
    out_schema = f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, `{item_col}` {items.schema[item_col].dataType.simpleString()}, first_word int, end_word int, char_start bigint, char_end bigint"
    id_type, item_type = (pa.int64() if t == "bigint" else pa.string() for t in (documents.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()))
    schema = pa.schema([(id_col, id_type), (item_col, item_type), ("first_word", pa.int32()), ("end_word", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64())])
    result = None
    for automaton in build_automata(((r[0], r[1]) for r in rows), min_words, WORDS_PER_AUTOMATON):
        sent = spark.sparkContext.broadcast(automaton)

        def stream(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            a = sent.value
            get = a.vocab.get
            for b in batches:
                cols: list[list] = [[] for _ in range(6)]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = np.array([get(w, -1) for w in words_of(text)], np.int32)
                    found = a.matches(ids, min_words) if len(ids) >= min_words else {}
                    if not found:
                        continue
                    where = word_spans(text)
                    for item, spans in found.items():
                        for s, e in spans:
                            for c, x in zip(cols, (doc, item, s, e, where[s][0], where[e - 1][1])):
                                c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        one = documents.select(id_col, text_col).filter(f"{text_col} is not null").mapInArrow(stream, out_schema)
        result = one if result is None else result.unionByName(one)
    return result.distinct() if result is not None else spark.createDataFrame([], out_schema)


def leak_report(spans: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Per document and item: the longest match in words and the spans found."""
    return spans.groupBy(id_col, item_col).agg(F.max(F.col("end_word") - F.col("first_word")).alias("longest_words"), F.count("*").alias("n_spans"))


def remove_leaks(documents: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 15, max_share: float = 0.5) -> DataFrame:
    """Documents without the leaked spans of at least ``min_words`` words: ``id_col, text, dropped``.

    A document of whose characters more than ``max_share`` leaked is ``dropped``: its text comes out null. Only the spans
    of affected documents are grouped, at most a document's own.
    """
    cut = spans.filter(F.col("end_word") - F.col("first_word") >= min_words).groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("char_start", "char_end"))).alias("cut"))
    merged = F.aggregate(
        "cut",
        F.array().cast("array<struct<char_start:bigint,char_end:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["char_end"] >= x["char_start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["char_start"].alias("char_start"), F.greatest(F.element_at(acc, -1)["char_end"], x["char_end"]).alias("char_end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    state = F.aggregate(
        "cut",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, x: F.struct(
            F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (x["char_start"] - acc["at"]).cast("int"))).alias("out"), x["char_end"].alias("at")
        ),
    )
    rows = documents.select(id_col, text_col).join(cut.withColumn("cut", merged), id_col, "left")
    leaked = F.aggregate("cut", F.lit(0).cast("bigint"), lambda a, x: a + x["char_end"] - x["char_start"])
    rows = rows.withColumn("_s", F.when(F.col("cut").isNotNull(), state)).withColumn("dropped", F.coalesce(leaked > F.length(text_col) * max_share, F.lit(False)))
    rest = F.expr(f"substring({text_col}, cast(_s.at + 1 as int))")
    return rows.select(
        id_col,
        F.when(F.col("dropped"), F.lit(None).cast("string")).when(F.col("cut").isNull(), F.col(text_col)).otherwise(F.concat("_s.out", rest)).alias("text"),
        "dropped",
    )
