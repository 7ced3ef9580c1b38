"""Lines a whole collection repeats from document to document.

Nodes are distinct lines (by their letters) weighted by the documents that hold them, edges join lines that follow one
another on a page, weighted likewise. Nodes and edges of high support are kept; the connected components are the
boilerplate blocks, and every occurrence of a block's line is deleted.

Scale: only 128-bit line keys are shuffled, never text. Per collection, kept nodes are at most (mean distinct lines per
document) / ``min_share``, so the component search is a bounded group; support is pre-aggregated before its shuffle, so a
collection with a third of all rows is no hot task.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import materialise, small_or_shuffled

NODE = ["collection", "k1", "k2"]


@dataclass(frozen=True)
class RepeatedLines:
    lines: DataFrame  # doc_id, page_index, collection, line_no, k1, k2: lines long enough to count
    nodes: DataFrame  # collection, k1, k2, n_docs, block_id
    occurrences: DataFrame  # doc_id, page_index, line_no, collection, block_id


def page_lines(pages: DataFrame, documents: DataFrame, min_letters: int) -> DataFrame:
    letters = F.regexp_replace(F.lower("text"), r"[^\p{L}\n]+", "")
    keyed = F.transform(
        F.split(letters, "\n"),
        lambda x, i: F.struct(i.alias("line_no"), F.xxhash64(x).alias("k1"), F.xxhash64(F.lit(7), x).alias("k2"), (F.length(x) >= min_letters).alias("long")),
    )
    rows = pages.select("doc_id", "page_index", F.filter(keyed, lambda s: s["long"]).alias("ls")).filter(F.size("ls") > 0)
    owners = documents.filter(F.col("collection").isNotNull()).select("doc_id", "collection").distinct()
    return rows.join(owners, "doc_id").select("doc_id", "page_index", "collection", F.explode("ls").alias("s")).select(
        "doc_id", "page_index", "collection", "s.line_no", "s.k1", "s.k2"
    ).distinct()


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Union-find over one collection's kept edges; a node without edges is its own block."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a1, a2, b1, b2 in zip(pdf.k1, pdf.k2, pdf.n1, pdf.n2):
        a, b = find((a1, a2)), find((b1, b2))
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = sorted(parent)
    return pd.DataFrame({
        "collection": [pdf.collection.iloc[0]] * len(nodes),
        "k1": [n[0] for n in nodes],
        "k2": [n[1] for n in nodes],
        "block_id": [find(n)[0] for n in nodes],
    })


def repeated_lines(pages: DataFrame, documents: DataFrame, min_letters: int = 20, min_docs: int = 3, min_share: float = 0.05) -> RepeatedLines:
    """Find the repeated lines of every collection.

    Lines are what "\\n" separates; two are the same if their letters (Unicode category L), lower-cased and in order, are.
    Null texts hold no line, documents without a collection (or pages without a document) are left out, rows given twice
    count once, empty tables give empty results. Other columns are ignored.
    """
    lines = materialise(page_lines(pages, documents, min_letters), "lines")
    totals = documents.filter(F.col("collection").isNotNull()).groupBy("collection").agg(F.count_distinct("doc_id").alias("n_all"))
    enough = lambda n: (F.col(n) >= min_docs) & (F.col(n) >= F.col("n_all") * min_share)
    support = lines.select("doc_id", *NODE).distinct().groupBy(NODE).agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    kept = materialise(support.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "collection").filter(enough("n_docs")), "line-nodes")

    near = small_or_shuffled(kept.select(*NODE, "n_all"))
    hits = lines.join(near, NODE)
    after = hits.select("doc_id", "page_index", "collection", (F.col("line_no") - 1).alias("line_no"), F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    edges = (
        hits.join(after, ["doc_id", "page_index", "collection", "line_no"])
        .select("doc_id", *NODE, "n1", "n2", "n_all")
        .distinct()
        .groupBy(*NODE, "n1", "n2", "n_all")
        .agg(F.count("*").alias("n_edge"))
        .filter(enough("n_edge"))
    )
    alone = kept.select(*NODE, F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    kind = documents.schema["collection"].dataType.simpleString()
    blocks = materialise(
        edges.select(*NODE, "n1", "n2").unionByName(alone).groupBy("collection").applyInPandas(_components, f"collection {kind}, k1 bigint, k2 bigint, block_id bigint"),
        "line-blocks",
    )
    found = lines.join(small_or_shuffled(blocks), NODE).select("doc_id", "page_index", "line_no", "collection", "block_id")
    return RepeatedLines(lines, kept.drop("n_all").join(blocks, NODE), found)


def block_runs(found: DataFrame) -> DataFrame:
    """Where blocks stand: ``doc_id, page_index, collection, block_id, first_line, last_line, n_lines``.

    Repeated lines of one block that follow one another are one run; a page's repeated lines are one group, no more.
    """
    page = Window.partitionBy("doc_id", "page_index", "collection").orderBy("line_no")
    starts = (F.lag("line_no").over(page) + 1).eqNullSafe(F.col("line_no")) & F.lag("block_id").over(page).eqNullSafe(F.col("block_id"))
    runs = found.distinct().withColumn("_new", (~starts).cast("int")).withColumn("_run", F.sum("_new").over(page))
    return runs.groupBy("doc_id", "page_index", "collection", "_run", "block_id").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines")).drop("_run")


def clean_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Every page with its repeated lines deleted: ``doc_id, page_index, text, n_removed``; null texts stay null.

    The line numbers to delete are one short array a page; the text is shuffled once.
    """
    cut = found.groupBy("doc_id", "page_index").agg(F.collect_set("line_no").alias("cut"))
    rows = pages.select("doc_id", "page_index", "text").join(cut, ["doc_id", "page_index"], "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("cut", i)), "\n")
    return rows.select(
        "doc_id", "page_index", F.when(F.col("cut").isNull(), F.col("text")).otherwise(left).alias("text"), F.coalesce(F.size("cut"), F.lit(0)).alias("n_removed")
    ).distinct()
