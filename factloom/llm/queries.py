"""Driver queries of this subpackage: problem N's queries are named pN_..."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.leak import leak_report, leaked_items, remove_leaks
from factloom.llm.lines import block_runs, clean_pages, repeated_lines
from factloom.llm.names import link_names
from factloom.llm.neighbours import greedy_search, measured_recall, most_similar, neighbour_graph, other_rows, similar_pairs, usable_vectors
from factloom.llm.packing import lower_bound, pack
from factloom.llm.spans import document_groups, document_pairs, document_spans, shared_coverage, shared_windows
from factloom.llm.split import byte_sizes, split_items
from factloom.llm.tokens import byt5_tokens
from factloom.llm.vocabulary import map_values
from factloom.session import materialise, read_table

Query = Callable[[SparkSession, str], DataFrame]

CAPACITY = 4096


DIM = 64


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = [similar_pairs(read_table(spark, d, t), i, "embedding", DIM) for t, i in (("fact_embeddings", "fact_id"), ("entities", "entity_id"))]
    return pairs[0].unionByName(pairs[1]).distinct()


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar others of every vector, whatever their similarity."""
    near = [most_similar(read_table(spark, d, t), i, "embedding", DIM, graph_k=14) for t, i in (("fact_embeddings", "fact_id"), ("entities", "entity_id"))]
    return near[0].unionByName(near[1]).select("id", "other", F.round("s", 6).alias("similarity"))


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether p1_nearest's lists hold at least nine of ten true neighbours, measured against all rows of either table."""
    out = []
    for t, i in (("fact_embeddings", "fact_id"), ("entities", "entity_id")):
        rows = read_table(spark, d, t)
        near = materialise(most_similar(rows, i, "embedding", DIM, graph_k=14), "nearest")
        out.append(measured_recall(rows, near, i, "embedding", DIM).select(F.lit(t).alias("source"), "n_asked", (F.col("recall") >= 0.9).alias("reached")))
    return out[0].unionByName(out[1])


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    """Greedy search on the graph for one fact in a hundred (by its id's checksum) against all others: its five nearest rows."""
    held = usable_vectors(read_table(spark, d, "fact_embeddings"), "fact_id", "embedding", DIM)
    edges, vectors = neighbour_graph(held, DIM, k=14)
    asked = held.filter(F.crc32("id") % 100 == 0).select("id", "node").distinct()
    found = greedy_search(asked.join(vectors, "node").select(F.col("id").alias("qid"), "vec"), edges, vectors, DIM, k=6)
    return other_rows(found, held, k=5).select("id", "other", F.round("s", 6).alias("similarity"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    r = repeated_lines(read_table(spark, d, "pages"), read_table(spark, d, "documents"))
    return r.occurrences.select("doc_id", "page_index", "line_no").distinct()


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "pages")
    return clean_pages(pages, repeated_lines(pages, read_table(spark, d, "documents")).occurrences)


def p2_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that lines following one another form: how many of each size a collection has, and how often they stand in runs."""
    r = repeated_lines(read_table(spark, d, "pages"), read_table(spark, d, "documents"))
    sizes = r.nodes.groupBy("collection", "block_id").agg(F.count("*").alias("n_lines"))
    runs = block_runs(r.occurrences).groupBy("collection", "block_id").agg(F.count("*").alias("n_runs"))
    return sizes.join(runs, ["collection", "block_id"]).groupBy("collection", "n_lines").agg(F.count("*").alias("n_blocks"), F.sum("n_runs").alias("n_runs"))


def p3_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of more than 1,800 tokens of the byte tokenizer, cut by tokens, with their kind and place in the document."""
    pieces = split_items(read_table(spark, d, "chunks"), start_col="char_start", kind_col="kind", weigh=byte_sizes)
    return pieces.select("chunk_id", "kind", "piece_no", "piece_start", "piece_end", "abs_start", "abs_end")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_items(read_table(spark, d, "chunks")).select("chunk_id", "piece_start", "piece_end").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    facts = read_table(spark, d, "facts").filter("entity_id is null").select("fact_id", "subject_raw")
    linked = link_names(facts, "subject_raw", read_table(spark, d, "entities"))
    return facts.join(linked, "subject_raw").select("fact_id", "entity_id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    facts = read_table(spark, d, "facts").filter("predicate_canonical is null").select("fact_id", "predicate")
    mapped = map_values(facts, "predicate", read_table(spark, d, "predicate_registry"), "predicate_canonical")
    return facts.join(mapped.select(F.col("predicate").alias("p"), "predicate_canonical"), F.col("predicate").eqNullSafe(F.col("p"))).select("fact_id", "predicate_canonical").distinct()


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", byt5_tokens(F.col("text")).alias("n_tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the packing put into more than one container."""
    placed = pack(_sized(spark, d), "doc_id", "n_tokens", CAPACITY)
    return placed.groupBy("doc_id").agg(F.count_distinct("container_id").alias("n")).filter("n > 1").select("doc_id")


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sized(spark, d), "doc_id", "n_tokens", CAPACITY)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """The packing held against what it must keep: every token placed once, no container over its capacity, few containers.

    ``within_bound``: at most 2% more containers than any plan needs.
    """
    placed = materialise(p7_pack(spark, d), "placed").withColumn("n", F.col("unit_end") - F.col("unit_start"))
    boxes = placed.groupBy("container_id").agg(F.sum("n").alias("load")).agg(F.count("*").alias("boxes"), F.count_if(F.col("load") > CAPACITY).alias("n_over"))
    pieces = placed.agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_pieces"), F.sum("n").alias("n_tokens"))
    bound = lower_bound({r.n: r.c for r in placed.groupBy("n").agg(F.count("*").alias("c")).collect()}, CAPACITY)  # at most CAPACITY rows
    return pieces.join(boxes).select("n_documents", "n_pieces", "n_tokens", "n_over", (F.col("boxes") <= 1.02 * bound).alias("within_bound"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    spans = leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return leak_report(spans).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return remove_leaks(docs, leaked_items(docs, read_table(spark, d, "eval_items")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return document_pairs(shared_windows(read_table(spark, d, "documents")))


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return shared_coverage(document_spans(shared_windows(docs), docs), documents=docs)


def p9_groups(spark: SparkSession, d: str) -> DataFrame:
    """Classes of equal texts and the number of groups each document shares stretches in, linear in the documents."""
    docs = read_table(spark, d, "documents")
    return document_groups(shared_windows(docs), docs)


def queries() -> dict[str, Query]:
    named = (p1_found, p1_nearest, p1_recall, p1_search, p2_found, p2_blocks, p2_clean, p3_found, p3_tokens, p4_found, p5_found, p7_found, p7_pack, p7_fill, p8_found, p8_clean, p9_found, p9_coverage, p9_groups)
    return {f.__name__: f for f in named}
