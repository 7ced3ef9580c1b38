"""Reading the fact store: searches with optional filters, point lookups, views and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.funnel import latest_facts

PAGE_SIZE, MOST_ROWS = 50, 500


def page_size(limit: int | None) -> int:
    return max(1, min(limit or PAGE_SIZE, MOST_ROWS))


def _evidence(evidence: DataFrame) -> DataFrame:
    return evidence.select(
        "evidence_id", "quote", "page_index", "page_label", "verified", "match_score", "match_method",
        F.col("char_start").alias("evidence_char_start"), F.col("char_end").alias("evidence_char_end"),
    )


def fact_view(facts: DataFrame, documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """The latest row of each fact with its document's and its evidence's columns; facts without evidence keep nulls."""
    d = documents.select("doc_id", "filename", "collection", F.col("title").alias("document_title"), "as_of_date", "published_date")
    return latest_facts(facts).join(d, "doc_id").join(_evidence(evidence), "evidence_id", "left")


def active_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    return latest_facts(facts).join(_evidence(evidence).filter("verified"), "evidence_id")


def quarantine(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts whose evidence was not verified; those with unknown verdict are neither active nor here."""
    return latest_facts(facts).join(_evidence(evidence).filter("not verified"), "evidence_id")


def _like(column: Column | str, needle: str) -> Column:
    """Case-insensitive LIKE; wildcards in the needle stay alive."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.coalesce(c, F.lit(""))).like(f"%{needle.lower()}%")


def fact_filter(
    view: DataFrame, doc_id=None, collection: str | None = None, entity_id: str | None = None, predicate: str | None = None, period: str | None = None, q: str | None = None, verified: bool | None = True
) -> DataFrame:
    """The facts that meet all filters given."""
    for column, value in (("doc_id", doc_id), ("collection", collection), ("entity_id", entity_id), ("predicate_canonical", predicate), ("verified", verified)):
        if value is not None:
            view = view.filter(F.col(column) == value)
    if period:
        view = view.filter(_like("period_label_raw", period))
    if q:
        view = view.filter(_like("subject_raw", q) | _like("predicate_canonical", q) | _like("value_raw", q) | _like("quote", q))
    return view


def search_facts(view: DataFrame, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    """One page of the filtered facts, the most confident first."""
    return fact_filter(view, **filters).orderBy(F.desc_nulls_last("confidence"), "fact_id").offset(offset).limit(page_size(limit))


def link_view(links: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Links with both sides' document and collection."""
    d = documents.select("doc_id", "collection")
    side = lambda s: latest_facts(facts).select("fact_id", "doc_id").join(d, "doc_id").select(F.col("fact_id").alias(f"fact_{s}"), F.col("doc_id").alias(f"doc_{s}"), F.col("collection").alias(f"collection_{s}"))
    return links.join(side("a"), "fact_a").join(side("b"), "fact_b")


def search_links(view: DataFrame, relation: str | None = None, collection: str | None = None, doc_id=None, min_confidence: float = 0.0, step: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of links; the collection is that of side a, a document may stand on either side."""
    v = view.filter(F.col("confidence") >= min_confidence)
    if relation is not None:
        v = v.filter(F.col("relation") == relation)
    if collection is not None:
        v = v.filter(F.col("collection_a") == collection)
    if doc_id is not None:
        v = v.filter((F.col("doc_a") == doc_id) | (F.col("doc_b") == doc_id))
    if step is not None:
        v = v.filter(F.col("step") == step)
    return v.orderBy(F.desc("confidence"), "link_id").offset(offset).limit(page_size(limit))


def links_for_fact(links: DataFrame, fact_id: str) -> DataFrame:
    return links.filter((F.col("fact_a") == fact_id) | (F.col("fact_b") == fact_id)).orderBy(F.desc("confidence"), "link_id")


def fact_detail(links: DataFrame, view: DataFrame, ids: DataFrame) -> DataFrame:
    """The links of the facts asked for (``fact_id``), each with its counterpart's row as a struct; a link of two of them comes twice.

    A counterpart that is gone is null.
    """
    asked = ids.select("fact_id").distinct()
    sides = links.withColumns({"fact_id": F.col("fact_a"), "other": F.col("fact_b")}).unionByName(links.withColumns({"fact_id": F.col("fact_b"), "other": F.col("fact_a")}))
    other = view.select(F.col("fact_id").alias("other"), F.struct(*view.columns).alias("counterpart")).dropDuplicates(["other"])
    return sides.join(asked, "fact_id", "left_semi").join(other, "other", "left")


def facts_by_ids(view: DataFrame, ids: DataFrame) -> DataFrame:
    """A semi join with a table of ids instead of a list of them."""
    return view.join(ids.select("fact_id").distinct(), "fact_id", "left_semi")


def quarantined_facts(facts: DataFrame, evidence: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    return quarantine(facts, evidence).orderBy(F.desc_nulls_last("match_score"), "fact_id").offset(offset).limit(limit)


def get_row(df: DataFrame, key: str, value, drop: tuple[str, ...] = ()) -> DataFrame:
    """Point lookup; pushed down to the scan."""
    return df.filter(F.col(key) == value).drop(*drop).limit(1)


def list_documents(documents: DataFrame, chunks: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Documents with their numbers of chunks, facts and verified facts: three counts, grouped before they are joined."""
    n_chunks = chunks.groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    checked = latest_facts(facts).select("doc_id", "evidence_id").join(evidence.select("evidence_id", "verified"), "evidence_id", "left")
    n_facts = checked.groupBy("doc_id").agg(F.count("*").alias("n_facts"), F.count_if("verified").alias("n_verified"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.select("doc_id", "collection", "filename", "status", "n_pages").join(n_chunks, "doc_id", "left").join(n_facts, "doc_id", "left").select(
        "doc_id", "collection", "filename", "status", "n_pages", zero("n_chunks"), zero("n_facts"), zero("n_verified")
    )


def failure_mode(quote: Column | str) -> Column:
    """What a quote that was not found looks like."""
    q = F.col(quote) if isinstance(quote, str) else quote
    return F.when(q.contains("\n"), "multi_line_stitch").when(q.contains("|"), "table_row").when(F.length(q) < 40, "very_short_quote").otherwise("other")


# Selected cases -------------------------------------------------------------------------------------------------------


def corroborated_cases(view: DataFrame, facts: DataFrame, limit: int = 3) -> DataFrame:
    """Links between documents that state one value in different words: other scales first, then other units."""
    f = latest_facts(facts).select("fact_id", "value_raw", "magnitude_label", "unit_canonical")
    a, b = (f.select(F.col("fact_id").alias(f"fact_{s}"), F.struct("value_raw", "magnitude_label", "unit_canonical").alias(s)) for s in "ab")
    v = view.filter("relation = 'corroborates' and doc_a <> doc_b").join(a, "fact_a").join(b, "fact_b").filter("a.value_raw <> b.value_raw")
    same = lambda c: F.when(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), 1).otherwise(0)
    return v.orderBy(same("magnitude_label"), same("unit_canonical"), F.desc("confidence"), "relative_delta", "link_id").limit(limit)


def reconciled_cases(view: DataFrame, limit: int = 3) -> DataFrame:
    """Explained gaps, the widest first."""
    return view.filter(F.col("relation").startswith("reconciled") | (F.col("relation") == "refines")).filter("relative_delta > 0").orderBy(F.desc("relative_delta"), "link_id").limit(limit)


def contradiction_cases(undecided: DataFrame, limit: int = 3) -> DataFrame:
    """Pairs no rule explains, the widest gap first: what a judge has to look at."""
    return undecided.filter("relative_delta is not null").orderBy(F.desc("relative_delta"), "link_id").limit(limit)


def interesting(links: DataFrame) -> DataFrame:
    return links.filter(F.col("relation").isin("contradicts", "refines"))


def reconciled(links: DataFrame) -> DataFrame:
    return links.filter(F.col("relation").startswith("reconciled_by_"))
