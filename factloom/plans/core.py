"""Driver queries of the core: each wires project tables to an operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import number, period, subject, text
from factloom.operators import chunking, entities, funnel, rules, runs, search, stats, store, verify
from factloom.operators import facts as facts_
from factloom.operators.quantities import agreeing_pairs, common_quantities
from factloom.plans import literals
from factloom.session import materialise, read_table, shared_dir
from factloom.sources.landing import export_json
from factloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return _ALL | literals.queries()


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, d, n) for n in names]


# Quantities ------------------------------------------------------------------------------------------------------------


@query
def p6_quantities(spark: SparkSession, d: str) -> DataFrame:
    return common_quantities(read_table(spark, d, "facts").filter("value_type = 'numeric'")).distinct()


@query
def p6_common(spark: SparkSession, d: str) -> DataFrame:
    """Every numeric fact's dimension and quantity in its common unit."""
    q = common_quantities(read_table(spark, d, "facts").filter("value_type = 'numeric'"))
    return q.select("fact_id", "dimension", F.round("quantity", 3).alias("quantity")).distinct()


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    facts = read_table(spark, d, "facts").withColumn("measure", F.col("qualifiers")["measure"]).filter("measure is not null")
    quantities = materialise(common_quantities(facts, ("fact_id", "measure")).select("fact_id", "measure", "quantity").distinct(), "quantities")  # parsed once, read by both sides
    return agreeing_pairs(quantities, "fact_id", "measure", "quantity").toDF("fact_a", "fact_b")


# Pairs of facts --------------------------------------------------------------------------------------------------------

#: The cosine from which pairs are candidates here: the test vectors of one block are seldom more alike.
LEAST_COSINE = 0.2


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    return funnel.scoped_facts(*_t(spark, d, "facts", "evidence", "documents", "fact_embeddings"))


@query
def count_blocked_pairs(spark: SparkSession, d: str) -> DataFrame:
    return funnel.count_blocked_pairs(_scoped(spark, d))


@query
def funnel_candidates(spark: SparkSession, d: str) -> DataFrame:
    return funnel.generate_candidates(_scoped(spark, d), threshold=LEAST_COSINE).withColumn("similarity", F.round("similarity", 6))


@query
def incremental_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Only pairs that touch a document of the newest parser version."""
    new = read_table(spark, d, "documents").filter("parser_version = 'parse-2'").select("doc_id")
    return funnel.generate_candidates(_scoped(spark, d), threshold=LEAST_COSINE, new_docs=new).withColumn("similarity", F.round("similarity", 6))


@query
def unlinked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one predicate count as linked already."""
    s = _scoped(spark, d)
    p = s.select("fact_id", "predicate_canonical")
    linked = funnel.generate_candidates(s, threshold=LEAST_COSINE).join(p.toDF("fact_a", "pa"), "fact_a").join(p.toDF("fact_b", "pb"), "fact_b").filter("pa = pb")
    rest = funnel.generate_candidates(s, threshold=LEAST_COSINE, existing=linked.select("fact_a", "fact_b"))
    return rest.withColumn("similarity", F.round("similarity", 6))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    facts, documents = _t(spark, d, "facts", "documents")
    pairs = materialise(funnel.generate_candidates(_scoped(spark, d), threshold=LEAST_COSINE), "candidates")
    return rules.evaluate_pairs(rules.pair_facts(pairs, funnel.latest_facts(facts), documents))


@query
def evaluate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("fact_a", "fact_b", "relation", "confidence", "step", F.round("relative_delta", 6).alias("relative_delta"), F.to_json("trace").alias("trace"))


@query
def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_decided(spark, d), "relation", "step")


@query
def link_search(spark: SparkSession, d: str) -> DataFrame:
    links, _ = rules.storable_links(_decided(spark, d))
    facts, documents = _t(spark, d, "facts", "documents")
    return search.search_links(search.link_view(links, facts, documents), min_confidence=0.8, limit=200).select("link_id", "fact_a", "fact_b", "relation", "confidence")


@query
def link_cases(spark: SparkSession, d: str) -> DataFrame:
    """The selected cases of all kinds under one roof."""
    facts, documents = _t(spark, d, "facts", "documents")
    links, open_ = rules.storable_links(materialise(_decided(spark, d), "decided"))
    view = search.link_view(links, facts, documents)
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "link_id", "fact_a", "fact_b")
    return (
        pick(search.corroborated_cases(view, facts), "corroborated").unionByName(pick(search.reconciled_cases(view), "reconciled")).unionByName(pick(search.contradiction_cases(open_), "open"))
    )


@query
def residue_budget(spark: SparkSession, d: str) -> DataFrame:
    s = _scoped(spark, d).select(F.col("fact_id").alias("fact_a"), "doc_id")
    return funnel.residue_budget(funnel.generate_candidates(_scoped(spark, d), threshold=LEAST_COSINE).join(s, "fact_a"), 2).select("fact_a", "fact_b", "doc_id", "deferred")


@query
def period_relation(spark: SparkSession, d: str) -> DataFrame:
    """How the periods of an entity's facts on one predicate lie to one another, counted."""
    f = funnel.latest_facts(read_table(spark, d, "facts")).filter("entity_id is not null and predicate_canonical is not null and period_start is not null")
    keys = ["entity_id", "predicate_canonical"]
    spans = f.select(*keys, "period_start", "period_end").distinct()
    a, b = spans.alias("a"), spans.toDF(*keys, "s2", "e2").alias("b")
    pair = a.join(b, keys).filter("period_start < s2 or period_start = s2 and period_end < e2")
    days = (F.col("period_start"), F.col("period_end"), F.col("s2"), F.col("e2"))
    kind = F.when(period.periods_equal(*days), "equal").when(period.period_contains(*days) | period.period_contains(*days[2:], *days[:2]), "nested").when(period.periods_overlap(*days), "overlapping").otherwise("disjoint")
    return pair.groupBy(kind.alias("relation")).agg(F.count("*").alias("n"))


# Searches --------------------------------------------------------------------------------------------------------------


def _view(spark: SparkSession, d: str) -> DataFrame:
    return search.fact_view(*_t(spark, d, "facts", "documents", "evidence"))


@query
def search_facts(spark: SparkSession, d: str) -> DataFrame:
    return search.search_facts(_view(spark, d), limit=100, offset=20, q="freight", period="fy").select("fact_id", "doc_id", "subject_raw", "value_raw", "confidence")


@query
def search_facts_count(spark: SparkSession, d: str) -> DataFrame:
    return search.fact_filter(_view(spark, d), q="freight", period="fy").agg(F.count("*").alias("n"))


@query
def active_facts(spark: SparkSession, d: str) -> DataFrame:
    return search.active_facts(*_t(spark, d, "facts", "evidence")).select("fact_id", "evidence_id", "match_score", "evidence_char_start")


@query
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    return search.quarantine(*_t(spark, d, "facts", "evidence")).select("fact_id", "evidence_id", "match_method")


@query
def quarantined_facts(spark: SparkSession, d: str) -> DataFrame:
    return search.quarantined_facts(*_t(spark, d, "facts", "evidence")).select("fact_id", "match_score")


@query
def facts_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """The facts that the registry gives as examples."""
    ids = read_table(spark, d, "predicate_registry").select(F.col("example_fact_id").alias("fact_id"))
    return search.facts_by_ids(_view(spark, d), ids).select("fact_id", "predicate_canonical", "document_title", "as_of_date")


@query
def get_document(spark: SparkSession, d: str) -> DataFrame:
    return search.get_row(read_table(spark, d, "documents"), "doc_id", 1002, ("text",)).select("doc_id", "filename", "collection", "n_pages")


@query
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return search.list_documents(*_t(spark, d, "documents", "chunks", "facts", "evidence"))


@query
def failure_modes(spark: SparkSession, d: str) -> DataFrame:
    q = search.quarantine(*_t(spark, d, "facts", "evidence"))
    return q.groupBy(search.failure_mode("quote").alias("mode")).agg(F.count("*").alias("n"))


# Totals ----------------------------------------------------------------------------------------------------------------


@query
def stats_totals(spark: SparkSession, d: str) -> DataFrame:
    names = ("documents", "pages", "chunks", "facts", "evidence", "entities", "predicate_registry")
    return stats.totals(**dict(zip(names, _t(spark, d, *names))))


@query
def verification_rate(spark: SparkSession, d: str) -> DataFrame:
    return stats.verification(*_t(spark, d, "facts", "evidence"))


@query
def daily_growth(spark: SparkSession, d: str) -> DataFrame:
    return stats.daily_growth(read_table(spark, d, "facts"))


@query
def stage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return stats.stage_rollup(read_table(spark, d, "events"), "event_type", "value", "props")


@query
def collections(spark: SparkSession, d: str) -> DataFrame:
    return stats.collections(read_table(spark, d, "documents"))


@query
def collection_rollup(spark: SparkSession, d: str) -> DataFrame:
    return stats.collection_rollup(list_documents(spark, d))


@query
def register_facts(spark: SparkSession, d: str) -> DataFrame:
    return stats.register_facts(read_table(spark, d, "facts"))


@query
def recount_predicates(spark: SparkSession, d: str) -> DataFrame:
    return stats.recount_predicates(*_t(spark, d, "predicate_registry", "facts")).select("predicate_canonical", "n_facts")


@query
def bump_predicates(spark: SparkSession, d: str) -> DataFrame:
    inc = read_table(spark, d, "facts").filter("predicate is not null").select(text.canonical_predicate("predicate").alias("predicate_canonical"), F.lit(1).alias("k"))
    return stats.bump_predicates(read_table(spark, d, "predicate_registry"), inc).select("predicate_canonical", "n_facts")


@query
def top_predicates(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_predicates(read_table(spark, d, "predicate_registry"), 40).select("predicate_canonical", "n_facts")


@query
def vocabulary_hint(spark: SparkSession, d: str) -> DataFrame:
    return stats.vocabulary_hint(read_table(spark, d, "predicate_registry"), 40)


# Facts and their counterparts ---------------------------------------------------------------------------------------------


def _links(spark: SparkSession, d: str) -> DataFrame:
    """One link a predicate, between its first and last fact, standing in for the links table."""
    rows = funnel.latest_facts(read_table(spark, d, "facts")).filter("predicate_canonical is not null")
    per = rows.groupBy("predicate_canonical").agg(F.min("fact_id").alias("fact_a"), F.max("fact_id").alias("fact_b"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return per.filter("fact_a <> fact_b").withColumnRenamed("predicate_canonical", "link_id")


@query
def fact_detail(spark: SparkSession, d: str) -> DataFrame:
    """The links of the registry's example facts and of every link's first fact, with their counterparts."""
    links = _links(spark, d)
    ids = read_table(spark, d, "predicate_registry").select(F.col("example_fact_id").alias("fact_id")).unionByName(links.select(F.col("fact_a").alias("fact_id")))
    return search.fact_detail(links, _view(spark, d), ids).select("link_id", "fact_id", "other", F.col("counterpart.value_raw").alias("value_raw"), F.col("counterpart.document_title").alias("title"))


@query
def links_for_fact(spark: SparkSession, d: str) -> DataFrame:
    """The links of the fact that comes first of all links' facts."""
    links = _links(spark, d)
    first = links.agg(F.min("fact_a").alias("fact_id"))
    return search.fact_detail(links, _view(spark, d), first).select("link_id", "fact_a", "fact_b", "confidence")


@query
def built_fact_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of facts and of their evidence, made anew from what the facts say."""
    f, ev = _t(spark, d, "facts", "evidence")
    raw = f.join(ev.select("evidence_id", F.col("quote").alias("evidence_quote")), "evidence_id").select(
        "doc_id", "chunk_id", F.col("subject_raw").alias("subject"), "predicate", "value_raw", "period_label_raw", "scope_tags", "evidence_quote"
    )
    return facts_.with_ids(raw).select("fact_id", "evidence_id").distinct()


@query
def facts_kept(spark: SparkSession, d: str) -> DataFrame:
    """Facts of each chunk within the most that one may have."""
    rows = funnel.latest_facts(read_table(spark, d, "facts")).filter("chunk_id is not null")
    return facts_.first_of_chunk(rows, "fact_id", 2).select("chunk_id", "fact_id")


@query
def dates_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """The date that a document's title, file name or date of issue begins with."""
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", text.tolerant_date(F.coalesce(F.col("as_of_date").cast("string"), "title", "filename")).alias("day"))


# Writes ----------------------------------------------------------------------------------------------------------------


@query
def upsert_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts with the newest extractor's rows in place of older rows of the same fact."""
    facts = read_table(spark, d, "facts").select("fact_id", "value_raw", "confidence", "created_at", "extractor_version")
    new = facts.filter("extractor_version = 'extract-3'")
    return store.upsert(store.last_wins(facts, ["fact_id"], [F.desc("created_at"), F.desc("confidence")]), new, ["fact_id"], [F.desc("created_at"), F.desc("confidence")])


@query
def replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with several pages get their long chunks back alone."""
    chunks, documents = _t(spark, d, "chunks", "documents")
    rows = chunks.select("chunk_id", "doc_id", "text").distinct()
    docs = documents.filter("n_pages > 1").select("doc_id")
    new = rows.join(docs, "doc_id", "left_semi").filter(F.length("text") > 500)
    return store.replace_by_document(rows, new, docs).select("chunk_id", "doc_id")


@query
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each table when the documents of one type go."""
    docs, facts, evidence, vectors = _t(spark, d, "documents", "facts", "evidence", "fact_embeddings")
    links = funnel.latest_facts(facts).groupBy("predicate_canonical").agg(F.min("fact_id").alias("fact_a"), F.max("fact_id").alias("fact_b"))
    left = store.delete_document_facts(docs.filter("doc_type = 'survey'"), facts, evidence, vectors, links)
    return stats.totals(**left)


@query
def update_documents(spark: SparkSession, d: str) -> DataFrame:
    """Titles filled from the first line of the text where none is known."""
    docs = read_table(spark, d, "documents").select("doc_id", "title", "status", "text")
    new = docs.filter("title is null").select("doc_id", F.substring(F.element_at(F.split("text", "\n"), 1), 1, 60).alias("title"))
    return store.set_values(docs.drop("text"), "doc_id", new)


@query
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Facts' canonical strings that have no vector yet."""
    facts, vectors = _t(spark, d, "facts", "fact_embeddings")
    wanted = facts.select(text.canonical_string("subject_canonical", "predicate_canonical", "period_label_raw", "scope_tags").alias("canonical_string"))
    return store.cache_lookup(wanted, vectors.select("canonical_string").distinct(), "canonical_string")[1]


@query
def document_exists(spark: SparkSession, d: str) -> DataFrame:
    """Which of the facts' documents, and of some ids that nothing has, the documents hold."""
    asked = read_table(spark, d, "facts").select("doc_id").unionByName(spark.range(5).select((-F.col("id")).alias("doc_id")))
    return store.exists(read_table(spark, d, "documents"), asked, "doc_id")


@query
def cache_put(spark: SparkSession, d: str) -> DataFrame:
    """The vector cache after the facts' strings were put in, keyed by the text's hash; the texts that had a vector keep one row."""
    facts, vectors = _t(spark, d, "facts", "fact_embeddings")
    cache = vectors.filter("canonical_string is not null").select(text.text_hash("canonical_string").alias("text_hash"), F.lit("old").alias("model")).distinct()
    new = facts.select(text.text_hash(text.canonical_string("subject_canonical", "predicate_canonical", "period_label_raw", "scope_tags")).alias("text_hash"), F.lit("new").alias("model"))
    return store.cache_put(cache, new, "text_hash").groupBy("model").agg(F.count("*").alias("n"), F.min("text_hash").alias("least"))


@query
def export_documents(spark: SparkSession, d: str) -> DataFrame:
    return export_json(read_table(spark, d, "documents").select("doc_id", "filename", "collection", "n_pages", "text"), ("text",))


# Streams ---------------------------------------------------------------------------------------------------------------


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type, read as a stream of files."""
    where = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    batch = read_table(spark, d, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream takes no single file
    counts = ingest.run_to_end(ingest.windowed_counts(stream, "ts", "event_type", "1 day"), f"{where}/out", f"{where}/state")
    return counts.select(F.to_date("window.start").alias("day"), "event_type", "n")


# Runs, with the events table standing in for the stages' rows -------------------------------------------------------------


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    late = F.pmod("event_id", F.lit(7)) == 0
    return e.select(
        F.col("event_id").cast("string").alias("run_id"), (F.col("user_id") + 1000).cast("bigint").alias("doc_id"), F.col("event_type").alias("stage"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"),
        F.pmod("event_id", F.lit(5)).cast("int").alias("n_items"), F.pmod("event_id", F.lit(3)).cast("int").alias("n_calls"), F.floor("value").cast("int").alias("tokens_in"), F.lit(1).alias("tokens_out"),
        F.when(late, F.lit('[{"kind": "late", "detail": "x"}]')).otherwise(F.lit("[]")).alias("errors"), F.replace("props", F.lit('"k"'), F.lit('"cache_hits"')).alias("notes"),
    )


@query
def document_status(spark: SparkSession, d: str) -> DataFrame:
    docs, f, ev = _t(spark, d, "documents", "facts", "evidence")
    return runs.document_status(docs, _runs(spark, d), f, ev)


@query
def document_runs(spark: SparkSession, d: str) -> DataFrame:
    """One document's runs, with what their JSON holds."""
    rows = runs.document_runs(_runs(spark, d), 1005)
    return rows.select("run_id", "stage", "n_items", F.size("errors").alias("n_errors"), F.try_element_at("notes", F.lit("cache_hits")).cast("bigint").alias("hits"))


@query
def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.recent_runs(_runs(spark, d), read_table(spark, d, "documents")).select("run_id", "stage", "n_calls", "filename")


@query
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_totals(_runs(spark, d))


@query
def decoded_notes(spark: SparkSession, d: str) -> DataFrame:
    """The number that an event's JSON notes, -1 where there is none."""
    got = text.decode_json("props", "k bigint", F.struct(F.lit(-1).cast("bigint").alias("k")))["k"]
    return read_table(spark, d, "events").groupBy(F.coalesce(got, F.lit(-1)).alias("k")).agg(F.count("*").alias("n"))


# Text ------------------------------------------------------------------------------------------------------------------


@query
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_offsets(read_table(spark, d, "pages"))


@query
def resolve_pages(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "evidence").filter("char_start is not null").select("evidence_id", "doc_id", "char_start")
    pages = read_table(spark, d, "pages").withColumn("char_end", F.col("char_start") + F.length("text"))
    return chunking.resolve_pages(ev, pages).select("evidence_id", "page_index")


@query
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_pages(read_table(spark, d, "pages"))


@query
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunks").select("chunk_id", "doc_id", text.chunk_id("doc_id", "text").alias("made")).distinct()


@query
def boilerplate_chunks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunks").select("chunk_id", chunking.boilerplate_reason("text", F.lower("kind")).alias("reason")).distinct()


@query
def slide_decks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.looks_like_slides(read_table(spark, d, "pages").select("doc_id", "page_index", "text").distinct())


@query
def sparse_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sparse_pages(read_table(spark, d, "pages"), 300)


@query
def canonical_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "pages").select("doc_id", "page_index", *[c.alias(n) for n, c in zip(("body", "source"), text.canonical_text("text", "text_plain"))]).distinct()
    return pages.select("doc_id", "page_index", F.length("body").alias("n"), "source")


@query
def verify_exact(spark: SparkSession, d: str) -> DataFrame:
    ev, docs = _t(spark, d, "evidence", "documents")
    return verify.exact_quotes(ev, docs, "doc_id")


@query
def verify_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Every quote against its chunk's text, by all four attempts."""
    ev, facts, chunks = _t(spark, d, "evidence", "facts", "chunks")
    owner = facts.select("fact_id", "chunk_id").dropDuplicates(["fact_id"])
    return verify.verify_quotes(ev.join(owner, "fact_id"), chunks, "chunk_id")


# Values ----------------------------------------------------------------------------------------------------------------


@query
def canonical_subjects(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "facts").select("subject_raw", subject.canonical_subject("subject_raw").alias("canonical")).distinct()


@query
def canonical_predicates(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "facts").select("predicate", text.canonical_predicate("predicate").alias("canonical")).distinct()


@query
def parsed_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "facts").filter("value_type = 'numeric'").select("value_raw").distinct()
    n = rows.select("value_raw", number.parse_number("value_raw").alias("n"), number.digit_place("value_raw").alias("place"))
    return n.select("value_raw", "n.value", "n.bound", "n.negative", "place")


@query
def currencies(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "facts").select("value_raw", "unit_raw").distinct().select("value_raw", "unit_raw", number.detect_currency("value_raw", "unit_raw").alias("currency"))


@query
def normalized_values(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "facts").select("value_raw", "unit_raw", "value_type").distinct()
    return rows.select("value_raw", "unit_raw", "value_type", number.normalize_value("value_raw", F.coalesce("unit_raw", F.lit("")), "value_type").alias("v")).select("value_raw", "unit_raw", "value_type", "v.*")


@query
def parsed_periods(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "facts").select("period_label_raw").distinct()
    return rows.select("period_label_raw", period.parse_period("period_label_raw").alias("p")).select("period_label_raw", "p.start", "p.end", "p.basis")


@query
def scope_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = subject.normalize_scope_tags("scope_tags")
    return read_table(spark, d, "facts").select(F.array_join(tags, ",").alias("tags"), "fact_id").distinct().groupBy("tags").agg(F.count("*").alias("n"))


@query
def addresses(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "facts").filter("predicate_canonical = 'registered_address'").select("value_raw").distinct()
    return rows.select("value_raw", subject.normalize_address("value_raw").alias("a")).select("value_raw", "a.normalized", "a.postal_code")


# Entities --------------------------------------------------------------------------------------------------------------


@query
def exact_entities(spark: SparkSession, d: str) -> DataFrame:
    """Subjects whose canonical form is an entity's name or alias."""
    facts, ents = _t(spark, d, "facts", "entities")
    names, aliases = entities.entity_names(ents)
    rows = facts.select(subject.canonical_subject("subject_raw").alias("name")).distinct()
    by_name = rows.join(names.select("name", "entity_id"), "name").withColumn("method", F.lit("exact"))
    by_alias = rows.join(names, "name", "left_anti").join(aliases.select("name", "entity_id"), "name").withColumn("method", F.lit("alias"))
    return by_name.unionByName(by_alias)


@query
def resolve_entities(spark: SparkSession, d: str) -> DataFrame:
    facts, ents = _t(spark, d, "facts", "entities")
    return entities.resolve_subjects(facts.filter("entity_id is null"), ents)


@query
def resolution_methods(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(resolve_entities(spark, d), "method")
