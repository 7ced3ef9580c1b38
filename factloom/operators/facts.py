"""From an extractor's raw output to fact and evidence rows, and from a page's boxes and tables to labels and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.number import normalize_value
from factloom.functions.period import parse_period
from factloom.functions.subject import canonical_subject, normalize_scope_tags
from factloom.functions.text import _c, canonical_predicate, clean_text, digest
from factloom.operators.chunking import resolve_pages, table_is_useful
from factloom.operators.verify import verify_quotes

#: Fixed value: facts kept of one chunk.
MOST_A_CHUNK = 12


def fact_id(doc_id, chunk_id, subject, predicate, value_raw, period_label, scope_tags) -> Column:
    """Digest of what a fact says and where, so that reading a chunk again gives the same id."""
    tags = F.array_join(normalize_scope_tags(scope_tags), ",")
    return digest(_c(doc_id).cast("string"), chunk_id, canonical_subject(subject), canonical_predicate(predicate), F.lower(clean_text(value_raw)), F.lower(clean_text(period_label)), tags, length=32)


def evidence_id(fact: Column | str, quote: Column | str) -> Column:
    return digest(fact, quote, length=32)


def first_of_chunk(raw: DataFrame, order: str, most: int = MOST_A_CHUNK) -> DataFrame:
    """The first ``most`` facts of each chunk in the extractor's ``order``; others are not facts of the store."""
    w = Window.partitionBy("chunk_id").orderBy(order)
    return raw.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def with_ids(raw: DataFrame) -> DataFrame:
    made = fact_id("doc_id", "chunk_id", "subject", "predicate", "value_raw", "period_label_raw", "scope_tags")
    return raw.withColumn("fact_id", made).withColumn("evidence_id", evidence_id("fact_id", "evidence_quote"))


def build_facts(raw: DataFrame, chunks: DataFrame, pages: DataFrame, version: str = "extract-1") -> tuple[DataFrame, DataFrame]:
    """(facts, evidence) of ``raw``: doc_id, chunk_id, subject, predicate, value_raw, value_type, unit_raw, period_label_raw,
    period_start, period_end, period_basis (text, as guessed), scope_tags, qualifiers (map), evidence_quote, confidence, extraction_note.

    The stated period wins over the guessed one. Qualifiers of the extractor give way to those read from the value (bound,
    range), these to the note. A quote is looked for in its chunk; where it is found decides the page, else the chunk's first
    page stands. Raw rows given twice are one fact; null texts count as empty, a fact of an unknown chunk is unverified.
    """
    rows = with_ids(raw).dropDuplicates(["fact_id"])
    v, p = normalize_value("value_raw", F.coalesce("unit_raw", F.lit("")), "value_type"), parse_period("period_label_raw")
    guess, until = parse_period("period_start"), parse_period("period_end")
    rows = rows.withColumns({"v": v, "p": p, "g": guess, "u": until})
    guessed = F.col("p.start").isNull() & (F.coalesce("period_start", F.lit("")) != "")
    read = F.map_from_arrays(F.array(*map(F.lit, ("bound", "range_low", "range_high"))), F.array(F.col("v.bound"), F.col("v.range_low").cast("string"), F.col("v.range_high").cast("string")))
    note = F.create_map(F.lit("extraction_note"), F.nullif("extraction_note", F.lit("")))
    given = F.coalesce("qualifiers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = [F.map_filter(m, lambda k, x: x.isNotNull()) for m in (read, note)]
    # later maps win: each earlier one gives up the keys that a later one has
    less = lambda m, later: F.map_filter(m, lambda k, _: ~F.map_contains_key(later, k))
    qualifiers = F.map_concat(less(less(given, kept[0]), kept[1]), less(kept[0], kept[1]), kept[1])
    facts = rows.select(
        "fact_id", "doc_id", "chunk_id", clean_text("subject").alias("subject_raw"), canonical_subject("subject").alias("subject_canonical"), F.lit(None).cast("string").alias("entity_id"),
        clean_text("predicate").alias("predicate"), canonical_predicate("predicate").alias("predicate_canonical"), clean_text("value_raw").alias("value_raw"), "value_type",
        "v.value_num", "v.value_text", F.nullif(clean_text("unit_raw"), F.lit("")).alias("unit_raw"), "v.unit_canonical", "v.unit_dimension", "v.magnitude", "v.magnitude_label", "v.currency",
        F.when(guessed, F.col("g.start")).otherwise(F.col("p.start")).alias("period_start"),
        F.when(guessed, F.when(F.coalesce("period_end", F.lit("")) != "", F.col("u.end")).otherwise(F.col("g.end"))).otherwise(F.col("p.end")).alias("period_end"),
        F.nullif(clean_text("period_label_raw"), F.lit("")).alias("period_label_raw"),
        F.when(guessed, F.coalesce("period_basis", F.lit("unknown"))).otherwise(F.col("p.basis")).alias("period_basis"),
        normalize_scope_tags("scope_tags").alias("scope_tags"), qualifiers.alias("qualifiers"), F.col("confidence").cast("double").alias("confidence"), "evidence_id", F.lit(version).alias("extractor_version"),
    )
    found = verify_quotes(rows.select("evidence_id", "chunk_id", F.col("evidence_quote").alias("quote")), chunks, "chunk_id")
    place = chunks.select("chunk_id", F.col("char_start").alias("_base"), F.col("page_index_start").alias("_page")).dropDuplicates(["chunk_id"])
    quotes = rows.select("evidence_id", "fact_id", "doc_id", "chunk_id", F.col("evidence_quote").alias("quote")).join(found, "evidence_id").join(place, "chunk_id", "left")
    quotes = quotes.withColumns({"char_start": F.col("_base") + F.col("char_start"), "char_end": F.col("_base") + F.col("char_end")})
    resolved = resolve_pages(quotes, pages)
    first = pages.select("doc_id", F.col("page_index").alias("_page"), F.col("page_label").alias("_label")).dropDuplicates(["doc_id", "_page"])
    evidence = resolved.join(first, ["doc_id", "_page"], "left").select(
        "evidence_id", "fact_id", "doc_id", F.coalesce("page_index", "_page").alias("page_index"), F.when(F.col("page_index").isNull(), F.col("_label")).otherwise(F.col("page_label")).alias("page_label"),
        "quote", "char_start", "char_end", F.array().cast("array<array<double>>").alias("bbox"), "verified", F.col("score").alias("match_score"), F.col("method").alias("match_method"),
    )
    return facts, evidence


# Pages -----------------------------------------------------------------------------------------------------------------

#: Printed page labels, and programs that make slides.
ARABIC_LABEL = r"(?i)^(?:page\s*)?(\d{1,4})$"
ROMAN_LABEL = r"(?i)^(?=[ivxlcdm]{1,7}$)m*(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})$"
SLIDE_PRODUCERS = r"(?i)powerpoint|keynote|google slides|impress|canva"


def page_label(words: Column | str, top: Column | str, bottom: Column | str, margin: float = 0.10) -> Column:
    """The label printed in a page's margin, from its ``words`` (array of structs ``x0, y0, x1, y1, word``) and the page's edges.

    Of the lower margin, then of the upper one: the first bare number, else the first roman numeral of two letters or more.
    """
    top, bottom = _c(top), _c(bottom)
    height = bottom - top
    bare = F.transform(_c(words), lambda w: F.struct(w["y0"].alias("y0"), w["y1"].alias("y1"), F.regexp_replace(F.trim(w["word"]), r"^[.,:;|\[\]()]+|[.,:;|\[\]()]+$", "").alias("t")))
    texts = lambda keep: F.transform(F.filter(bare, lambda w: (w["t"] != "") & keep(w)), lambda w: w["t"])
    high, low = (lambda w: w["y1"] <= top + height * margin), (lambda w: w["y0"] >= bottom - height * margin)

    def label(band: Column) -> Column:
        arabic = F.get(F.filter(band, lambda t: t.rlike(ARABIC_LABEL)), 0)
        roman = F.get(F.filter(band, lambda t: t.rlike(ROMAN_LABEL) & (F.length(t) > 1)), 0)
        return F.coalesce(F.regexp_extract(arabic, ARABIC_LABEL, 1), F.lower(roman))

    return F.when(height > 0, F.coalesce(label(texts(low)), label(texts(lambda w: high(w) & ~low(w)))))


def tables_markdown(tables: Column | str) -> Column:
    """The useful ones of a page's tables (array of rows of cells) as pipe tables, each under its number; empty if none is."""
    cell = lambda x: F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"\s*\n\s*", " ")
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r, cell), "|"), F.lit("|"))

    def one(t: Column, i: Column) -> Column:
        rule = F.concat(F.lit("|"), F.array_join(F.transform(t[0], lambda _: F.lit("---")), "|"), F.lit("|"))
        body = F.array_join(F.concat(F.array(line(t[0]), rule), F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), line)), "\n")
        return F.when(table_is_useful(t), F.concat(F.lit("[table "), (i + 1).cast("string"), F.lit("]\n"), body))

    return F.array_join(F.array_compact(F.transform(_c(tables), one)), "\n\n")


def made_as_slides(*properties: Column | str) -> Column:
    """Whether a file's creator, producer or title names a program for slides."""
    return F.concat_ws(" ", *[_c(p) for p in properties]).rlike(SLIDE_PRODUCERS)
