from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import chunking, entities, funnel, quantities, rules, store, verify

FACT = (
    "fact_id string, doc_id bigint, chunk_id string, entity_id string, predicate string, predicate_canonical string, value_raw string, value_type string, value_num double, value_text string, unit_raw string, "
    "unit_canonical string, unit_dimension string, currency string, period_start date, period_end date, period_label_raw string, scope_tags array<string>, qualifiers map<string,string>, evidence_id string, "
    "created_at timestamp_ntz, confidence double"
)


def fact(i, **k):
    base = dict(
        fact_id=i, doc_id=1, chunk_id="c" + i, entity_id="e", predicate="revenue", predicate_canonical="revenue", value_raw="100", value_type="numeric", value_num=100.0, value_text=None, unit_raw=None,
        unit_canonical="INR", unit_dimension="currency", currency="INR", period_start=date(2023, 4, 1), period_end=date(2024, 3, 31), period_label_raw="FY24", scope_tags=[], qualifiers={}, evidence_id="v" + i,
        created_at=datetime(2024, 1, 1), confidence=0.9,
    )
    return tuple((base | k).values())


def verdicts(spark, cases):
    """One evaluation of all cases: a list of (a, b, as_of of a, as_of of b)."""
    facts, docs, pairs = [], [], []
    for i, (a, b, va, vb) in enumerate(cases):
        facts += [fact(f"{i:03d}a", doc_id=2 * i, **a), fact(f"{i:03d}b", doc_id=2 * i + 1, **b)]
        docs += [(2 * i, va), (2 * i + 1, vb)]
        pairs.append((f"{i:03d}a", f"{i:03d}b"))
    paired = rules.pair_facts(spark.createDataFrame(pairs, "fact_a string, fact_b string"), spark.createDataFrame(facts, FACT), spark.createDataFrame(docs, "doc_id bigint, as_of_date date"))
    return sorted(rules.evaluate_pairs(paired).collect(), key=lambda r: r.fact_a)


H1 = dict(period_start=date(2023, 4, 1), period_end=date(2023, 9, 30))
OLD = dict(period_start=date(2020, 4, 1), period_end=date(2021, 3, 31))
TEXT = dict(value_type="string", value_num=None, unit_canonical=None, unit_dimension=None, currency=None)


CASES = (
    [
        ({}, TEXT | dict(value_raw="x"), "unrelated", "value_type"),
        ({}, dict(unit_dimension="mass"), "unrelated", "unit_dimension"),
        (dict(unit_dimension=None), dict(predicate_canonical="profit"), "unrelated", "predicate_without_dimension"),
        ({}, dict(currency="USD"), "unrelated", "currency"),
        ({}, dict(currency="USD", qualifiers={"exchange_rate": "82"}), None, "currency_with_rate"),
        ({}, dict(value_num=None), None, "numeric_values"),
        (dict(unit_canonical="tonne", unit_dimension="mass", value_num=1.0, currency=None), dict(unit_canonical="kg", unit_dimension="mass", value_num=1000.0, currency=None), "reconciled_by_unit", "unit_agreement"),
        ({}, H1 | dict(value_num=50.0), "refines", "period_nested"),
        ({}, OLD, "reconciled_by_period", "period_disjoint"),
        (dict(scope_tags=["standalone"]), dict(scope_tags=["consolidated"], value_num=150.0), "reconciled_by_scope", "scope"),
        ({}, {}, "corroborates", "agreement"),
        (dict(value_raw="100.00"), dict(value_raw="101.00", value_num=101.0), "corroborates", "minor_gap"),
        ({}, dict(value_num=150.0, value_raw="150"), None, "material_gap"),
        (TEXT | dict(value_raw="Foo Bar", value_text="Foo Bar"), TEXT | dict(value_raw="bar foo", value_text="bar foo"), "corroborates", "wording"),
        (TEXT | dict(value_raw="12 MG Road 122001"), TEXT | dict(value_raw="12, MG Rd - 122001"), "corroborates", "address"),
        (TEXT | dict(value_raw="x y"), TEXT | OLD | dict(value_raw="p q"), "reconciled_by_period", "wording_period"),
        (TEXT | dict(value_raw="x y"), TEXT | dict(value_raw="p q"), None, "wording_unsettled"),
    ]
)
AREA = [dict(unit_canonical=u, unit_dimension="area", currency=None) for u in ("sq_ft", "sq_m")]


def test_rule_chain(spark):
    cases = CASES + [(*AREA, "reconciled_by_unit", "unit_agreement")]
    got = verdicts(spark, [(a, b, None, None) for a, b, _, _ in cases] + [({}, dict(value_num=150.0, value_raw="150"), date(2024, 1, 1), date(2024, 6, 1))])
    assert [(v.relation, v.step) for v in got] == [c[2:] for c in cases] + [("reconciled_by_vintage", "vintage")]
    assert all(v.trace[-1].outcome == (v.relation or "undecided") for v in got)


def test_funnel_against_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 240
    v = rng.standard_normal((n, 64)) + 2 * np.eye(64)[rng.integers(0, 4, n)] * 6
    rows = [(f"{i:03d}", i % 7, f"c{i % 50}", f"e{i % 3}" if i % 5 else None, f"p{i % 4}" if i % 6 else None, "numeric", ["mass", None, "area"][i % 3], "k", v[i].tolist()) for i in range(n)]
    s = spark.createDataFrame(rows, "fact_id string, doc_id bigint, chunk_id string, entity_id string, predicate_canonical string, value_type string, unit_dimension string, collection string, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    blocked = []
    for i in range(n):
        for j in range(i + 1, n):
            a, b = rows[i], rows[j]
            if a[2] != b[2] and (a[6] == b[6] or None in (a[6], b[6])) and ((a[3] and a[3] == b[3]) or (a[4] and a[4] == b[4])):
                blocked.append((a[0], b[0], float(u[i] @ u[j])))
    assert funnel.count_blocked_pairs(s).first().n_pairs == len(blocked)
    near = [p for p in blocked if p[2] >= 0.3]
    want = set()
    for side, other in ((0, 1), (1, 0)):
        for key in {p[side] for p in near}:
            want |= {p[:2] for p in sorted((p for p in near if p[side] == key), key=lambda p: (-p[2], p[other]))[:3]}
    funnel.TILE, tile = 16, funnel.TILE
    got = {(r.fact_a, r.fact_b) for r in funnel.generate_candidates(s, 3, 0.3).collect()}
    funnel.TILE = tile
    assert got == want
    new = spark.createDataFrame([(3,)], "doc_id bigint")
    assert all(int(r.fact_a) % 7 == 3 or int(r.fact_b) % 7 == 3 for r in funnel.generate_candidates(s, 3, 0.3, new_docs=new).collect())


TABLE = "| a | b |\n| - | - |\n| 1 | 2 |\n"


def test_chunks_are_slices(spark):
    page = "First sentence here. " * 120 + "\n" + TABLE * 20 + "Tail text. " * 30
    spans = chunking.page_spans(page)
    assert all(page[s:e].strip() for s, e, _ in spans) and spans[0][0] == 0 and spans[-1][1] == len(page)
    assert any(k in ("table", "mixed") for _, _, k in spans)
    assert chunking.page_spans("   \n") == [] and chunking.page_spans("short") == [(0, 5, "prose")]
    assert chunking.page_spans("word " * 400, whole=True) == [(0, 2000, "prose")]
    pages = spark.createDataFrame([(1, 0, 0, page), (1, 0, 0, page), (1, 1, 5000, None), (2, 0, 0, "")], "doc_id bigint, page_index int, char_start bigint, text string")
    got = chunking.chunk_pages(pages).collect()
    assert len(got) == len({r.chunk_id for r in got}) and all(page[r.char_start : r.char_end] == r.text for r in got)


def test_page_ranges(spark, rows):
    pages = spark.createDataFrame([(1, 0, "i", 0, 10, "x" * 10), (1, 1, "ii", 12, None, "y" * 5), (2, 0, "a", 0, 3, "zzz")], "doc_id bigint, page_index int, page_label string, char_start bigint, char_end bigint, text string")
    points = spark.createDataFrame([(1, 10), (1, 12), (1, 17), (1, 11), (3, 0)], "doc_id bigint, char_start bigint")
    assert rows(chunking.resolve_pages(points, pages), "char_start", "page_index") == [(0, None), (10, 0), (11, None), (12, 1), (17, 1)]
    assert rows(chunking.page_offsets(pages.select("doc_id", "page_index", "text"))) == [(1, 0, 0, 10), (1, 1, 12, 17), (2, 0, 0, 3)]


@pytest.mark.parametrize(
    "quote, method, found",
    [
        ("grew by 12% in", "exact", "grew by 12% in"), ("GREW   by 12% In", "normalized", "grew by 12% in"), ("the total revenue grew by", "markup_insensitive", "The **Total** revenue grew by"),
        ("grew by 12% in the lest year", "fuzzy", None), ("nothing of the kind stands here", "fuzzy_failed", None), ("x", "too_short", None), (None, "too_short", None),
    ],
)
def test_find_quote(quote, method, found):
    body = "The **Total** revenue grew by 12% in the last year, it says."
    s, e, score, how = verify.find_quote(quote, body)
    assert how == method and (found is None or body[s:e] == found)
    assert (s is not None) == (method not in ("fuzzy_failed", "too_short"))


def test_verify_quotes(spark, rows):
    q = spark.createDataFrame([("1", "k", "grew by 12%"), ("1", "k", "grew by 12%"), ("2", "k", "GREW  BY 12%"), ("3", "none", "grew by 12%"), ("4", "k", None)], "evidence_id string, k string, quote string")
    src = spark.createDataFrame([("k", "it grew by 12% \U0001f600")], "k string, text string")
    got = rows(verify.verify_quotes(q, src, "k"), "evidence_id", "char_start", "method")
    assert got == [("1", 3, "exact"), ("2", 3, "normalized"), ("3", None, "too_short"), ("4", None, "too_short")]


def test_resolver_ladder(spark):
    ents = spark.createDataFrame(
        [("e1", "Foo Bar Logistics Limited", "organisation", ["FBL"]), ("e2", "12 MG Road, 122001", "address", None), ("e3", "Quux", "unknown", [])], "entity_id string, canonical_name string, entity_type string, aliases array<string>"
    ).withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.when(F.col("entity_id") == "e3", 1.0).otherwise(0.0).cast("float")))
    subj = spark.createDataFrame(
        [("FOO BAR LOGISTICS", [1.0, 0.0]), ("F.B.L", [0.0, 1.0]), ("fbl", [0.0, 1.0]), ("12 MG Rd 122001", [0.0, 1.0]), ("Foo Bar Logistic Ltd", [0.0, -1.0]), ("Other thing", [1.0, 0.9]), ("Brand New", [-1.0, 0.2]), (None, None), ("", None)],
        "subject_raw string, v array<float>",
    )
    got = {r.subject_raw: (r.method, r.entity_id) for r in entities.resolve_subjects(subj, ents, vector_col="v").collect()}
    assert got["FOO BAR LOGISTICS"] == ("exact", "e1") and got["fbl"] == ("alias", "e1") and got["12 MG Rd 122001"] == ("address", "e2")
    assert got["Foo Bar Logistic Ltd"] == ("fuzzy", "e1") and got["Other thing"] == ("embedding", "e3") and got["Brand New"][0] == "new" and "" not in got
    grown = entities.attach_aliases(ents, entities.resolve_subjects(subj, ents, vector_col="v"))
    assert "foo bar logistic" in next(r.aliases for r in grown.collect() if r.entity_id == "e1")


def test_store(spark, rows):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, x string, y int")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string")
    assert rows(store.upsert(base, new, ["id"])) == [(1, "a", 5), (2, "c", None), (3, "d", None)]
    once = store.upsert(base, new, ["id"])
    assert rows(store.upsert(once, new, ["id"])) == rows(once)
    ch = spark.createDataFrame([(1, "p"), (2, "q")], "doc_id int, t string")
    assert rows(store.replace_by_document(ch, spark.createDataFrame([(2, "r"), (2, "s")], "doc_id int, t string"))) == [(1, "p"), (2, "r"), (2, "s")]
    assert rows(store.set_values(base, "id", spark.createDataFrame([(1, "z")], "id int, x string"))) == [(1, "z", 5), (2, "b", 6)]
    hits, misses = store.cache_lookup(base, new.select("id"), "id")
    assert rows(hits, "id") == [(2,)] and rows(misses, "id") == [(1,)]


@pytest.mark.parametrize(
    "fields, want",
    [
        (("12,91,884 Lakh g", None, None, None, None), ("mass", 12_91_884 * 1e5 * 0.001)), (("24.191", None, "lakh", "tonne", None), ("mass", 24.191e5 * 1000)),
        (("0.2482 lac", "Tons", "lakh", "tonne", None), ("mass", 0.2482e5 * 1000)), (("(11.9784)", "USD cr.", None, None, None), ("currency", -11.9784e7)), (("4,735 bps", None, "mn", None, None), ("ratio", 47.35)),
        (("5 m", None, None, None, None), ("length", 5.0)), (("5 m", None, None, "INR", None), ("currency", 5e6)), (("36.133", None, None, "km", None), ("length", 36133.0)), ((None,) * 5, (None, None)),
        (("about 5-7 days", None, None, None, None), ("duration", 6.0)),
    ],
)
def test_common_quantities(spark, fields, want):
    df = spark.createDataFrame([("f", *fields, 7)], "fact_id string, value_raw string, unit_raw string, magnitude_label string, unit_canonical string, currency string, unit int")
    got = quantities.common_quantities(df).first()
    assert got.dimension == want[0] and (got.quantity == pytest.approx(want[1]) if want[1] is not None else got.quantity is None)


def test_agreeing_pairs_against_brute_force(spark, rows):
    rng = np.random.default_rng(2)
    data = [(f"{i:03d}", "hot" if i % 3 else f"g{i % 9}", float(x)) for i, x in enumerate(np.round(np.exp(rng.normal(0, 1.5, 300)) * rng.choice([-1, 1], 300), 2))] + [("z1", "hot", 0.0), ("z2", "hot", 0.0), ("n", None, 1.0), ("m", "hot", None)]
    df = spark.createDataFrame(data + data[:9], "id string, g string, v double")
    want = {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[1] and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 0.005 * max(abs(a[2]), abs(b[2]))}
    assert set(rows(quantities.agreeing_pairs(df, "id", "g", "v"))) == want
    assert quantities.agreeing_pairs(df.limit(0), "id", "g", "v").count() == 0


def test_similar_names_against_brute_force(spark, rows):
    from factloom.functions.fuzzy import ratio
    from factloom.operators import namejoin

    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdef"), int(rng.integers(2, 8))))
    known = [" ".join(word() for _ in range(int(rng.integers(1, 5)))) for _ in range(60)]

    def typed(s):
        s = list(s)
        for _ in range(int(rng.integers(0, 4))):
            s.insert(int(rng.integers(0, len(s) + 1)), rng.choice(list("abcdef "))) if rng.random() < 0.5 or not s else s.pop(int(rng.integers(0, len(s))))
        return "".join(s)

    asked = [typed(rng.choice(known)) for _ in range(200)] + ["", None, "  "]
    by_words = lambda s: " ".join(sorted(s.split()))
    a = spark.createDataFrame([(x,) for x in asked * 2], "name string").withColumn("other", F.lit("clash"))
    b = spark.createDataFrame([(x,) for x in known], "name string")
    for least in (86.0, 92.0):
        want = {(x, y) for x in asked if x and x.strip() for y in known if ratio(by_words(x), by_words(y)) >= least}
        assert set(rows(namejoin.similar_names(a, b, least), "name", "other")) == want and want
    assert namejoin.similar_names(a.limit(0), b).count() == 0


def test_similar_vectors_in_tiles(spark, rows, monkeypatch):
    from factloom.operators import namejoin

    rng = np.random.default_rng(12)
    x, y = rng.standard_normal((40, 4)), rng.standard_normal((50, 4))
    a = spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 4), ("none", None), ("short", [1.0])], "name string, vec array<double>")
    b = spark.createDataFrame([(f"e{i}", v.tolist()) for i, v in enumerate(y)], "entity_id string, vec array<double>")
    s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    want = {(f"n{i}", f"e{j}") for i, j in zip(*np.nonzero(s >= 0.7))}
    for tile, stream in ((20_000, 50_000), (7, 9)):
        monkeypatch.setattr(namejoin, "TILE", tile)
        monkeypatch.setattr(namejoin, "STREAM", stream)
        assert set(rows(namejoin.similar_vectors(a, b, 0.7), "name", "entity_id")) == want


def test_values_can_be_set_to_null(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    gone = spark.createDataFrame([(1, None)], "id int, x string")
    assert rows(store.set_values(base, "id", gone)) == [(1, "a"), (2, "b")] and rows(store.set_values(base, "id", gone, nulls=True)) == [(1, None), (2, "b")]


def test_many_quotes_of_one_source(spark, rows, monkeypatch):
    monkeypatch.setattr(verify, "QUOTES", 7)
    text = " ".join(f"sentence {i} stands here." for i in range(60))
    q = spark.createDataFrame([(str(i), "k", f"sentence {i} stands here" if i % 3 else f"SENTENCE  {i} stands") for i in range(60)], "evidence_id string, k string, quote string")
    got = rows(verify.verify_quotes(q, spark.createDataFrame([("k", text)], "k string, text string"), "k"), "evidence_id", "method")
    assert got == sorted((str(i), "exact" if i % 3 else "normalized") for i in range(60))
