"""Operators on small fixtures, against brute force; nulls, empty and long texts, ties, repeated rows, clashing columns."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import leak, lines, names, neighbours, packing, similar, spans, split, vocabulary, wordjoin

# 3 ---------------------------------------------------------------------------------------------------------------------


def plain_split(text, limit, overlap):
    out, s = [], 0
    while True:
        if len(text) - s <= limit:
            return out + [(s, len(text))]
        e = s + limit
        for sep in split.SEPARATORS:
            i = text[s : s + limit].rfind(sep)
            if i > limit // 2:
                e = s + i + len(sep)
                break
        out.append((s, e))
        s = max(s + 1, e - overlap)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n\U0001f600é", max_size=400), st.integers(2, 60), st.integers(0, 30))
def test_split_equals_plain(text, limit, overlap):
    if overlap < limit:
        got = split.split_spans(text, limit, overlap)
        assert got == plain_split(text, limit, overlap)
        assert all(e - s <= limit for s, e in got) and got[0][0] == 0 and got[-1][1] == len(text)
        sized = split.split_spans(text, limit, overlap, offsets=split.token_offsets(text, lambda t: [1] * len(t)))
        assert sized == got


def test_split_items(spark, rows):
    long = "word " * 1000
    df = spark.createDataFrame([("a", long, 10, "x"), ("a", long, 10, "x"), ("b", "short", None, "y"), ("c", None, 1, None), (None, "z" * 4000, 0, ""), ("d", "", 0, "")], "chunk_id string, text string, char_start bigint, piece_no string")
    got = rows(split.split_items(df, whole=True, start_col="char_start"))
    a = [r for r in got if r[0] == "a"]
    assert [r[2:4] for r in sorted(a, key=lambda r: r[1])] == plain_split(long, 1800, 200) and a[0][4] >= 10
    assert sum(r[0] is None for r in got) == 3 and [r[2:4] for r in got if r[0] in ("b", "d")] == [(0, 5), (0, 0)]
    assert split.split_items(df.limit(0)).count() == 0
    mixed = spark.createDataFrame([("a", "é" * 1000 + " " + "x" * 900, "Table"), ("b", "x" * 1800, None)], "chunk_id string, text string, kind string")
    sized = rows(split.split_items(mixed, kind_col="kind", weigh=split.byte_sizes), "chunk_id", "kind", "piece_start", "piece_end")
    assert [r[:2] for r in sized] == [("a", "table")] * len(sized) and len(sized) == 2 and all(len(mixed.first().text[s:e].encode()) <= 1800 for _, _, s, e in sized)
    assert split.byte_sizes("aé漢\U0001f600").tolist() == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        split.split_spans("x", 10, 10)


# 2 ---------------------------------------------------------------------------------------------------------------------


def test_repeated_lines(spark, rows):
    legal, share = "All rights reserved by the example company", "Please share this page with your friends today"
    docs = [(i, "a" if i < 30 else "b") for i in range(40)] + [(40, None), (0, "a")]
    pages = []
    for i in range(41):
        body = [f"unique line number {'x' * i} of some length {chr(97 + i % 26) * 9}", ""]
        if i < 3 or i == 40:
            body += [legal.upper() + " (2019)", share]
        if 3 <= i < 5:
            body += [share]
        pages.append((i, 0, "\n".join(body), i))
    pages += [pages[0], (7, 1, None, 0), (99, 0, legal, 0)]
    p = spark.createDataFrame(pages, "doc_id bigint, page_index int, text string, block_id int")
    d = spark.createDataFrame(docs, "doc_id bigint, collection string")
    r = lines.repeated_lines(p, d)
    assert rows(r.occurrences, "doc_id", "page_index", "line_no") == [(0, 0, 2), (0, 0, 3), (1, 0, 2), (1, 0, 3), (2, 0, 2), (2, 0, 3), (3, 0, 2), (4, 0, 2)]
    assert len({b for b in rows(r.nodes, "block_id")}) == 1  # the two lines follow one another
    runs = rows(lines.block_runs(r.occurrences), "doc_id", "first_line", "last_line", "n_lines")
    assert runs == [(0, 2, 3, 2), (1, 2, 3, 2), (2, 2, 3, 2), (3, 2, 2, 1), (4, 2, 2, 1)]
    clean = {(a, b): (t, n) for a, b, t, n in rows(lines.clean_pages(p, r.occurrences))}
    assert clean[3, 0][1] == 1 and share not in clean[3, 0][0] and clean[7, 1] == (None, 0) and share in clean[40, 0][0]
    assert lines.repeated_lines(p.limit(0), d).occurrences.count() == 0


def test_lines_without_broadcast(spark, rows, monkeypatch):
    """One hot line in a third of all pages; both plans give the same occurrences."""
    from factloom import session

    hot, rare = "This line stands on very many of the pages", "This other line stands on a few of the pages"
    pages = [(i, 0, f"own words {'abcdefghij'[i % 10] * 12} {'xyz'[i % 3] * (5 + i)}\n" + (hot if i % 3 == 0 else rare if i % 7 == 1 else "")) for i in range(120)]
    p, d = spark.createDataFrame(pages, "doc_id bigint, page_index int, text string"), spark.createDataFrame([(i, "c") for i in range(120)], "doc_id bigint, collection string")
    one = rows(lines.repeated_lines(p, d).occurrences, "doc_id", "line_no")
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    assert rows(lines.repeated_lines(p, d).occurrences, "doc_id", "line_no") == one and len(one) > 40


# 7 ---------------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_places_all(counts):
    got, boxes = Counter(), 0
    for n, need in packing.plan_patterns(counts, 40):
        assert n > 0 and sum(s * k for s, k in need.items()) <= 40
        boxes += n
        for s, k in need.items():
            got[s] += n * k
    assert got == Counter(counts)
    total = sum(s * k for s, k in counts.items())
    assert boxes <= max(1, 2 * -(-total // 40)) or not counts  # no two containers fit in one
    assert packing.lower_bound(counts, 40) <= boxes


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_tight(seed):
    sizes = Counter(np.random.default_rng(seed).integers(1, 4097, 3000).tolist())
    assert sum(n for n, _ in packing.plan_patterns(sizes, 4096)) <= 1.02 * packing.lower_bound(sizes, 4096)


def test_triple_complement_tries_every_third():
    """Only the four sizes that leave 1 when divided by 6 fit exactly; 78 thirds without a fit stand before the first that has one."""
    fit = {2101: 1, 1801: 1, 187: 1, 7: 1}
    counts = fit | {1806: 1} | {s: 1 for s in range(192, 660, 6)}
    assert (1, fit) in packing._plan(counts, 4096, 3)


def test_pack(spark, rows):
    sizes = [(i, int(x)) for i, x in enumerate(np.random.default_rng(3).integers(1, 260, 400))] + [(1000 + i, 77) for i in range(300)]
    df = spark.createDataFrame(sizes + sizes[:5] + [(5000, None), (None, 3)], "id bigint, n bigint").withColumn("container_id", F.lit("clash"))
    got = packing.pack(df, "id", "n", 100, rows_per_bucket=64).collect()
    load, pieces = Counter(), defaultdict(list)
    for r in got:
        load[r.container_id] += r.unit_end - r.unit_start
        pieces[r.id].append((r.piece_no, r.unit_start, r.unit_end, r.n_pieces))
    assert max(load.values()) <= 100 and len(pieces) == 702
    for i, n in sizes:
        p = sorted(pieces[i])
        assert p[0][1] == 0 and p[-1][2] == n and len(p) == -(-n // 100) and all(x[2] == y[1] for x, y in zip(p, p[1:]))
    assert len(load) <= 1.1 * sum(load.values()) / 100 + 1
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------------


def test_automaton_against_brute_force():
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 6, n)]
    items = {i: word(rng.integers(0, 30)) for i in range(12)}
    for min_words in (1, 3, 5):
        (a,) = leak.build_automata([(i, " ".join(w)) for i, w in items.items()], min_words)
        for _ in range(30):
            doc = word(rng.integers(0, 60)) + list(items[int(rng.integers(12))][:9])
            ids = np.array([a.vocab.get(w, -1) for w in doc])
            got = a.matches(ids, min_words)
            grams = lambda w: {tuple(w[i : i + min_words]) for i in range(len(w) - min_words + 1)}
            assert set(got) == {i for i, w in items.items() if grams(w) & grams(doc)}
            for i, sp in got.items():
                assert all(e - s >= min_words and tuple(doc[s:e]) in {tuple(items[i][k : k + e - s]) for k in range(len(items[i]))} for s, e in sp)


def test_leaks(spark, rows):
    passage = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame(
        [(1, f"Before. {passage.upper()}! After text that goes on and on for a while."), (2, " ".join(passage.split()[:14]) + " end"), (3, None), (4, ""), (5, passage.replace(" ", " - "))],
        "doc_id bigint, text string",
    ).withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, passage), (7, passage), (8, "too short"), (9, None)], "item_id bigint, text string")
    sp = leak.leaked_items(docs, items)
    assert rows(leak.leak_report(sp), "doc_id", "item_id", "longest_words") == [(1, 7, 20), (5, 7, 20)]
    clean = {r.doc_id: r for r in leak.remove_leaks(docs, sp, max_share=0.8).collect()}
    assert clean[1].text == "Before.  After text that goes on and on for a while."
    assert clean[5].dropped and clean[5].text is None and clean[2].text.endswith("end") and clean[3].text is None
    more = spark.createDataFrame([(7, passage), (20, passage + " and more"), (21, "other " * 30), (22, " ".join(passage.split()[3:]))], "item_id bigint, text string")
    whole = rows(leak.leaked_items(docs, more), "doc_id", "item_id", "first_word", "end_word")
    old, leak.WORDS_PER_AUTOMATON = leak.WORDS_PER_AUTOMATON, 25
    try:
        assert rows(leak.leaked_items(docs, more), "doc_id", "item_id", "first_word", "end_word") == whole and len(whole) == 6
    finally:
        leak.WORDS_PER_AUTOMATON = old
    assert leak.leaked_items(docs, items.limit(0)).count() == 0 and leak.leaked_items(docs.limit(0), items).count() == 0
    assert leak.words_of("Don't stop²—Ünïcode 3.5") == ["dont", "stopünïcode", "35"]


# 9 ---------------------------------------------------------------------------------------------------------------------


def brute_pairs(docs, n):
    grams = defaultdict(set)
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            grams[t[k : k + n]].add(i)
    return {(a, b) for g in grams.values() for a in g for b in g if a < b}


def test_spans_against_brute_force(spark, rows):
    rng = np.random.default_rng(5)
    rand = lambda n: "".join(rng.choice(list("abcdefgh é\U0001f600"), n))
    shared = [rand(k) for k in (39, 40, 41, 80, 200)]
    docs = [(i, rand(int(rng.integers(0, 300)))) for i in range(60)]
    for i in range(0, 60, 2):
        s = shared[i // 2 % 5]
        docs[i] = (i, docs[i][1][:70] + s + docs[i][1][70:])
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, "x" * 500), (103, "x" * 450 + "y"), (104, None), (105, "")]
    df = spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string").withColumn("h", F.lit(1))
    sh = spans.shared_windows(df, min_chars=40, gram=40)
    want = brute_pairs([d for d in docs if d[1]], 40)
    assert set(rows(spans.document_pairs(sh))) == want
    assert set(rows(spans.document_pairs(spans.shared_windows(df, min_chars=50, gram=45)))) == brute_pairs([d for d in docs if d[1]], 50)
    old, spans.SHARD_PASSAGES, spans.SHARD_TEXTS = (spans.SHARD_PASSAGES, spans.SHARD_TEXTS), 7, 5
    try:
        assert set(rows(spans.document_pairs(spans.shared_windows(df, min_chars=50, gram=45)))) == brute_pairs([d for d in docs if d[1]], 50)
    finally:
        spans.SHARD_PASSAGES, spans.SHARD_TEXTS = old
    cover = dict(rows(spans.shared_coverage(spans.document_spans(sh, df, min_chars=40)), "doc_id", "shared_chars"))
    text = dict(docs)
    for i, t in docs:
        marked = set()
        other = {u[k : k + 40] for j, u in docs if j != i and u for k in range(len(u) - 39)}
        for k in range(len(t or "") - 39):
            if t[k : k + 40] in other:
                marked |= set(range(k, k + 40))
        assert cover.get(i, 0) == len(marked), (i, text[i])
    every = dict(rows(spans.shared_coverage(spans.document_spans(sh, df, min_chars=40), documents=df), "doc_id", "shared_chars"))
    assert every == {i: cover.get(i, 0) for i in text} and 0 in every.values()
    assert spans.document_pairs(spans.shared_windows(df.limit(0))).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", min_size=1, max_size=14), st.lists(st.tuples(st.integers(0, 20), st.sampled_from("sid"), st.sampled_from("abcd")), max_size=3))
def test_segments_find_every_variant(word, edits):
    w = list(word)
    for at, op, c in edits[: similar.edits_allowed(len(word))]:
        at %= len(w) + 1
        if op == "i":
            w.insert(at, c)
        elif w and at < len(w):
            w[at : at + 1] = [c] if op == "s" else []
    q = "".join(w)
    if q:
        assert set(wordjoin.probe_keys(q)) & set(wordjoin.index_keys(word))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=8), st.text(alphabet="abc", max_size=8), st.integers(0, 4))
def test_banded_distance(a, b, k):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if 0 in (i, j)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert similar.banded_distance(a, b, k) == min(d[len(a), len(b)], k + 1)


def test_names(spark):
    ents = [
        ("e1", "Zaveind Southern Minerals LLP", ["ZSM"]), ("e2", "Zaveind Capital Holdings Limited", None), ("e3", "Katherine D. Roupravath", []), ("e4", "Edward Cloufiog", [None, ""]), ("e5", "General Foods", []),
        ("e6", None, ["Lonely Alias Works"]), ("e7", "Klaeklo Paper Index", []), ("e1", "Zaveind Southern Minerals LLP", ["ZSM"]),
    ]
    e = spark.createDataFrame(ents, "entity_id string, canonical_name string, aliases array<string>").withColumn("mention", F.lit("clash"))
    want = {
        "zaveind  minerals": "e1", "Minerals, Zaveind Sthn L.L.P.": "e1", "Z.S.M.": "e1", "Zave ind Southern Minerals": "e1", "M/s Zaveimd Cap. Hldgs Ltd.": "e2", "Roupravath, Kate": "e3", "K. R0upravath": "e3",
        "Mr. Ned Cloufiog": "e4", "GENERAL FOODS": "e5", "lonely alias wroks": "e6", "the Paper index of Klaeklo": "e7", "Zaveind": None, "Robert Roupravath": None, "Unheard Of Company": None, "": None, None: None,
    }
    m = spark.createDataFrame([(k, 1) for k in want] * 2, "subject_raw string, score int")
    got = {r.subject_raw: r.entity_id for r in names.link_names(m, "subject_raw", e).collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert names.link_names(m.limit(0), "subject_raw", e).count() == 0 and names.link_names(m, "subject_raw", e.limit(0)).count() == 0


def grid(n, seed):
    """Every given name of ``n`` with every surname of ``n``: each word is shared by ``n`` persons, and no person has a rare one."""
    rng = np.random.default_rng(seed)
    part = lambda: "".join(rng.choice(list("bcdfglmnprstv")) + rng.choice(list("aeiou")) for _ in range(4))
    surnames = [(part() + rng.choice(list("kxz"))).capitalize() for _ in range(n)]
    given = [g.capitalize() for g, v in names.NICKNAMES.items() if any(sum(x in y for y in names.NICKNAMES.values()) == 1 for x in v)][:n]
    given += [part().capitalize() for _ in range(n - len(given))]
    return [(f"{i:03d}.{j:03d}", f"{g} {s}") for i, g in enumerate(given) for j, s in enumerate(surnames)]


@pytest.mark.parametrize("hot", [4, 64])  # both sides of the bound
def test_names_of_common_words_only(spark, monkeypatch, hot):
    monkeypatch.setattr(wordjoin, "HOT", hot)
    people = grid(14, 3)
    e = spark.createDataFrame([(i, n, None) for i, n in people], "entity_id string, canonical_name string, aliases array<string>")
    want = {}
    for k, (i, n) in enumerate(people[::2]):
        g, s = n.split()
        nick = next(x for x in names.NICKNAMES[g.lower()] if sum(x in y for y in names.NICKNAMES.values()) == 1)
        want[[f"{s}, {g}", f"{nick.capitalize()} {s}", f"{g} {s[:3]}{s[4:]}", f"Dr. {g[:4]}{g[5:]} {s}"][k % 4]] = i
    m = spark.createDataFrame([(k,) for k in want], "m string")
    got = {r.m: r.entity_id for r in names.link_names(m, "m", e).collect()}
    right = sum(got.get(k) == v for k, v in want.items())
    assert right >= 0.9 * len(want) and sum(got[k] != want[k] for k in got) <= 0.02 * len(want)
    plain = {r.m for r in names.link_names(m, "m", e, nicknames={}).collect()}
    assert len(plain) < len(got)


def test_lookups_do_not_depend_on_hot(spark, monkeypatch, rows):
    """Candidates behind common words, pairs and triples: the entity meant is among them, whatever counts as common."""
    rng = np.random.default_rng(9)
    word = [f"word{c}" for c in "abcdefgh"]
    forms = {tuple(sorted(rng.choice(word, 4, replace=False))) for _ in range(60)}
    held = [(f"e{i}", i, list(f), 4.0, None) for i, f in enumerate(sorted(forms))]
    f = spark.createDataFrame(held, "eid string, fid bigint, words array<string>, need double, legal string")
    token = lambda j, w: (j, j + 1, w, 1.0, 1.0, [(w, 30)])
    q = spark.createDataFrame([(h[0], [token(j, w) for j, w in enumerate(h[2])]) for h in held], f"query string, tokens {wordjoin.TOKENS}")
    for hot in (1, 3, 1000):
        monkeypatch.setattr(wordjoin, "HOT", hot)
        got = set(rows(wordjoin.candidates(q, f, 0.2, "t")))
        assert {(h[0], h[0]) for h in held} <= got


# 5 ---------------------------------------------------------------------------------------------------------------------


def test_vocabulary(spark):
    reg = spark.createDataFrame([("net_debt", ["borrowings"]), ("warehouse_floor_space", None), ("number_of_shipments", []), ("net_debt", ["borrowings"]), (None, None)], "predicate_canonical string, al array<string>").withColumn("name", F.lit("clash"))
    want = {
        "The Net Debt In": "net_debt", "debt, net (a)": "net_debt", "NetDebt*": "net_debt", "borrowings as stated": "net_debt", "Whse Floor Space [approx]": "warehouse_floor_space", "no. of shipmnts": "number_of_shipments",
        "net curtain supplier": "unmatched", "??": "unmatched", "": "unmatched", None: "unmatched", "x" * 50_000: "unmatched",
    }
    v = spark.createDataFrame([(k,) for k in want] * 2, "predicate string").withColumn("how", F.lit(1))
    got = {r.predicate: r.predicate_canonical for r in vocabulary.map_values(v, "predicate", reg, "predicate_canonical", "al").collect()}
    assert got == want
    for size in (1, 2):
        assert {r.predicate: r.predicate_canonical for r in vocabulary.map_values(v, "predicate", reg, "predicate_canonical", "al", entries_per_shard=size).collect()} == want
    assert vocabulary.map_values(v.limit(0), "predicate", reg, "predicate_canonical").count() == 0
    assert {r.predicate_canonical for r in vocabulary.map_values(v, "predicate", reg.limit(0), "predicate_canonical").collect()} == {"unmatched"}


def test_vocabulary_ties_across_shards(spark):
    """Rivals and longer mentions count wherever their shard is."""
    reg = spark.createDataFrame([("net debt total",), ("net debts total",), ("debt",), ("total net debt ratio",), ("xylophone",), ("a rare thing",)], "n string")
    v = spark.createDataFrame([("net debtt total",), ("the total net debt ratio",), ("zlyophone",), ("xlyophone",), ("debt of the",), ("debt and xylophone",)], "v string")
    got = [sorted((r.v, r.n, r.how) for r in vocabulary.map_values(v, "v", reg, "n", entries_per_shard=size).collect()) for size in (1, 2, 100)]
    assert got[0] == got[1] == got[2]
    named = {a: b for a, b, _ in got[0]}
    assert named == {"net debtt total": "unmatched", "the total net debt ratio": "total net debt ratio", "zlyophone": "xylophone", "xlyophone": "xylophone", "debt of the": "debt", "debt and xylophone": "unmatched"}


def test_chosen_mention():
    text = " the total net debt of it "
    assert vocabulary.chosen(" the net debt ", [(4, 14, "net debt"), (8, 14, "debt")]) == "net debt"
    assert vocabulary.chosen(text, [(10, 20, "net debt")]) is None
    assert vocabulary.chosen(" debt equity ", [(0, 6, "debt"), (5, 13, "equity")]) is None


# 1 ---------------------------------------------------------------------------------------------------------------------


def planted(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16))
    for i in range(0, n, 4):
        x[i + 1] = x[i] + 0.15 * rng.standard_normal(16)
    x[10:14] = x[9]
    return x


def test_neighbours(spark, rows):
    x = planted(600, 6)
    data = [(f"{i:04d}", v.tolist()) for i, v in enumerate(x)]
    odd = [("null", None), ("short", [1.0] * 3), ("nan", [float("nan")] * 16), ("zero", [0.0] * 16), (None, x[0].tolist()), ("hole", [None] + [1.0] * 15)]
    df = spark.createDataFrame(data + data[:20] + odd, "fid string, v array<double>").withColumn("node", F.lit("clash"))
    got = set(rows(neighbours.similar_pairs(df, "fid", "v", 16)))
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    ids = [d[0] for d in data]
    want = set()
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:5]:
            if s[i, j] >= 0.9:
                want.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    assert len(got & want) >= 0.95 * len(want) and got <= want
    near = neighbours.most_similar(df, "fid", "v", 16, graph_k=14).groupBy("id").agg(F.collect_set("other").alias("o")).collect()
    hits = sum(s[int(r.id), int(o)] >= np.sort(s[int(r.id)])[-5] - 1e-6 for r in near for o in r.o)
    assert len(near) == 600 and hits >= 0.9 * 3000
    assert neighbours.similar_pairs(df.limit(0), "fid", "v", 16).count() == 0


def test_measured_recall(spark):
    x = planted(120, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "fid bigint, v array<double>")
    u = neighbours.unit(x.astype(np.float32))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = [(i, int(j), float(s[i, j])) for i in range(120) for j in np.argsort(-s[i])[:5]]
    whole = spark.createDataFrame(near, "id bigint, other bigint, s double")
    got = neighbours.measured_recall(df, whole, "fid", "v", 16, asked=50).first()
    assert got.n_asked == 50 and got.recall == 1.0
    assert neighbours.measured_recall(df, whole.filter("id % 2 = 0"), "fid", "v", 16, asked=120).first().recall == 0.5


def test_hot_bucket_is_split(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal(16) + 0.05 * rng.standard_normal((500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "fid bigint, v array<double>")
    old, neighbours.BUCKET_ROWS = neighbours.BUCKET_ROWS, 100
    try:
        near = neighbours.most_similar(df, "fid", "v", 16, graph_k=12).collect()
    finally:
        neighbours.BUCKET_ROWS = old
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    kth = np.sort(s, axis=1)[:, -5]
    assert len(near) == 2500 and sum(r.s >= kth[r.id] - 1e-6 for r in near) >= 0.9 * 2500


def test_large_group_of_near_equal_vectors():
    """Most of the true nearest of a group that is divided meet in some piece, though each meets few of the group."""
    rng = np.random.default_rng(12)
    x = (rng.standard_normal(64) + 0.17 * rng.standard_normal((40_000, 64))).astype(np.float32)
    u = neighbours.unit(x)
    splitter = neighbours.Splitter(64, 6, 7)
    one = np.zeros(len(x), np.int64)
    splitter.add({0: len(x)}, {0: u.mean(0)})
    asked = rng.choice(len(x), 300, replace=False)
    s = u[asked] @ u.T
    s[np.arange(300), asked] = -2
    near = np.argpartition(-s, 5, axis=1)[:, :5]
    met = np.zeros(near.shape, bool)
    sizes = []
    for _, rows, code, _ in splitter.pieces(u, iter([one] * 6)):
        whole = np.full(len(x), -1, np.int64)
        whole[rows] = code
        met |= whole[near] == whole[asked][:, None]
        sizes.append(np.unique(code, return_counts=True)[1].max())
    assert len(sizes) == 12 and max(sizes) <= neighbours.BUCKET_ROWS and met.mean() >= 0.9


def test_one_direction_is_divided_to_the_end(spark):
    """Vectors of one direction can't be told apart by any rotation; every row still gets its five."""
    base = np.arange(1, 17, dtype=np.float64)
    df = spark.createDataFrame([(i, (base * 2.0 ** (i % 20) * (1 + i // 20)).tolist()) for i in range(240)], "fid bigint, v array<double>")
    old, neighbours.BUCKET_ROWS = (neighbours.BUCKET_ROWS, neighbours.LEVELS), 50
    neighbours.LEVELS = 2
    try:
        near = neighbours.most_similar(df, "fid", "v", 16).collect()
    finally:
        neighbours.BUCKET_ROWS, neighbours.LEVELS = old
    assert len(near) == 1200 and all(r.s > 1 - 1e-6 for r in near)


def test_row_alone_in_its_buckets_has_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(16) + 0.01 * rng.standard_normal((200, 16))
    x[0] = -x[0]
    monkeypatch.setattr(neighbours, "DENSE", 20)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "fid bigint, v array<double>")
    near = neighbours.most_similar(df, "fid", "v", 16, graph_k=14).collect()
    assert sum(r.id == 0 for r in near) == 5 and len(near) == 1000


def test_nearest_of_hard_vectors(spark):
    """Random vectors, of which the nearest are hardly nearer than others."""
    rng = np.random.default_rng(14)
    x = rng.standard_normal((12_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "fid bigint, v array<float>").repartition(4)
    near = neighbours.most_similar(df, "fid", "v", 64, graph_k=14).filter("id % 40 = 0").collect()
    u = neighbours.unit(x)
    s = u[::40] @ u.T
    s[np.arange(300), np.arange(0, 12_000, 40)] = -2
    kth = np.sort(s, axis=1)[:, -5]
    assert len(near) == 1500 and sum(r.s >= kth[r.id // 40] - 1e-6 for r in near) >= 0.9 * 1500


def test_greedy_search(spark):
    x = planted(400, 9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "fid bigint, v array<double>")
    held = neighbours.usable_vectors(df, "fid", "v", 16)
    edges, vectors = neighbours.neighbour_graph(held, 16, k=10)
    asked = held.filter("id % 10 = 0").join(vectors.select("node", F.col("vec").alias("w")), "node").select(F.col("id").alias("qid"), F.col("w").alias("vec"))
    found = neighbours.greedy_search(asked, edges, vectors, 16)
    own = {r.id: r.node for r in held.select("id", "node").collect()}
    hits = sum(own[r.qid] == r.node for r in found.collect())
    assert hits >= 0.9 * 40


def test_search_gives_five_others(spark, tmp_path):
    from factloom.llm import queries

    x = np.random.default_rng(15).standard_normal((900, 64))
    x[3] = x[2]
    data = [(f"{i:04d}", v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(data, "fact_id string, embedding array<double>").write.parquet(f"{tmp_path}/fact_embeddings.parquet")
    got = queries.p1_search(spark, str(tmp_path)).collect()
    u = neighbours.unit(x.astype(np.float32))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    asked = {r.id for r in got}
    assert asked and len(got) == 5 * len(asked) and all(r.id != r.other for r in got)
    assert sum(r.similarity >= np.sort(s[int(r.id)])[-5] - 1e-6 for r in got) >= 0.9 * len(got)


def test_names_of_queries():
    from factloom.llm import queries, sql

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 7, 8, 9)} <= set(queries.queries()) and set(sql.oracle_sql()) <= set(queries.queries())
    assert all(re.match(r"p\d+_", n) for n in queries.queries())
