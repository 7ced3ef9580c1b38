"""DuckDB SQL for the core's queries that SQL can express."""

from __future__ import annotations

LATEST = "lf AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY created_at DESC NULLS LAST, confidence DESC NULLS LAST) = 1)"
FOLD = "lower(strip_accents({x}))"
CLEAN = r"trim(regexp_replace(translate(coalesce({x}, ''), '‘’‐‑‒–—―−' || chr(160) || chr(8199) || chr(8239), '''''-------   '), '\s+', ' ', 'g'))"


def clean(x: str) -> str:
    return CLEAN.format(x=x)


SCOPED = f"""{LATEST}, scoped AS (
  SELECT f.fact_id, f.doc_id, f.chunk_id, f.entity_id, f.predicate_canonical, f.value_type, f.unit_dimension, d.collection, CAST(v.embedding AS DOUBLE[]) AS e
  FROM lf f JOIN evidence ev ON ev.evidence_id = f.evidence_id AND ev.verified JOIN documents d ON d.doc_id = f.doc_id
  JOIN (SELECT DISTINCT ON (fact_id) fact_id, embedding FROM fact_embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) v ON v.fact_id = f.fact_id
)"""
BLOCK = """b.fact_id > a.fact_id AND b.collection = a.collection AND b.value_type = a.value_type AND b.chunk_id != a.chunk_id
  AND coalesce(a.unit_dimension = b.unit_dimension, true)
  AND (coalesce(a.entity_id = b.entity_id, false) OR coalesce(a.predicate_canonical = b.predicate_canonical, false))"""


def candidates(extra: str = "", tail: str = "") -> str:
    return f"""WITH {SCOPED}, pairs AS (
  SELECT a.fact_id AS fact_a, b.fact_id AS fact_b, a.predicate_canonical AS pa, b.predicate_canonical AS pb, a.doc_id AS doc_id, list_cosine_similarity(a.e, b.e) AS s
  FROM scoped a JOIN scoped b ON {BLOCK} {extra}
), near AS (SELECT * FROM pairs WHERE s >= 0.2 {tail}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fact_a ORDER BY s DESC, fact_b) AS ra, row_number() OVER (PARTITION BY fact_b ORDER BY s DESC, fact_a) AS rb FROM near
), best AS (SELECT * FROM ranked WHERE ra <= 12 OR rb <= 12)"""


VIEW = f"""WITH {LATEST}, v AS (
  SELECT f.*, d.collection, d.title AS document_title, d.as_of_date, ev.quote, ev.verified, ev.match_score, ev.match_method, ev.char_start AS evidence_char_start
  FROM lf f JOIN documents d ON d.doc_id = f.doc_id LEFT JOIN evidence ev ON ev.evidence_id = f.evidence_id
)"""
FILTERED = """FROM v WHERE verified AND lower(coalesce(period_label_raw, '')) LIKE '%fy%' AND (lower(coalesce(subject_raw, '')) LIKE '%freight%'
  OR lower(coalesce(predicate_canonical, '')) LIKE '%freight%' OR lower(coalesce(value_raw, '')) LIKE '%freight%' OR lower(coalesce(quote, '')) LIKE '%freight%')"""
LISTING = f"""WITH {LATEST} SELECT d.doc_id, d.collection, d.filename, d.status, d.n_pages,
  (SELECT count(DISTINCT chunk_id) FROM chunks c WHERE c.doc_id = d.doc_id) AS n_chunks,
  (SELECT count(*) FROM lf f WHERE f.doc_id = d.doc_id) AS n_facts,
  (SELECT count(*) FROM lf f JOIN evidence ev ON ev.evidence_id = f.evidence_id WHERE f.doc_id = d.doc_id AND ev.verified) AS n_verified
FROM documents d"""
SNAKE = r"regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def predicate(x: str) -> str:
    return rf"regexp_replace(regexp_replace({SNAKE.format(x=clean(x))}, '^(the|a|an)_', ''), '_(of|for|in|at|on|the)$', '')"


def subject(x: str) -> str:
    from factloom.functions.tables import LEGAL_SUFFIXES

    t = f"lower(strip_accents({clean(x)}))"
    t = f"regexp_replace({t}, '[\"''`]', '', 'g')"
    t = rf"regexp_replace({t}, '\([^)]*\)', ' ', 'g')"
    t = f"regexp_replace({t}, '[^a-z0-9&/ .-]+', ' ', 'g')"
    for form in LEGAL_SUFFIXES:
        escaped = form.replace(".", r"\.")
        t = rf"regexp_replace({t}, '(?:,|\s)\s*{escaped}\.?\s*$', ' ')"
    t = rf"regexp_replace(regexp_replace({t}, '^the\s+', ''), '[.\-]+$', ' ')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def kept(table: str, key: str) -> str:
    return f"SELECT '{table}' AS metric, count(*) AS n FROM {key}"


PERIOD = r"""
SELECT a.relation, count(*) AS n FROM (
  SELECT CASE WHEN (s1 <= s2 AND e2 <= e1) OR (s2 <= s1 AND e1 <= e2) THEN 'nested' WHEN s1 <= e2 AND s2 <= e1 THEN 'overlapping' ELSE 'disjoint' END AS relation
  FROM (SELECT a.period_start AS s1, a.period_end AS e1, b.period_start AS s2, b.period_end AS e2
        FROM (SELECT DISTINCT entity_id, predicate_canonical, period_start, period_end FROM lf WHERE entity_id IS NOT NULL AND predicate_canonical IS NOT NULL AND period_start IS NOT NULL) a
        JOIN (SELECT DISTINCT entity_id, predicate_canonical, period_start, period_end FROM lf WHERE entity_id IS NOT NULL AND predicate_canonical IS NOT NULL AND period_start IS NOT NULL) b
          USING (entity_id, predicate_canonical)
        WHERE a.period_start < b.period_start OR (a.period_start = b.period_start AND a.period_end < b.period_end))
) a GROUP BY 1
"""

# Quantities: alias, name, dimension, factor as rows, the fields read in order ------------------------------------------------


def _quantities() -> str:
    from factloom.functions.tables import CURRENCY_ALIASES, MAGNITUDES, UNITS

    def word(a: str) -> str:
        body = "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in a)
        return ("(^|[^a-z_])" if a[0].isalpha() else "") + body + ("($|[^a-z_])" if a[-1].isalpha() else "")

    lit = lambda s: "'" + s.replace("'", "''") + "'"
    units = ", ".join(f"({lit(word(a))}, {len(a)}, {lit(n)}, {lit(d)}, {f!r})" for al, n, d, f in UNITS for a in {*al, n} if a not in ("m", "x"))
    scales = ", ".join(f"({lit(word(a))}, {len(a)}, {f!r})" for a, f in MAGNITUDES.items() if a not in ("m", "b", "k"))
    money = ", ".join(f"({lit(word(a))}, {len(a)}, {lit(c)})" for a, c in CURRENCY_ALIASES.items())
    fields = "unnest(['value_raw', 'unit_raw', 'magnitude_label', 'unit_canonical', 'currency']) AS field, unnest([1, 2, 3, 4, 5]) AS pos, unnest([value_raw, unit_raw, magnitude_label, unit_canonical, currency]) AS raw"
    return rf"""
u(p, n, unit, dimension, factor) AS (VALUES {units}, ('^m$', 1, 'm', 'length', 1.0)),
s(p, n, factor) AS (VALUES {scales}),
c(p, n, code) AS (VALUES {money}),
f AS (SELECT DISTINCT fact_id, map_extract_value(qualifiers, 'measure') AS measure, value_raw, unit_raw, magnitude_label, unit_canonical, currency FROM facts WHERE value_type = 'numeric'),
cell AS (SELECT * EXCLUDE (raw), trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS t FROM (SELECT f.*, {fields} FROM f) WHERE raw IS NOT NULL),
text AS (SELECT DISTINCT field, pos, t FROM cell),
tu AS (SELECT text.pos, text.t, arg_max(unit, u.n) AS unit, arg_max(dimension, u.n) AS dimension, arg_max(factor, u.n) AS factor FROM text JOIN u ON regexp_matches(text.t, u.p) GROUP BY 1, 2),
ts AS (SELECT text.pos, text.t, arg_max(factor, s.n) AS factor FROM text JOIN s ON regexp_matches(text.t, s.p) WHERE text.pos <= 3 GROUP BY 1, 2),
tc AS (SELECT text.pos, text.t, arg_max(code, c.n) AS code FROM text JOIN c ON regexp_matches(text.t, c.p) GROUP BY 1, 2),
q AS (
  SELECT fact_id, measure, value_raw, unit_raw, magnitude_label, unit_canonical, currency, arg_min(tu.unit, cell.pos) FILTER (tu.unit IS NOT NULL) AS unit, arg_min(tu.dimension, cell.pos) FILTER (tu.unit IS NOT NULL) AS dimension,
         arg_min(tu.factor, cell.pos) FILTER (tu.unit IS NOT NULL) AS uf, arg_min(ts.factor, cell.pos) FILTER (ts.factor IS NOT NULL) AS sf, arg_min(tc.code, cell.pos) FILTER (tc.code IS NOT NULL) AS code
  FROM cell LEFT JOIN tu USING (pos, t) LEFT JOIN ts USING (pos, t) LEFT JOIN tc USING (pos, t) GROUP BY ALL
),
num AS (
  SELECT *, CASE WHEN regexp_matches(value_raw, '^[^0-9(]*\(\s*[-+]?[0-9.,]+\s*\)') AND v > 0 THEN -v ELSE v END AS x
  FROM (SELECT *, TRY_CAST(replace(regexp_extract(value_raw, '[-+]?[0-9][0-9,]*(\.[0-9]+)?'), ',', '') AS DOUBLE) AS v FROM q)
),
qty AS (
  SELECT fact_id, measure, CASE WHEN code IS NOT NULL AND coalesce(dimension, '') <> 'ratio' THEN 'currency' ELSE dimension END AS dimension,
         x * CASE WHEN dimension = 'ratio' THEN uf WHEN code IS NOT NULL THEN coalesce(sf, 1) ELSE coalesce(uf, 1) * coalesce(sf, 1) END AS quantity
  FROM num
)"""


P6_FOUND = (
    "WITH "
    + _quantities()
    + """
SELECT DISTINCT a.fact_id AS fact_a, b.fact_id AS fact_b FROM qty a JOIN qty b ON a.measure = b.measure AND a.fact_id < b.fact_id
WHERE abs(a.quantity - b.quantity) <= greatest(abs(a.quantity), abs(b.quantity)) * 0.005
"""
)


P6_COMMON = "WITH " + _quantities() + " SELECT DISTINCT fact_id, dimension, round(quantity, 3) AS quantity FROM qty"

RUNS = """runs AS (SELECT CAST(event_id AS VARCHAR) AS run_id, CAST(user_id + 1000 AS BIGINT) AS doc_id, event_type AS stage, ts AS started_at, CAST(event_id % 5 AS INTEGER) AS n_items,
  CAST(event_id % 3 AS INTEGER) AS n_calls, CAST(floor(value) AS INTEGER) AS tokens_in, 1 AS tokens_out, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS n_errors,
  TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS hits FROM events)"""
LINKS = f"""WITH {LATEST}, links AS (SELECT * FROM (SELECT predicate_canonical AS link_id, min(fact_id) AS fact_a, max(fact_id) AS fact_b, round(avg(confidence), 4) AS confidence
  FROM lf WHERE predicate_canonical IS NOT NULL GROUP BY 1) WHERE fact_a <> fact_b), sides AS (SELECT *, fact_a AS fact_id, fact_b AS other FROM links UNION ALL SELECT *, fact_b, fact_a FROM links)"""


def _scope_rows() -> str:
    from factloom.functions.tables import SCOPE_ALIASES

    return ", ".join(f"('{a}', '{n}')" for a, n in SCOPE_ALIASES.items())


def _scopes(of: str, key: str) -> str:
    """``key, tags``: the sorted distinct tags of each row of ``of``, in the shared vocabulary."""
    snake = SNAKE.format(x="bare")
    return f"""s(alias, tag) AS (VALUES {_scope_rows()}), tags AS (
  SELECT DISTINCT {key}, coalesce(x.tag, y.tag, {snake}) AS tag FROM (
    SELECT {key}, regexp_replace(lower({clean('t')}), '^[ .,]+|[ .,]+$', '', 'g') AS bare FROM (SELECT {key}, unnest(scope_tags) AS t FROM {of})) r
  LEFT JOIN s x ON x.alias = bare LEFT JOIN s y ON y.alias = translate(bare, '_', ' ') WHERE bare <> ''
), scoped_tags AS (SELECT {key}, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags WHERE tag <> '' GROUP BY 1)"""


def _addresses() -> str:
    from factloom.functions.subject import ADDRESS_WORDS

    words = ", ".join(f"('{a.upper()}', '{n.upper()}')" for a, n in ADDRESS_WORDS.items())
    return rf"""WITH w(short, long) AS (VALUES {words}), a AS (SELECT DISTINCT value_raw, upper({clean('value_raw')}) AS t FROM facts WHERE predicate_canonical = 'registered_address'),
p AS (SELECT *, regexp_extract(t, '\b(\d{{6}}|\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]?\s*\d[A-Z]{{2}})\b', 1) AS code FROM a),
word AS (SELECT value_raw, unnest(string_split(regexp_replace(CASE WHEN code = '' THEN t ELSE replace(t, code, ' ') END, '[^A-Z0-9 ]+', ' ', 'g'), ' ')) AS x, unnest(range(length(t) + 2)) AS i FROM p)
SELECT p.value_raw, coalesce(n, '') AS normalized, nullif(regexp_replace(code, '\s+', '', 'g'), '') AS postal_code FROM p
LEFT JOIN (SELECT value_raw, string_agg(coalesce(long, x), ' ' ORDER BY i) AS n FROM word LEFT JOIN w ON short = x WHERE x <> '' GROUP BY 1) USING (value_raw)"""


NUMBERS = rf"""WITH r AS (SELECT DISTINCT value_raw, {clean('value_raw')} AS t FROM facts WHERE value_type = 'numeric'),
a AS (SELECT *, '(?:^|\s)(?:~|approx\.?|approximately|about|around|roughly|nearly|almost|circa|c\.)\s*' AS p1, '(?:^|\s)(?:over|more than|greater than|above|at least|in excess of|\+|>=|>)\s*' AS p2,
  '(?:^|\s)(?:under|less than|below|up to|at most|fewer than|<=|<)\s*' AS p3 FROM r),
b AS (SELECT value_raw, t, CASE WHEN regexp_matches(t, p3, 'i') THEN 'upper_bound' WHEN regexp_matches(t, p2, 'i') THEN 'lower_bound' WHEN regexp_matches(t, p1, 'i') THEN 'approximate' END AS bound,
  regexp_replace(regexp_replace(regexp_replace(t, p1, ' ', 'gi'), p2, ' ', 'gi'), p3, ' ', 'gi') AS rest FROM a),
n AS (SELECT *, TRY_CAST(replace(regexp_extract(rest, '(\d[\d,]*(?:\.\d+)?)\s*(?:-|to|and)\s*(\d[\d,]*(?:\.\d+)?)', 1, 'i'), ',', '') AS DOUBLE) AS low,
  TRY_CAST(replace(regexp_extract(rest, '(\d[\d,]*(?:\.\d+)?)\s*(?:-|to|and)\s*(\d[\d,]*(?:\.\d+)?)', 2, 'i'), ',', '') AS DOUBLE) AS high,
  TRY_CAST(regexp_replace(regexp_extract(rest, '[-+]?\d[\d,٬]*(?:\.\d+)?'), '[,٬+]', '', 'g') AS DOUBLE) AS one,
  regexp_extract(t, '[-+]?\d[\d,٬]*(?:\.\d+)?') AS token,
  regexp_matches(lower(t), '\bf\.?y\.?\s*''?\d{{2}}|\bq[1-4]\s*[:\-]?\s*(?:of\s*)?(?:f\.?y|c\.?y|\d{{4}})|\b(?:c\.?y\.?|calendar\s+year)\s*\d{{4}}\b')
    OR (regexp_matches(lower(t), '\b\d{{4}}\s*[-/]\s*\d{{2}}\b') AND NOT regexp_matches(lower(t), '\d\s*[-/]\s*\d+\s*(?:%|per cent)')) AS period FROM b),
v AS (SELECT *, coalesce(high > low AND NOT period, false) AS ranged, regexp_matches(t, '^\s*(?:[$€£¥₹]|(?:rs|inr|usd|eur|gbp|jpy|aud|cad)\.?)?\s*\(\s*[-+]?[\d.,]', 'i') AS paren FROM n)
SELECT value_raw, CASE WHEN ranged THEN (low + high) / 2 WHEN paren AND one > 0 THEN -one ELSE one END AS value, bound, coalesce(NOT ranged AND paren AND one > 0, false) AS negative,
  CASE WHEN token <> '' THEN pow(10.0, -length(regexp_extract(token, '\.(\d+)$', 1))) END AS place FROM v"""


PERIODS = r"""
WITH l AS (SELECT DISTINCT period_label_raw AS label FROM facts),
p AS (SELECT label, TRY_CAST(regexp_extract(label, '^[QH](\d) ', 1) AS INTEGER) AS part, CASE WHEN label LIKE 'Q%' THEN 3 ELSE 6 END AS width, TRY_CAST(regexp_extract(label, '^(\d+)M ', 1) AS INTEGER) AS months,
  regexp_replace(label, '^(?:[QH]\d|\d+M) ', '') AS base,
  CAST(coalesce(try_strptime(label, 'as at %B %d, %Y'), try_strptime(label, 'as of %d %B %Y')) AS DATE) AS day, CAST(try_strptime('1 ' || label, '%d %B %Y') AS DATE) AS month FROM l),
y AS (SELECT *, regexp_matches(base, '^FY|^\d{4}-\d{2}$') AS fiscal,
  CASE WHEN regexp_matches(base, '^FY\d{2}$') THEN 2000 + CAST(right(base, 2) AS INTEGER) WHEN regexp_matches(base, '-\d{2}$') THEN CAST(regexp_extract(base, '(\d{4})-', 1) AS INTEGER) + 1
    ELSE TRY_CAST(regexp_extract(base, '^(?:CY)?(\d{4})$', 1) AS INTEGER) END AS ends FROM p),
b AS (SELECT *, CASE WHEN fiscal THEN make_date(ends - 1, 4, 1) ELSE make_date(ends, 1, 1) END AS first FROM y)
SELECT label AS period_label_raw,
  CASE WHEN day IS NOT NULL THEN day WHEN month IS NOT NULL THEN month WHEN part IS NOT NULL THEN CAST(first + to_months((part - 1) * width) AS DATE) ELSE first END AS start,
  CASE WHEN day IS NOT NULL THEN day WHEN month IS NOT NULL THEN last_day(month) WHEN part IS NOT NULL THEN last_day(CAST(first + to_months(part * width - 1) AS DATE))
    WHEN months IS NOT NULL THEN last_day(CAST(first + to_months(months - 1) AS DATE)) WHEN first IS NOT NULL THEN last_day(CAST(first + to_months(11) AS DATE)) END AS "end",
  CASE WHEN day IS NOT NULL THEN 'point_in_time' WHEN month IS NOT NULL THEN 'calendar' WHEN first IS NULL THEN 'unknown' WHEN fiscal THEN 'fiscal_in' ELSE 'calendar' END AS basis
FROM b
"""


def _normalized() -> str:
    """Number, scale, unit and currency of each value by the tables' names: the longest name that stands in the text, of equal ones the first."""
    from factloom.functions.tables import COMPOUND_MAGNITUDES, LETTER_MAGNITUDES, MAGNITUDES, UNITS

    lit = lambda x: "'" + x.replace("'", "''") + "'"

    def pattern(a: str) -> str:
        if a in LETTER_MAGNITUDES:
            return rf"\d\s{{0,4}}{a}\b"
        body = "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in a)
        return f"(?:^|[^a-z]){body}(?:$|[^a-z])" if a.isalpha() else body

    known: dict[str, tuple] = {}
    for aliases, name, dim, factor in UNITS:
        for a in aliases:
            known.setdefault(a, (name, dim, float(factor)))
    units = ", ".join(f"({lit(a)}, {lit(pattern(a))}, {lit(n)}, {lit(d)}, CAST({f!r} AS DOUBLE))" for a, (n, d, f) in known.items())
    scales = ", ".join(f"({lit(a)}, {lit(pattern(a))}, CAST({f!r} AS DOUBLE), 0)" for a, f in MAGNITUDES.items())
    pairs = ", ".join(f"({lit(a)}, {lit(chr(92) + 'b' + a + chr(92) + 'b')}, CAST({f!r} AS DOUBLE), 1)" for a, f in COMPOUND_MAGNITUDES.items())
    numbers = NUMBERS.replace("WITH r AS (SELECT DISTINCT value_raw,", "r AS (SELECT DISTINCT value_raw,").replace(" FROM facts WHERE value_type = 'numeric')", " FROM facts)")
    head, _, tail = numbers.rpartition("SELECT value_raw, CASE WHEN ranged")
    return rf"""WITH unit(alias, p, name, dim, factor) AS (VALUES {units}), scale(alias, p, factor, two) AS (VALUES {scales}, {pairs}),
f AS (SELECT DISTINCT value_raw, unit_raw, value_type, lower({clean("concat_ws(' ', nullif(value_raw, ''), nullif(unit_raw, ''))")}) AS vu, lower({clean("concat_ws(' ', nullif(unit_raw, ''), nullif(value_raw, ''))")}) AS uv FROM facts),
{head.rstrip()}, num AS (SELECT value_raw, CASE WHEN ranged{tail.replace("FROM v", ", CASE WHEN ranged THEN low END AS range_low, CASE WHEN ranged THEN high END AS range_high FROM v")}),
vus AS (SELECT DISTINCT vu FROM f), uvs AS (SELECT DISTINCT uv FROM f),
m AS (SELECT vu, arg_max(alias, [two, length(alias), -strpos(vu, alias)]) AS label, arg_max(factor, [two, length(alias), -strpos(vu, alias)]) AS factor FROM vus JOIN scale ON regexp_matches(vu, p) GROUP BY 1),
u AS (SELECT uv, arg_max({{'n': name, 'd': dim, 'f': unit.factor}}, [length(alias), -strpos(uv, alias)]) AS u FROM uvs JOIN unit ON regexp_matches(uv, p) GROUP BY 1),
x AS (
  SELECT f.*, num.* EXCLUDE (value_raw), coalesce(m.factor, 1.0) AS factor, m.label, u.u, CASE
    WHEN regexp_matches(vu, '₹|\brs\.?(\b|$)|\brs\.|\binr\b|\brupees?\b') THEN 'INR' WHEN regexp_matches(vu, '\bus\s*\$|\busd\b|\bus\s*dollars?\b|\$') THEN 'USD' WHEN regexp_matches(vu, '€|\beur\b') THEN 'EUR'
    WHEN regexp_matches(vu, '£|\bgbp\b') THEN 'GBP' WHEN regexp_matches(vu, '¥|\bjpy\b') THEN 'JPY' END AS currency
  FROM f LEFT JOIN num ON num.value_raw IS NOT DISTINCT FROM f.value_raw LEFT JOIN m USING (vu) LEFT JOIN u USING (uv)
), y AS (SELECT *, currency IS NOT NULL AND NOT regexp_matches(vu, '%|per cent|percent') AS paid, value_type = 'numeric' AS is_n FROM x),
z AS (SELECT *, CASE WHEN paid THEN currency ELSE u.n END AS unit_name, CASE WHEN paid THEN 'currency' ELSE u.d END AS dim, CASE WHEN paid THEN 1.0 ELSE coalesce(u.f, 1.0) END AS base FROM y),
k AS (SELECT *, coalesce(dim = 'ratio', false) AS ratio, CASE WHEN coalesce(dim = 'ratio', false) THEN 1.0 ELSE factor END AS by_ FROM z)
SELECT value_raw, unit_raw, value_type, CASE WHEN is_n THEN value * by_ END AS value_num, {clean('value_raw')} AS value_text, unit_name AS unit_canonical, dim AS unit_dimension, CAST(base AS DOUBLE) AS unit_to_base,
  CASE WHEN is_n THEN CAST(by_ AS DOUBLE) END AS magnitude, CASE WHEN is_n AND NOT ratio THEN label END AS magnitude_label, currency, CASE WHEN is_n THEN bound END AS bound,
  CASE WHEN is_n THEN range_low * by_ END AS range_low, CASE WHEN is_n THEN range_high * by_ END AS range_high FROM k"""


def oracle_sql() -> dict[str, str]:
    from factloom.plans import literals

    q: dict[str, str] = literals.oracle_sql() | {"p6_found": P6_FOUND, "p6_common": P6_COMMON, "addresses": _addresses(), "parsed_numbers": NUMBERS, "parsed_periods": PERIODS, "normalized_values": _normalized()}
    q["scope_tags"] = f"WITH {_scopes('facts', 'fact_id')} SELECT coalesce(tags, '') AS tags, count(*) AS n FROM (SELECT DISTINCT fact_id FROM facts) LEFT JOIN scoped_tags USING (fact_id) GROUP BY 1"
    q["export_documents"] = """SELECT CAST(to_json({'doc_id': doc_id, 'filename': filename, 'collection': collection, 'n_pages': n_pages}) AS VARCHAR) AS json FROM documents"""
    q["document_status"] = f"""WITH {LATEST}, {RUNS} SELECT d.doc_id, d.status, (SELECT count(*) FROM lf WHERE lf.doc_id = d.doc_id) AS n_facts,
  (SELECT count(*) FROM lf JOIN evidence e ON e.evidence_id = lf.evidence_id AND e.verified WHERE lf.doc_id = d.doc_id) AS n_verified, coalesce(r.n, 0) AS n_runs, coalesce(r.s, 0) AS n_stages,
  coalesce(r.e, 0) AS n_errors, coalesce(r.i, 0) AS n_items
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT stage) AS s, CAST(sum(n_errors) AS BIGINT) AS e, CAST(sum(n_items) AS BIGINT) AS i FROM runs GROUP BY 1) r ON r.doc_id = d.doc_id"""
    q["document_runs"] = f"WITH {RUNS} SELECT run_id, stage, n_items, n_errors, hits FROM runs WHERE doc_id = 1005"
    q["recent_runs"] = f"WITH {RUNS} SELECT run_id, stage, n_calls, filename FROM (SELECT * FROM runs ORDER BY started_at DESC, run_id LIMIT 60) LEFT JOIN documents USING (doc_id)"
    q["run_totals"] = f"WITH {RUNS} SELECT CAST(sum(n_calls) AS BIGINT) AS n_calls, CAST(coalesce(sum(hits), 0) AS BIGINT) AS cache_hits, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM runs"
    q["decoded_notes"] = "SELECT coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, count(*) AS n FROM events GROUP BY 1"
    view = "JOIN documents d ON d.doc_id = f.doc_id"
    q["fact_detail"] = f"""{LINKS} SELECT link_id, sides.fact_id, other, value_raw, title FROM sides
LEFT JOIN (SELECT f.fact_id, value_raw, title FROM lf f {view}) c ON c.fact_id = other
WHERE sides.fact_id IN (SELECT example_fact_id FROM predicate_registry UNION SELECT fact_a FROM links)"""
    q["links_for_fact"] = f"{LINKS} SELECT link_id, fact_a, fact_b, confidence FROM links WHERE fact_a = (SELECT min(fact_a) FROM links) OR fact_b = (SELECT min(fact_a) FROM links)"
    q["built_fact_ids"] = f"""WITH rows_ AS (SELECT *, row_number() OVER () AS rn FROM (SELECT f.doc_id, f.chunk_id, subject_raw, predicate, value_raw, period_label_raw, scope_tags, quote FROM facts f JOIN evidence USING (evidence_id))),
{_scopes('rows_', 'rn')}, ids AS (
  SELECT substr(sha256(doc_id || chr(0) || chunk_id || chr(0) || {subject('subject_raw')} || chr(0) || {predicate('predicate')} || chr(0) || lower({clean('value_raw')}) || chr(0) || lower({clean('period_label_raw')})
    || chr(0) || coalesce(tags, '')), 1, 32) AS fact_id, quote FROM rows_ LEFT JOIN scoped_tags USING (rn))
SELECT DISTINCT fact_id, substr(sha256(fact_id || chr(0) || coalesce(quote, '')), 1, 32) AS evidence_id FROM ids"""
    q["facts_kept"] = f"WITH {LATEST} SELECT chunk_id, fact_id FROM lf WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY fact_id) <= 2"
    q["dates_of_documents"] = "SELECT doc_id, TRY_CAST(regexp_extract(coalesce(CAST(as_of_date AS VARCHAR), title, filename), '^\\d{4}-\\d{2}-\\d{2}') AS DATE) AS day FROM documents"
    q["document_exists"] = "SELECT doc_id, doc_id IN (SELECT doc_id FROM documents) AS found FROM (SELECT doc_id FROM facts UNION SELECT -i FROM range(5) t(i))"
    q["cache_put"] = """WITH old AS (SELECT DISTINCT sha256(canonical_string) AS h FROM fact_embeddings WHERE canonical_string IS NOT NULL),
n AS (SELECT DISTINCT sha256(coalesce(subject_canonical, '') || ' | ' || coalesce(predicate_canonical, '') || ' | ' || coalesce(period_label_raw, '') || ' | ' || coalesce(array_to_string(list_sort(scope_tags), ','), '')) AS h FROM facts)
SELECT 'new' AS model, count(*) AS n, min(h) AS least FROM n UNION ALL SELECT 'old', count(*), min(h) FROM old WHERE h NOT IN (SELECT h FROM n)"""
    q["count_blocked_pairs"] = f"WITH {SCOPED} SELECT count(*) AS n_pairs FROM scoped a JOIN scoped b ON {BLOCK}"
    q["funnel_candidates"] = candidates() + " SELECT fact_a, fact_b, round(s, 6) AS similarity FROM best"
    new = "AND (a.doc_id IN (SELECT doc_id FROM documents WHERE parser_version = 'parse-2') OR b.doc_id IN (SELECT doc_id FROM documents WHERE parser_version = 'parse-2'))"
    q["incremental_candidates"] = candidates(new) + " SELECT fact_a, fact_b, round(s, 6) AS similarity FROM best"
    q["unlinked_candidates"] = (
        candidates()
        + """, open AS (SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM best l WHERE l.fact_a = n.fact_a AND l.fact_b = n.fact_b AND l.pa = l.pb)),
again AS (SELECT *, row_number() OVER (PARTITION BY fact_a ORDER BY s DESC, fact_b) AS r1, row_number() OVER (PARTITION BY fact_b ORDER BY s DESC, fact_a) AS r2 FROM open)
SELECT fact_a, fact_b, round(s, 6) AS similarity FROM again WHERE r1 <= 12 OR r2 <= 12"""
    )
    q["residue_budget"] = candidates() + " SELECT fact_a, fact_b, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, fact_a, fact_b) > 2 AS deferred FROM best"
    q["period_relation"] = f"WITH {LATEST} {PERIOD}"
    q["search_facts"] = f"{VIEW} SELECT fact_id, doc_id, subject_raw, value_raw, confidence {FILTERED} ORDER BY confidence DESC NULLS LAST, fact_id LIMIT 100 OFFSET 20"
    q["search_facts_count"] = f"{VIEW} SELECT count(*) AS n {FILTERED}"
    q["active_facts"] = f"{VIEW} SELECT fact_id, evidence_id, match_score, evidence_char_start FROM v WHERE verified"
    q["quarantine"] = f"{VIEW} SELECT fact_id, evidence_id, match_method FROM v WHERE NOT verified"
    q["quarantined_facts"] = f"{VIEW} SELECT fact_id, match_score FROM v WHERE NOT verified ORDER BY match_score DESC NULLS LAST, fact_id LIMIT 200"
    q["facts_by_ids"] = f"{VIEW} SELECT fact_id, predicate_canonical, document_title, as_of_date FROM v WHERE fact_id IN (SELECT example_fact_id FROM predicate_registry)"
    q["get_document"] = "SELECT doc_id, filename, collection, n_pages FROM documents WHERE doc_id = 1002"
    q["list_documents"] = LISTING
    q["failure_modes"] = f"""{VIEW} SELECT CASE WHEN contains(quote, chr(10)) THEN 'multi_line_stitch' WHEN contains(quote, '|') THEN 'table_row' WHEN length(quote) < 40 THEN 'very_short_quote' ELSE 'other' END AS mode,
  count(*) AS n FROM v WHERE NOT verified GROUP BY 1"""
    q["stats_totals"] = " UNION ALL ".join(kept(t, t) for t in ("documents", "pages", "chunks", "facts", "evidence", "entities", "predicate_registry"))
    q["verification_rate"] = f"""WITH {LATEST} SELECT count(*) AS n_facts, count(*) FILTER (ev.verified) AS n_verified, count(*) - count(*) FILTER (ev.verified) AS n_quarantined,
  coalesce(round(count(*) FILTER (ev.verified) / nullif(count(*), 0), 4), 0) AS verification_rate FROM lf f LEFT JOIN evidence ev ON ev.evidence_id = f.evidence_id"""
    q["daily_growth"] = f"WITH {LATEST} SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM lf GROUP BY 1"
    q["stage_rollup"] = "SELECT event_type AS stage, round(sum(value), 2) AS seconds, count(*) AS n_runs, CAST(coalesce(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS noted FROM events GROUP BY 1"
    q["collections"] = "SELECT DISTINCT collection FROM documents WHERE collection IS NOT NULL"
    q["collection_rollup"] = f"""SELECT collection, count(*) AS n_documents, CAST(sum(n_pages) AS BIGINT) AS n_pages, CAST(sum(n_chunks) AS BIGINT) AS n_chunks, CAST(sum(n_facts) AS BIGINT) AS n_facts,
  CAST(sum(n_verified) AS BIGINT) AS n_verified FROM ({LISTING}) GROUP BY 1"""
    first = "arg_min({c}, {{'c': created_at, 'f': fact_id}})"
    c = lambda name: first.format(c=f"{{'v': {name}}}") + "['v']"
    q["register_facts"] = f"""WITH {LATEST}, g AS (
  SELECT predicate_canonical, {c('value_type')} AS expected_value_type, {c('unit_dimension')} AS expected_unit_dimension, {c('fact_id')} AS example_fact_id,
    {c('doc_id')} AS first_seen_doc_id, {c('subject_raw')} AS sr, {c('value_raw')} AS vr, count(*) AS n_facts FROM lf WHERE predicate_canonical IS NOT NULL GROUP BY 1)
SELECT predicate_canonical, substr(concat_ws(' ', 'First seen as', sr, vr), 1, 300) AS description, expected_value_type, expected_unit_dimension, example_fact_id, first_seen_doc_id, n_facts FROM g"""
    q["recount_predicates"] = f"WITH {LATEST} SELECT predicate_canonical, coalesce((SELECT count(*) FROM lf f WHERE f.predicate_canonical = r.predicate_canonical), 0) AS n_facts FROM predicate_registry r"
    q["bump_predicates"] = f"""WITH inc AS (SELECT {predicate('predicate')} AS predicate_canonical, count(*) AS k FROM facts WHERE predicate IS NOT NULL GROUP BY 1)
SELECT predicate_canonical, CAST(coalesce(n_facts, 0) + coalesce(k, 0) AS BIGINT) AS n_facts FROM predicate_registry FULL JOIN inc USING (predicate_canonical)"""
    q["top_predicates"] = "SELECT predicate_canonical, n_facts FROM predicate_registry ORDER BY n_facts DESC, predicate_canonical LIMIT 40"
    q["vocabulary_hint"] = """SELECT string_agg('- ' || predicate_canonical || coalesce(' (' || expected_unit_dimension || ')', ''), chr(10) ORDER BY n_facts DESC, predicate_canonical) AS hint
FROM (SELECT * FROM predicate_registry ORDER BY n_facts DESC, predicate_canonical LIMIT 40)"""
    q["upsert_facts"] = """WITH f AS (SELECT fact_id, value_raw, confidence, created_at, extractor_version FROM facts),
n AS (SELECT * FROM f WHERE extractor_version = 'extract-3' QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY created_at DESC, confidence DESC) = 1)
SELECT * FROM n UNION ALL SELECT * FROM f WHERE fact_id NOT IN (SELECT fact_id FROM n) QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY created_at DESC, confidence DESC) = 1"""
    q["replace_chunks"] = """WITH r AS (SELECT DISTINCT chunk_id, doc_id, text FROM chunks), d AS (SELECT doc_id FROM documents WHERE n_pages > 1)
SELECT chunk_id, doc_id FROM r WHERE doc_id NOT IN (SELECT doc_id FROM d) OR length(text) > 500"""
    q["cascade_delete"] = f"""WITH {LATEST}, d AS (SELECT doc_id FROM documents WHERE doc_type = 'survey'), gone AS (SELECT fact_id FROM facts SEMI JOIN d USING (doc_id)),
l AS (SELECT min(fact_id) AS a, max(fact_id) AS b FROM lf GROUP BY predicate_canonical)
SELECT 'links' AS metric, count(*) AS n FROM l WHERE a NOT IN (SELECT fact_id FROM gone) AND b NOT IN (SELECT fact_id FROM gone)
UNION ALL SELECT 'embeddings', count(*) FROM fact_embeddings WHERE fact_id NOT IN (SELECT fact_id FROM gone)
UNION ALL SELECT 'evidence', count(*) FROM evidence WHERE fact_id NOT IN (SELECT fact_id FROM gone)
UNION ALL SELECT 'facts', count(*) FROM facts WHERE doc_id NOT IN (SELECT doc_id FROM d)"""
    q["update_documents"] = "SELECT doc_id, coalesce(title, substr(string_split(text, chr(10))[1], 1, 60)) AS title, status FROM documents"
    q["cache_misses"] = """SELECT DISTINCT canonical_string FROM (SELECT coalesce(subject_canonical, '') || ' | ' || coalesce(predicate_canonical, '') || ' | ' || coalesce(period_label_raw, '') || ' | ' ||
  coalesce(array_to_string(list_sort(scope_tags), ','), '') AS canonical_string FROM facts) WHERE canonical_string NOT IN (SELECT canonical_string FROM fact_embeddings WHERE canonical_string IS NOT NULL)"""
    q["event_windows"] = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"
    q["page_offsets"] = """SELECT doc_id, page_index, CAST(coalesce(sum(n + 2) OVER w, 0) AS BIGINT) AS char_start, CAST(coalesce(sum(n + 2) OVER w, 0) + n AS BIGINT) AS char_end
FROM (SELECT DISTINCT ON (doc_id, page_index) doc_id, page_index, length(coalesce(text, '')) AS n FROM pages) WINDOW w AS (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    q["resolve_pages"] = """SELECT e.evidence_id, min(p.page_index) AS page_index FROM evidence e LEFT JOIN (SELECT DISTINCT doc_id, page_index, char_start, char_start + length(text) AS char_end FROM pages) p
  ON p.doc_id = e.doc_id AND e.char_start BETWEEN p.char_start AND p.char_end WHERE e.char_start IS NOT NULL GROUP BY 1"""
    q["chunk_ids"] = r"SELECT DISTINCT chunk_id, doc_id, substr(sha256(doc_id || chr(0) || lower(trim(regexp_replace(text, '\s+', ' ', 'g')))), 1, 32) AS made FROM chunks"
    q["boilerplate_chunks"] = r"""WITH c AS (SELECT DISTINCT chunk_id, lower(kind) AS kind, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM chunks),
m AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS ls, length(regexp_replace(t, '[^\p{L}]', '', 'g')) / greatest(length(t), 1) AS alpha, length(regexp_replace(t, '[^\p{Nd}]', '', 'g')) / greatest(length(t), 1) AS digit FROM c)
SELECT DISTINCT chunk_id, CASE WHEN length(t) < 120 THEN 'too_short'
  WHEN len(list_filter(ls, lambda x: regexp_matches(x, '\.{4,}|\s\.\s\.\s\.'))) / greatest(len(ls), 1) > 0.3 THEN 'table_of_contents'
  WHEN alpha < 0.35 AND NOT coalesce(kind = 'table', false) THEN 'low_alpha_ratio'
  WHEN regexp_matches(lower(t), 'safe harbour|safe harbor|disclaimer|forward-looking statement|forward looking statement|no representation or warranty|table of contents|this page has been intentionally left blank|all rights reserved') AND digit < 0.01 THEN 'boilerplate_notice' END AS reason FROM m"""
    q["slide_decks"] = "SELECT doc_id, median(length(coalesce(text, ''))) <= 1800 AS is_slides FROM (SELECT DISTINCT doc_id, page_index, text FROM pages) GROUP BY 1"
    q["sparse_pages"] = """SELECT DISTINCT doc_id, page_index, CASE WHEN n = 0 THEN 'image_only_page' ELSE 'empty_page' END AS warning
FROM (SELECT doc_id, page_index, length(trim(coalesce(text_plain, text, ''))) AS n FROM pages) WHERE n < 300"""
    q["canonical_texts"] = r"""WITH p AS (SELECT DISTINCT doc_id, page_index, text, text_plain, length(regexp_replace(coalesce(text_plain, ''), '[^\p{L}\p{N}]', '', 'g')) AS b,
  length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) AS a FROM pages), k AS (SELECT *, text IS NOT NULL AND CASE WHEN b = 0 THEN true ELSE a / b >= 0.95 END AS keep FROM p)
SELECT DISTINCT doc_id, page_index, length(CASE WHEN keep THEN text ELSE coalesce(text_plain, '') END) AS n, CASE WHEN keep THEN 'markdown' ELSE 'plain+tables' END AS source FROM k"""
    q["verify_exact"] = """SELECT DISTINCT evidence_id, CAST(instr(text, trim(quote)) - 1 AS BIGINT) AS char_start, CAST(instr(text, trim(quote)) - 1 + length(trim(quote)) AS BIGINT) AS char_end
FROM evidence JOIN documents USING (doc_id) WHERE length(trim(quote)) >= 8 AND contains(text, trim(quote))"""
    q["canonical_subjects"] = f"SELECT DISTINCT subject_raw, {subject('subject_raw')} AS canonical FROM facts"
    q["canonical_predicates"] = f"SELECT DISTINCT predicate, {predicate('predicate')} AS canonical FROM facts"
    q["currencies"] = r"""SELECT DISTINCT value_raw, unit_raw, CASE
  WHEN regexp_matches(b, '₹|\brs\.?(\b|$)|\brs\.|\binr\b|\brupees?\b') THEN 'INR' WHEN regexp_matches(b, '\bus\s*\$|\busd\b|\bus\s*dollars?\b|\$') THEN 'USD' WHEN regexp_matches(b, '€|\beur\b') THEN 'EUR'
  WHEN regexp_matches(b, '£|\bgbp\b') THEN 'GBP' WHEN regexp_matches(b, '¥|\bjpy\b') THEN 'JPY' END AS currency
FROM (SELECT value_raw, unit_raw, lower(coalesce(value_raw, '') || ' ' || coalesce(unit_raw, '')) AS b FROM facts)"""
    q["exact_entities"] = f"""WITH e AS (SELECT DISTINCT ON (entity_id) * FROM entities),
n AS (SELECT {subject('canonical_name')} AS name, min(entity_id) AS entity_id FROM e GROUP BY 1), a AS (SELECT {subject('x')} AS name, min(entity_id) AS entity_id FROM (SELECT entity_id, unnest(aliases) AS x FROM e) GROUP BY 1),
s AS (SELECT DISTINCT {subject('subject_raw')} AS name FROM facts)
SELECT name, entity_id, 'exact' AS method FROM s JOIN n USING (name) WHERE name <> '' UNION ALL SELECT name, entity_id, 'alias' FROM s JOIN a USING (name) WHERE name <> '' AND name NOT IN (SELECT name FROM n)"""
    return q
