"""Variant spellings of names: each mention is linked to the entity it means, or to none.

Words of mentions and of entities' names are related by a pigeonhole segment join and banded edit distance, mentions and
entities by those words (``wordjoin``); then all words of both names decide. A mention of initials alone is looked up among
the initials of whole names, of which two entities a legal form are kept: more would only tie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.similar import IRREGULAR, align, banded_distance, edits_allowed, fold, word_similarity
from factloom.llm.wordjoin import candidates, near_words, spread
from factloom.session import materialise

# Forms of address, legal forms, and short forms of common English given names -------------------------------
TITLES = frozenset("mr mrs ms miss dr prof shri smt sir the".split())
LEGAL = {
    "llp": "llp", "l l p": "llp", "limited liability partnership": "llp",
    "plc": "plc", "p l c": "plc", "public limited company": "plc",
    "gmbh": "gmbh", "g m b h": "gmbh",
    "private limited": "pvt", "pvt limited": "pvt", "private ltd": "pvt", "pvt ltd": "pvt", "p ltd": "pvt", "p limited": "pvt",
    "limited": "ltd", "ltd": "ltd", "lmt": "ltd", "lmtd": "ltd", "pvt lmt": "pvt", "private lmt": "pvt", "p lmt": "pvt",
    "incorporated": "inc", "inc": "inc",
    "corporation": "corp", "corp": "corp", "corpn": "corp",
    "company": "co", "and co": "co", "and company": "co", "co": "co",
}
GIVEN_NAMES = """
abigail: abby gail | albert: al bert | alexander: alex al sandy sasha | alexandra: alex sandra sandy | alfred: alf fred | amanda: mandy | anastasia: ana stacy tasia nastya
andrew: andy drew | anthony: tony | barbara: barb babs | benjamin: ben benny benji | catherine: cathy cate kitty | charles: charlie chuck | charlotte: charlie lottie lotte | christina: chris tina
christopher: chris kit topher | cynthia: cindy | daniel: dan danny | david: dave davy | deborah: deb debbie | donald: don | dorothy: dot dolly | edward: ed eddie ned ted | eleanor: ellie nell nora
elizabeth: beth betty eliza liz lizzie lisa bess | emily: em millie | florence: flo | frances: fran | francis: frank | frederick: fred freddie freddy | gabriel: gabe | gabriela: gabi gaby gabby
george: georgie | gerald: gerry | gregory: greg | harold: harry | helen: nell | henry: hank harry | isabella: bella izzy | jacob: jake | jacqueline: jackie | james: jim jimmy jamie | jennifer: jen jenny
john: jack johnny | jonathan: jon | joseph: joe joey | josephine: jo josie | judith: judy | katherine: kate kathy katie kat kitty | kenneth: ken kenny | lawrence: larry | leonard: len lenny | leonardo: leo
louis: lou | madeleine: maddie | margaret: maggie meg peggy greta rita | martin: marty | mary: molly polly | matthew: matt | michael: mike mick | nathaniel: nate nat | nicholas: nick nicky | pamela: pam
patricia: pat patty tricia | patrick: pat paddy | peter: pete | philip: phil pip | rachel: rae | raymond: ray | rebecca: becky | richard: dick rich rick ricky | robert: bob bobby rob robbie bert
ronald: ron ronnie | samuel: sam | sarah: sally | stephen: steve | susan: sue susie | susannah: sue suki susie suzy zanna | theodore: theo teddy ted | theresa: terry tess | thomas: tom tommy
timothy: tim | victoria: vicky tori | vincent: vince vinny | virginia: ginny | walter: walt wally | william: bill billy will liam willy | zachary: zach
"""
#: Given name -> its short forms.
NICKNAMES: dict[str, list[str]] = {k.strip(): v.split() for line in GIVEN_NAMES.strip().splitlines() for k, v in (part.split(":") for part in line.split("|"))}
_INITIALS = re.compile(r"\b(?:[a-z]\.){2,}[a-z]?\b\.?")


def _respell(word: str, legal_forms: dict[str, str]) -> str:
    """A long legal form with a typo becomes the form."""
    if len(word) > 5 and word not in legal_forms:
        for form in ("limited", "private", "incorporated", "corporation", "company"):
            if banded_distance(word, form, 1) <= 1:
                return form
    return word


class NameParser:
    """Splits names into words and legal form; ``legal_forms`` maps each spelling of a form to its short one."""

    def __init__(self, legal_forms: dict[str, str]):
        self.legal_forms = legal_forms
        self.by_size = {n: {tuple(k.split()): v for k, v in legal_forms.items() if len(k.split()) == n} for n in (3, 2, 1)}
        self.parse = lru_cache(maxsize=1 << 16)(self._parse)

    def _parse(self, raw: str | None) -> tuple[list[str], str | None]:
        """(words without titles, remarks in brackets and legal form, legal form); the words are shared, not to be changed."""
        text = fold(raw or "")
        text = text.replace("m/s.", " ").replace("m/s ", " ")
        bare = re.sub(r"\([^()]{2,}\)|\[[^\[\]]{2,}\]", " ", text)
        text = bare if re.search(r"[a-z0-9]", bare) else text
        text = _INITIALS.sub(lambda m: " " + m.group().replace(".", "") + " ", text)
        text = re.sub(r"'s\b", " ", text).replace("&", " and ")
        text = re.sub(r"(?<=\w)['-](?=\w)", "", text)
        words = re.findall(r"[a-z0-9]+", text)
        words = words[:1] + [_respell(w, self.legal_forms) for w in words[1:]]
        legal = None
        for size, known in self.by_size.items():
            i = len(words) - size
            while i >= 0:
                if len(words) > size and (short := known.get(tuple(words[i : i + size]))):
                    legal = legal or short
                    words[i : i + size] = []
                i -= 1
        while len(words) > 1 and words[0] in TITLES:
            words = words[1:]
        if len(words) > 1 and words[-1] == "group":
            words = words[:-1]
        words = [w for w in words if w not in ("and", "of", "the")] or words
        return ["".join(words)] if len(words) > 1 and all(len(w) == 1 for w in words) else words, legal


def joined_words(words: list[str]) -> list[tuple[str, int, int]]:
    """The words, and neighbours joined into one (a word may have been broken by a space): (letters, from, to)."""
    one = [(w, i, i + 1) for i, w in enumerate(words)]
    two = [(words[i] + words[i + 1], i, i + 2) for i in range(len(words) - 1)]
    return one + two + ([("".join(words), 0, len(words))] if len(words) > 2 else [])


def _lists(column: pa.Array) -> Iterator[list[float]]:
    """The lists of a column of numbers, without an object a number in between."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False).tolist(), column.value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()
    return (values[s:e] for s, e in zip([0, *ends], ends))


def initials(words: list[str]) -> str:
    return "".join(w[0] for w in words)


class Scorer:
    """Decides between an entity's forms and a mention by the words both have, weighted by rarity."""

    def __init__(self, nicknames: dict[str, list[str]]):
        self.nicks = {n: [k for k, v in nicknames.items() if n in v] for n in {n for v in nicknames.values() for n in v}}
        self.longer = {k: [n for n in v if len(n) > 3] for k, v in nicknames.items()}
        self.similarity = lru_cache(maxsize=1 << 18)(self._similarity)

    def _similarity(self, q: str, t: str) -> float:
        s = word_similarity(q, t)
        for full in self.nicks.get(q, ()):
            s = max(s, 0.95 * word_similarity(full, t))
        if s == 0 and len(q) > 4 and any(banded_distance(q, nick, 1) <= 1 for nick in self.longer.get(t, ())):
            s = 0.7
        return s

    def score(self, query: list[str], loose: dict[str, float], form: list[str], weights: list[float]) -> float:
        """0..1: how far the mention is explained by the form; ``loose`` is what each word weighs where it is left unexplained."""
        best = 0.0
        for words in self._joins(query, form):
            pairs = align(words, form, self.similarity)
            got = {i: (s, j) for s, i, j in pairs}
            total = explained = 0.0
            for i, w in enumerate(words):
                if i in got:
                    s, j = got[i]
                    wt = weights[j] if len(w) > 1 else 1.0
                    total += wt
                    explained += wt * (0.75 + 0.25 * s)
                else:
                    total += loose[w]
            have = sum(weights[j] for _, _, j in pairs)
            need = sum(wt if len(t) > 1 else 0.5 for t, wt in zip(form, weights))
            cover_q, cover_e = explained / total if total else 0.0, have / need if need else 0.0
            best = max(best, cover_q * (0.75 + 0.25 * min(1.0, cover_e)))
        return best

    @staticmethod
    def _joins(query: list[str], form: list[str]) -> list[list[str]]:
        """The words as they are, and with a word broken in two put together where the form has it."""
        out = [query]
        for i in range(len(query) - 1):
            one = query[i] + query[i + 1]
            if any(banded_distance(one, t, edits_allowed(len(t))) <= edits_allowed(len(t)) for t in form if len(t) > 3):
                out.append(query[:i] + [one] + query[i + 2 :])
        return out


def link_names(
    mentions: DataFrame,
    mention_col: str,
    entities: DataFrame,
    id_col: str = "entity_id",
    name_col: str = "canonical_name",
    alias_col: str = "aliases",
    threshold: float = 0.8,
    margin: float = 0.01,
    nicknames: dict[str, list[str]] | None = None,
    legal_forms: dict[str, str] | None = None,
) -> DataFrame:
    """Each distinct mention that names an entity: ``mention_col, id_col, score``; two equally good entities are none.

    ``nicknames`` (given name -> short forms) and ``legal_forms`` (spelling -> short form) default to the lists above.
    Null and blank mentions and names link to nothing; entities given twice count once, an id with several names keeps them
    all; empty tables give an empty result. Mentions are made distinct first, then their words, so that neither a name nor a
    word that a third of all rows hold is looked up more than once; words that many entities share are looked up in pairs.
    A mention is found by a word spelt within the edits allowed, by a nickname or an abbreviation of three letters or more,
    by all its letters joined, or, if it is nothing else, by initials.
    """
    nicknames, legal_forms = NICKNAMES if nicknames is None else nicknames, LEGAL if legal_forms is None else legal_forms
    spellings = {k: list(v) for k, v in nicknames.items()}
    for short, full in IRREGULAR.items():
        spellings.setdefault(full, []).append(short)
    forms = entities.select(F.col(id_col).cast("string").alias("eid"), F.explode(F.concat(F.array(name_col), F.coalesce(alias_col, F.array().cast("array<string>")))).alias("form"))
    forms = forms.filter(F.col("eid").isNotNull() & F.col("form").isNotNull() & (F.trim("form") != "")).distinct()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = NameParser(legal_forms)
        for b in batches:
            got = [parser.parse(f) for f in b.column("form").to_pylist()]
            legal = pa.array([g[1] for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("eid"), b.column("fid"), pa.array([g[0] for g in got], pa.list_(pa.string())), legal], names=["eid", "fid", "parts", "legal"])

    parsed = forms.select("eid", F.xxhash64("form").alias("fid"), "form").mapInArrow(parse, "eid string, fid bigint, parts array<string>, legal string")
    parsed = materialise(parsed.filter(F.size("parts") > 0), "forms")
    whole = F.when(F.size("parts") > 1, F.array(F.array_join("parts", ""))).otherwise(F.array().cast("array<string>"))
    keyed = parsed.withColumn("words", F.array_distinct(F.concat("parts", whole)))
    counts = materialise(keyed.select("eid", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("df")), "word-counts")
    total = max(parsed.select("eid").distinct().count(), 2)
    weight = lambda df: F.log(1 + F.lit(float(total)) / df)
    each = parsed.select("eid", "fid", "legal", F.posexplode("parts").alias("i", "word")).join(counts, "word")
    part = F.struct("i", "word", weight(F.col("df")).alias("wt"))
    weighed = each.groupBy("eid", "fid", "legal").agg(F.array_sort(F.collect_list(part)).alias("p"), F.sum(F.when(F.length("word") > 1, weight(F.col("df"))).otherwise(0.5)).alias("need"))
    weighed = materialise(weighed, "weighed-forms")

    distinct = materialise(mentions.select(F.col(mention_col).alias("mention")).filter("mention is not null and trim(mention) <> ''").distinct(), "mentions")

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = NameParser(legal_forms)
        for b in batches:
            out = [(m, at, end, q) for m in b.column(0).to_pylist() for q, at, end in joined_words(parser.parse(m)[0])]
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["mention", "at", "end", "q"])

    parts = materialise(spread(distinct).mapInArrow(take_apart, "mention string, at int, end int, q string"), "mention-words")
    words = counts.join(parsed.select(F.explode("parts").alias("word")).distinct().withColumn("single", F.lit(True)), "word", "left")
    near = near_words(parts.select("q", (F.col("end") - F.col("at") == 1).alias("single")), words.select("word", F.coalesce("single", F.lit(False)).alias("single")), spellings, "near-names")
    by_q = near.join(counts, "word").groupBy("q").agg(F.collect_list(F.struct(F.col("word").alias("w"), "df")).alias("near"), F.min("df").alias("least"), F.max("df").alias("most"))
    own = counts.select(F.col("word").alias("q"), F.col("df").alias("own"))
    rarest = F.lit(1)
    loose = F.when(F.length("q") == 1, 0.7).otherwise(weight(F.coalesce("own", "most", rarest)))
    most = F.when(F.length("q") == 1, 1.0).when(F.length("q") == 2, weight(rarest)).otherwise(F.coalesce(weight(F.col("least")), F.lit(0.0)))
    token = F.struct("at", "end", "q", loose.alias("u"), most.alias("hi"), F.coalesce("near", F.array().cast("array<struct<w:string,df:bigint>>")).alias("near"))
    tokens = materialise(parts.join(by_q, "q", "left").join(own, "q", "left").groupBy(F.col("mention").alias("query")).agg(F.collect_list(token).alias("tokens")), "mention-tokens")

    by_word = candidates(tokens, keyed.select("eid", "fid", "words", "legal").join(weighed.select("eid", "fid", "need"), ["eid", "fid"]), 1 - threshold, "name-pairs")
    first = F.array_join(F.transform("parts", lambda w: F.substring(w, 1, 1)), "")
    short = parsed.filter(F.size("parts") > 1).select("eid", first.alias("q"), "legal").distinct()
    short = short.withColumn("_r", F.row_number().over(Window.partitionBy("q", "legal").orderBy("eid"))).filter("_r <= 2").select("q", "eid")
    alone = parts.groupBy("mention").agg(F.count_if(F.col("end") - F.col("at") == 1).alias("n"), F.min("q").alias("q")).filter("n = 1")
    by_initials = alone.join(short, "q").select(F.col("mention").alias("query"), "eid")
    pairs = materialise(by_word.unionByName(by_initials).distinct(), "candidates")

    any_legal = F.coalesce("legal", F.min("legal").over(Window.partitionBy("eid")))
    known = weighed.select("eid", F.array_join(F.transform("p", lambda x: x["word"]), " ").alias("form"), F.transform("p", lambda x: x["wt"]).alias("weights"), any_legal.alias("legal"))
    asked = tokens.select("query", F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(t["at"].alias("at"), t["end"].alias("end"), t["u"].alias("u")))), lambda t: t["u"]).alias("loose"))
    full = pairs.join(known, "eid").join(asked, "query").select("query", "eid", "form", "legal", "weights", "loose")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, parser = Scorer(nicknames), NameParser(legal_forms)
        for b in batches:
            scores = []
            rows = zip(*(b.column(c).to_pylist() for c in ("query", "form", "legal")), _lists(b.column("weights")), _lists(b.column("loose")))
            for m, form, form_legal, weights, loose in rows:
                q, legal = parser.parse(m)
                words = form.split(" ")
                same, other = bool(legal) and legal == form_legal, bool(legal and form_legal) and legal != form_legal
                s = scorer.score(q, {w: u for (w, _, _), u in zip(sorted(joined_words(q), key=lambda t: t[1:]), loose)}, words, weights)
                s += 0.005 * same - 0.06 * other
                if len(q) == 1 and len(words) > 1 and q[0] == initials(words):
                    s = max(s, 0.9 - 0.06 * other + 0.02 * same)
                scores.append(s)
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("eid"), pa.array(scores, pa.float64())], names=["mention", "eid", "score"])

    judged = spread(full).mapInArrow(judge, "mention string, eid string, score double").filter(F.col("score") >= threshold)
    judged = judged.groupBy("mention", "eid").agg(F.max("score").alias("score"))
    order = Window.partitionBy("mention").orderBy(F.desc("score"), F.desc("eid"))
    two = judged.withColumn("_r", F.row_number().over(order)).filter("_r <= 2")
    top = two.groupBy("mention").agg(F.max_by("eid", -F.col("_r")).alias("eid"), F.max("score").alias("score"), F.min("score").alias("next"), F.count("*").alias("n"))
    clear = (F.col("n") == 1) | (F.col("score") - F.col("next") >= margin)
    return top.filter(clear).select(F.col("mention").alias(mention_col), F.col("eid").cast(entities.schema[id_col].dataType).alias(id_col), "score")
