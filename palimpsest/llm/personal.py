"""Personal information in free text, found by bootstrapped contextual extraction.

1. Every text is read for candidates: spans that by their form may be an email
   address, a number of some length, a street address or a pair of names. Some
   forms leave no doubt (``name@host.tld``, an international telephone number,
   a listed given name before a capitalised word in a sentence about a person):
   these are the seeds.
2. Candidates and the patterns around them (words to the left, words to the
   right, form, given name, end of the family name) make a bipartite graph.
   Spark scores it in rounds: a pattern is worth the mean of its instances, an
   instance the best of its patterns. Seeds induce patterns, good patterns
   promote unseen instances, these induce further patterns. A pattern whose
   instances are mostly unlabelled (order numbers, versions, places) stays low.
3. The patterns of enough support go back over the texts and decide for each
   candidate, now also for spellings that only a known pattern can tell from
   ordinary words (lower case names, street names).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import materialize, small_enough

ROUNDS = 3
#: Given names that are sent to every executor, at most.
MOST_NAMES = 1_000_000
#: Distinct instances that a pattern needs.
SUPPORT = 3
#: Patterns that are sent to every executor, at most; more are joined to the texts that have them.
MOST_PATTERNS = 200_000

TYPES = ("email", "phone", "id_number", "address", "name")

#: Words that are capitalised but no part of a name.
_NOT_NAMES = set(
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "project session date the a an i we you he she it they my your his her our their this that these those if what when where which who why how since because although after before during every each for from in on at of to by with and or but nor so as is are was were be been do does did no not yes sure great good noted nobody just quick oh actually note also please thanks hello hi dear dr mr mrs ms prof sir lake grant room row seat bus ticket invoice order street road avenue lane court close way rise terrace flat apt".split()
)
_TITLE = re.compile(r"^(?:dr|mr|mrs|ms|mx|prof|sir|herr|frau|mme|sr|sra)\.?$", re.I)
_DIGIT_WORD = "zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple"

_AT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s)"
_DOT = r"(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s|\.)"
_MAIL = re.compile(rf"(?<![\w.+-])(?P<local>\w[\w.+%-]*)(?P<at>{_AT})(?P<host>[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:{_DOT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*{_DOT}[a-z]{{2,}})(?![\w@])", re.I)
_NUMBER = re.compile(r"(?<![\w@#])(?:\+|\()?[A-Za-z]{0,3}[-/]?\d(?:[\dA-Za-z]|[ .\-/](?=[\dA-Za-z(])|\) ?(?=\d)|\((?=\d))*(?<=[\dA-Za-z])")
_GROUP = re.compile(r"[A-Za-z]*\d[\dA-Za-z]*|[A-Za-z]+")
_SPELLED = re.compile(rf"\b(?:{_DIGIT_WORD})(?:[ -](?:{_DIGIT_WORD})){{5,}}\b", re.I)
_TYPE = r"(?:street|str|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|way|close|court|ct|place|pl|square|sq|rise|terrace|row|gardens|crescent|grove|hill|walk|mews|parade|parkway)"
_FLAT = r"(?:(?:flat|apt|apartment|unit|suite|room)\.?\s?\d+(?:[a-z]\b)?)"
_UNIT = rf"(?:(?:,\s?|\s)(?:{_FLAT}|#\s?\d+\w?))?"
_WORD = r"(?:[NSEW]\.|St\.|[^\W\d_][\w'’-]*)"
_STREET = re.compile(rf"(?<![\w.,:-])(?P<flat>{_FLAT},?\s)?(?P<no>\d{{1,5}}[a-z]?) (?P<name>(?:{_WORD} ){{1,3}})(?P<type>{_TYPE})\b{_UNIT}", re.I)
_GERMAN = re.compile(rf"(?<!\w)(?P<name>[^\W\d_]{{3,}})(?P<type>weg|straße|strasse|str\.|gasse|allee|platz|ufer|laan|straat)\s(?P<no>\d{{1,4}}[a-z]?)\b{_UNIT}", re.I)
_ROMANCE = re.compile(rf"(?<![\w.,:-])(?P<no>\d{{1,4}}(?:\s?(?:bis|ter)\b|[a-z]\b)?),?\s(?P<type>rue|avenue|boulevard|chemin|place|impasse|via|calle)\s(?P<name>(?:(?:de|du|des|la|le|les|del|della)\s|d['’]|l['’])*[^\W\d_](?:[\w'’-]*\w)?){_UNIT}", re.I)
_STREET_STOP = set("the of a an in on at to for from and or is it was are with by as my your this that then than into minutes hours days weeks months years grams litres pages euros kilometres metres entries labels letters visitors boxes stops per each every long late".split())
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_])|-(?=[^\W\d_]))*\.?")
_BREAK = re.compile(r"[.!?]\s+|\n+|^\s*(?:user|assistant|system):\s*")
_RIGHT_BREAK = re.compile(r"[.!?](?:\s|$)|\n")


def _masked(w: str, first: bool) -> str:
    if any(c.isdigit() for c in w):
        return "0"
    return "X" if not first and w[0].isupper() and not w == "I" else w.lower()


def left_of(text: str, start: int) -> str:
    """Up to three words before a span, within its sentence."""
    head = text[max(0, start - 60) : start]
    cut = 0
    for m in _BREAK.finditer(head):
        if not _TITLE.match(head[: m.start() + 1].rsplit(" ", 1)[-1]):
            cut = m.end()
    whole = cut > 0 or start <= 60
    words = re.findall(r"\w[\w'’]*", head[cut:])
    if len(words) > 3:
        return " ".join(_masked(w, False) for w in words[-3:])
    return " ".join((["^"] if whole else []) + [_masked(w, whole and k == 0) for k, w in enumerate(words)])


def right_of(text: str, end: int) -> str:
    """Up to two words after a span, within its sentence."""
    tail = text[end : end + 40]
    m = _RIGHT_BREAK.search(tail)
    words = re.findall(r"\w[\w'’]*", tail[: m.start()] if m else tail)
    return " ".join([_masked(w, False) for w in words[:2]] + (["$"] if len(words) < 2 else []))


@dataclass
class Candidate:
    family: str  # mail, number, street or name
    start: int
    end: int
    key: str  # the instance, in one spelling
    seed: str | None
    extra: tuple[str, ...]  # patterns other than left and right
    plain: bool = True  # form that ordinary words hardly have


@dataclass
class Lexicon:
    """What is known before the texts are read, and later what was learned."""

    given: set[str] = field(default_factory=set)
    score: dict[str, tuple[str, float]] = field(default_factory=dict)
    ends: set[str] = field(default_factory=set)
    #: ``pattern, type, score`` where the scores are too many to be sent; ``score`` is empty then.
    table: DataFrame | None = None

    def of(self, pattern: str, kind: str) -> float:
        s = self.score.get(f"{kind}|{pattern}")
        return s[1] if s else 0.0


#: Words shortly before a number that say what it is, and those of numbers that are no person's.
_ID_WORDS = re.compile(r"\b(?:passport|ssn|social security|tax (?:number|id|no)|identity|national id|licen[cs]e|id card|document number|with id)\b[^.!?\n]{0,25}$", re.I)
_PHONE_WORDS = re.compile(r"\b(?:call(?: me)?(?: on)?|phone(?: number)?(?: is)?|mobile|text|ring|dial|fax|tel)\b[^.!?\n]{0,20}$", re.I)
_OTHER_WORDS = re.compile(r"\b(?:order|ticket|invoice|version|isbn|tracking|serial|article|build|request|part)\b[^.!?\n]{0,25}$", re.I)


def _shape(s: str) -> str:
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", s))


def _numbers(text: str, out: list[Candidate]) -> None:
    for m in _NUMBER.finditer(text):
        s = m.group()
        start, end = m.span()
        digits = sum(c.isdigit() for c in s)
        if digits < 6:
            continue
        # Words next to a number are no part of it: groups of letters only count where short and in capitals.
        groups = list(_GROUP.finditer(s))
        first, last = 0, len(groups) - 1
        good = lambda g: any(c.isdigit() for c in g.group()) or (len(g.group()) <= 3 and (g.start() > 0 and s[g.start() - 1] in "-/" or g.end() < len(s) and s[g.end()] in "-/"))
        while first <= last and not good(groups[first]):
            first += 1
        run = first
        while run + 1 <= last and good(groups[run + 1]):
            run += 1
        if run < first:
            continue
        lo, hi = groups[first].start(), groups[run].end()
        if first == 0 and s[0] in "+(":
            lo = 0
        s, start, end = s[lo:hi], start + lo, start + hi
        if sum(c.isdigit() for c in s) < 6 or any(len(g.group()) > 3 and g.group().isalpha() for g in _GROUP.finditer(s)):
            continue
        if s.startswith("(") and ")" not in s:
            s, start = s[1:], start + 1
        digits = sum(c.isdigit() for c in s)
        letters = sum(c.isalpha() for c in s)
        seed = None
        if not letters and (re.match(r"\+\d", s) and digits >= 9 or re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", s)):
            seed = "phone"
        elif re.fullmatch(r"\d{3}-\d{2}-\d{4}|[A-Z]\d{8,9}", s):
            seed = "id_number"
        elif re.fullmatch(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", s) or digits > 19:
            continue
        else:
            head = text[max(0, start - 40) : start]
            if not _OTHER_WORDS.search(head):
                seed = "id_number" if _ID_WORDS.search(head) else "phone" if not letters and _PHONE_WORDS.search(head) else None
        out.append(Candidate("number", start, end, re.sub(r"[^0-9A-Za-z]", "", s).upper(), seed, (f"S {_shape(s)}",)))
    for m in _SPELLED.finditer(text):
        out.append(Candidate("number", *m.span(), re.sub(r"\W+", " ", m.group().lower()), None, ("S spelled",)))


def _mails(text: str, out: list[Candidate]) -> None:
    low = text.lower()
    if "@" not in low and "at" not in low:
        return
    for m in _MAIL.finditer(text):
        at, host = m["at"].strip().lower(), m["host"].lower()
        local = m["local"].rstrip(".")
        plain = m["at"] == "@" and "dot" not in re.split(r"[\s()\[\]]+", host)
        worded = at == "at"
        if worded and not re.search(r"\sdot\s", host) and not re.search(r"[\d.+_-]", local):
            continue
        key = re.sub(r"\s+|[()\[\]{}]", "", local.lower()) + "@" + re.sub(_DOT, ".", host)
        out.append(Candidate("mail", m.start(), m.end(), key, "email" if plain or not worded else None, (f"S {'@' if plain else at}",)))


def _streets(text: str, out: list[Candidate]) -> None:
    for m in _STREET.finditer(text):
        words = m["name"].split()
        # The nearest number and street name: leading ordinary words end the span.
        if any(w.lower() in _STREET_STOP for w in words):
            continue
        end, start = m.end(), m.start()
        capital = all(w[0].isupper() for w in words) and m["type"][0].isupper()
        name = words[-1].lower()
        out.append(Candidate("street", start, end, re.sub(r"\W+", " ", text[start:end].lower()), "address" if capital and not text[start:end].isupper() else None, (f"G {name}", f"S number {m['type'].lower()}"), capital))
    for m in _GERMAN.finditer(text):
        capital = m["name"][0].isupper()
        out.append(Candidate("street", m.start(), m.end(), re.sub(r"\W+", " ", m.group().lower()), "address" if capital else None, (f"G {m['name'].lower()}", f"S {m['type'].lower()} number"), capital))
    for m in _ROMANCE.finditer(text):
        name = re.split(r"[\s'’]", m["name"])[-1]
        capital = name[0].isupper()
        out.append(Candidate("street", m.start(), m.end(), re.sub(r"\W+", " ", m.group().lower()), "address" if capital else None, (f"G {name.lower()}", f"S number {m['type'].lower()} name"), capital))


def _case(w: str) -> str:
    w = w.replace("-", "").replace("'", "").replace("’", "")
    return "U" if w.isupper() and len(w) > 1 else "C" if w[0].isupper() and w[1:].islower() else "l" if w.islower() else "m"


def _names(text: str, given: set[str], out: list[Candidate], loose: set[str] | None) -> None:
    toks = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    n = len(toks)
    for k in range(n - 1):
        a0, a1, a = toks[k]
        if a[-1] == "." or len(a) < 3 or a.lower() in _NOT_NAMES:
            continue
        # An initial between the two.
        j = k + 1
        between = text[a1 : toks[j][0]]
        b0, b1, b = toks[j]
        if between == " " and len(b) == 2 and b[1] == "." and b[0].isupper() and j + 1 < n and text[b1 : toks[j + 1][0]] == " ":
            j += 1
            b0, b1, b = toks[j]
        elif between == " " and len(b) == 1 and b.isupper() and b != "I" and j + 1 < n and text[b1 : toks[j + 1][0]] == " " and a.lower() in given:
            j += 1
            b0, b1, b = toks[j]
        elif between not in (" ", ", "):
            continue
        if b[-1] == ".":
            b, b1 = b[:-1], b1 - 1
        if len(b) < 3 or b.lower() in _NOT_NAMES:
            continue
        al, bl = a.lower(), b.lower()
        ca, cb = _case(a), _case(b)
        same = ca == cb or (ca in "Cm" and cb in "Cm")
        if not same:
            continue
        if between == ", ":
            if bl not in given or (ca == "l" and loose is None):
                continue
            g, f = bl, al
        elif bl in given and al not in given:
            g, f = bl, al
        else:
            g, f = al, bl
        listed = g in given
        if not listed and ca in "lU" and not (loose and f[-4:] in loose):
            continue
        if ca == "l" and loose is None:
            continue
        if al in given and bl in given:
            continue
        last = f.split("-")[-1]
        seed = "name" if listed and ca in "Cm" and between == " " and g == al else None
        out.append(Candidate("name", a0, b1, f"{g} {f}", seed, (f"G {g}", f"F {last[-4:]}"), ca in "Cm"))


def candidates(text: str, given: set[str], loose: set[str] | None = None) -> list[Candidate]:
    """Spans that may be personal information.

    loose: ends of family names known by now; given, names in lower case and
    of unlisted given names count too.
    """
    out: list[Candidate] = []
    _mails(text, out)
    if any(c.isdigit() for c in text):
        _numbers(text, out)
        _streets(text, out)
    else:
        for m in _SPELLED.finditer(text):
            out.append(Candidate("number", *m.span(), re.sub(r"\W+", " ", m.group().lower()), None, ("S spelled",)))
    _names(text, given, out, loose)
    return out


#: Sides of a span without a word, which speak for nothing.
_BARE = {"L ", "L ^", "R ", "R $", "M ", "M ^"}


def patterns_of(text: str, c: Candidate) -> list[str]:
    """Left and right words, where there are any, and the candidate's own patterns."""
    left = left_of(text, c.start)
    near = [f"L {left}", f"R {right_of(text, c.end)}"]
    if c.family in ("name", "street"):
        near.append(_two(left))
    return [p for p in near if p not in _BARE] + [*c.extra]


def _two(left: str) -> str:
    """The last two words to the left, which names and addresses share over more sentences."""
    return f"M {' '.join(left.split(' ')[-2:])}"


_OCCURRENCES = "family string, inst string, seed string, pattern string"


def occurrences(texts: DataFrame, given: list[str]) -> DataFrame:
    """``family, inst, seed, pattern``: the edges of the graph, not yet distinct."""
    names = set(given)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                for c in candidates(t, names):
                    rows += [(c.family, c.key, c.seed, p) for p in patterns_of(t, c)]
            yield pd.DataFrame(list(dict.fromkeys(rows)), columns=["family", "inst", "seed", "pattern"])

    return texts.select("text").mapInPandas(run, _OCCURRENCES)


#: What an instance nobody labelled yet weighs against the labelled ones of its pattern.
UNKNOWN = 0.25
#: Weight of a kind of pattern when it speaks for an instance.
_WEIGHT = {"L": 1.0, "M": 0.8, "R": 0.9, "S": 0.7, "G": 0.8, "F": 0.8}


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``family, pattern, type, score, support`` after ``rounds`` of the walk.

    ``edges`` are distinct (family, inst, pattern) with ``seed``. Both steps of
    a round are aggregates with map-side combine over the edges; a pattern that
    a third of all instances share is summed up in parts like any other.
    """
    seeds = edges.where("seed IS NOT NULL").select("family", "inst", F.col("seed").alias("type")).distinct().withColumn("s", F.lit(1.0))
    links = materialize(edges.select("family", "inst", "pattern").distinct(), "links")
    support = links.groupBy("family", "pattern").agg(F.count(F.lit(1)).alias("support"))
    support = materialize(support.where(F.col("support") >= SUPPORT), "support")
    seeds = materialize(seeds, "seeds")
    inst, out = seeds, None
    weight = F.create_map(*[x for k, v in _WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    for r in range(rounds):
        summed = links.join(inst, ["family", "inst"]).groupBy("family", "pattern", "type").agg(F.sum("s").alias("sum"))
        # Types compete for a pattern; what has no type yet speaks against it, but less.
        labelled = summed.groupBy("family", "pattern").agg(F.sum("sum").alias("labelled"))
        all_ = F.col("labelled") + UNKNOWN * F.greatest(F.lit(0.0), F.col("support") - F.col("labelled")) + UNKNOWN
        out = summed.join(labelled, ["family", "pattern"]).join(support, ["family", "pattern"]).select("family", "pattern", "type", (F.col("sum") / all_).alias("score"), "support")
        out = materialize(out.where("score >= 0.05"), "scores")
        if r + 1 < rounds:
            said = links.join(out.select("family", "pattern", "type", "score"), ["family", "pattern"])
            best = said.groupBy("family", "inst", "type").agg(F.max(F.col("score") * weight[F.substring("pattern", 1, 1)]).alias("s"))
            both = best.where("s >= 0.3").unionByName(seeds)
            inst = materialize(both.groupBy("family", "inst", "type").agg(F.max("s").alias("s")), "instances")
    return out


def learn(texts: DataFrame, given: DataFrame, rounds: int = ROUNDS) -> Lexicon:
    """Patterns learned from all texts, starting from seeds and the given names.

    Every pattern of at least ``SUPPORT`` distinct instances is kept, whatever
    the size of the data. Up to ``MOST_PATTERNS`` scores are sent to the
    executors, more stay a table. Learned given names and ends of family names
    always are sent, as the texts cannot be read without them.
    """
    listed = given.where("trim(given_name) <> ''").select(F.lower(F.trim("given_name")).alias("n")).distinct()
    if not small_enough(listed, MOST_NAMES):
        raise ValueError(f"more than {MOST_NAMES} given names")
    names = sorted(r["n"] for r in listed.collect())
    edges = materialize(occurrences(texts, names), "edges")
    known = score_graph(edges, rounds).where((F.col("support") >= SUPPORT) & (F.col("score") >= 0.15)).select("pattern", "type", "score")
    lex = Lexicon(set(names))
    # Given names and ends of family names that only the graph knows.
    for r in known.where("type = 'name' AND score >= 0.5 AND substring(pattern, 1, 2) IN ('G ', 'F ')").select("pattern").distinct().collect():
        (lex.given if r["pattern"][0] == "G" else lex.ends).add(r["pattern"][2:])
    if small_enough(known, MOST_PATTERNS):
        lex.score = _scores(known.collect())
    else:
        lex.table = known
    return lex


def _scores(rows) -> dict[str, tuple[str, float]]:
    return {f"{r['type']}|{r['pattern']}": (r["type"], r["score"]) for r in rows}


def _with_scores(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """Adds ``known``: of the lexicon's table what the candidates of each text ask for, null where that is nothing.

    Each distinct text asks once, under a digest.
    """
    shared = texts.sparkSession.sparkContext.broadcast(replace(lex, table=None))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, p) for d, t in zip(b["digest"], b["text"]) for p in {p for c in candidates(t, shared.value.given, shared.value.ends) for p in patterns_of(t, c)}]
            yield pd.DataFrame(rows, columns=["digest", "pattern"])

    keyed = texts.withColumn("digest", F.sha2("text", 256))
    asks = keyed.select("digest", "text").mapInPandas(asked, "digest string, pattern string").distinct()
    found = asks.join(lex.table, "pattern").groupBy("digest").agg(F.collect_list(F.struct("pattern", "type", "score")).alias("known"))
    return keyed.join(found, "digest", "left").drop("digest")


def _span_reader(texts: DataFrame, lex: Lexicon):
    """The texts, and a function of a batch of them that gives the spans of each text."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(replace(lex, table=None))
    if lex.table is None:
        return texts, lambda b: [spans(t, shared.value) for t in b["text"]]
    return _with_scores(texts, lex), lambda b: [spans(t, replace(shared.value, score={} if k is None else _scores(k))) for t, k in zip(b["text"], b["known"])]


def decide(text: str, c: Candidate, lex: Lexicon) -> str | None:
    """The type of a candidate, or None."""
    left, right = f"L {left_of(text, c.start)}", f"R {right_of(text, c.end)}"  # bare sides have no score
    if c.family == "mail":
        if c.seed:
            return "email"
        return "email" if "dot" in text[c.start : c.end].lower().split() or max(lex.of(left, "email"), lex.of(right, "email")) >= 0.3 else None
    if c.family == "number":
        # Form and surroundings speak together; a form that nothing is known of leaves it to the surroundings.
        form = {kind: lex.of(c.extra[0], kind) for kind in ("phone", "id_number")}
        best = (0.0, None)
        for kind, f in form.items():
            near = max(lex.of(left, kind), 0.9 * lex.of(right, kind))
            total = 0.6 * f + 0.4 * near if any(form.values()) else near
            best = max(best, (total + 0.3 * (c.seed == kind), kind), key=lambda x: x[0])
        return best[1] if best[0] >= 0.42 else c.seed
    if c.family == "street":
        near = max(lex.of(left, "address"), lex.of(right, "address"), 0.8 * lex.of(_two(left[2:]), "address"))
        known = lex.of(c.extra[0], "address")
        return "address" if c.plain or known >= 0.4 or near >= 0.4 else None
    near = max(lex.of(left, "name"), 0.9 * lex.of(right, "name"), 0.8 * lex.of(_two(left[2:]), "name"))
    first, last = lex.of(c.extra[0], "name"), lex.of(c.extra[1], "name")
    if c.key.split(" ")[0] in lex.given:
        first = max(first, 0.6)
    if c.plain and c.seed:
        return "name"
    if c.plain:
        return "name" if (near >= 0.5 and (first >= 0.3 or last >= 0.3)) or (first >= 0.5 and last >= 0.4) else None
    return "name" if (first >= 0.5 and (last >= 0.4 or near >= 0.5)) or (near >= 0.6 and last >= 0.4) else None


def spans(text: str, lex: Lexicon) -> list[tuple[int, int, str]]:
    """``start, end, type`` of what is found; of overlapping spans the longer stays, emails and addresses first."""
    rank = {"email": 0, "address": 1, "phone": 2, "id_number": 2, "name": 3}
    found = []
    for c in candidates(text, lex.given, lex.ends):
        kind = decide(text, c, lex)
        if kind:
            found.append((rank[kind], -(c.end - c.start), c.start, c.end, kind))
    kept: list[tuple[int, int, str]] = []
    for _, _, a, b, kind in sorted(found):
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept)


def find(texts: DataFrame, lex: Lexicon, keys: list[str]) -> DataFrame:
    """Each distinct item of a text: the key columns, ``pii_type, found_text``."""
    ordered, read = _span_reader(texts.select(*keys, "text"), lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, kinds, said = [], [], []
            for k, (t, got) in enumerate(zip(b["text"], read(b))):
                for kind, s in dict.fromkeys((kind, t[x:y]) for x, y, kind in got):
                    at.append(k), kinds.append(kind), said.append(s)
            yield b.iloc[at][keys].reset_index(drop=True).assign(pii_type=pd.Series(kinds, dtype=object), found_text=pd.Series(said, dtype=object))  # typed, as a batch may have no item

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in keys)
    return ordered.mapInPandas(run, f"{schema}, pii_type string, found_text string").distinct()


def redact(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """The texts with typed placeholders such as ``[EMAIL]``; all else is unchanged."""
    columns, (rows, read) = texts.columns, _span_reader(texts, lex)

    def replaced(t: str, got: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for a, b, kind in got:
            out += [t[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join(out) + t[at:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[replaced(t, got) for t, got in zip(b["text"], read(b))])[columns]

    return rows.mapInPandas(run, texts.schema)


def memory_texts(sessions: DataFrame, memories: DataFrame) -> DataFrame:
    """``source_table, record_key, field_name, turn_index, text`` of all searched fields.

    Null and blank texts and rows without a key are left out; rows delivered
    twice come twice, as results are made distinct at the end.
    """
    turns = sessions.where("session_id IS NOT NULL").select(F.lit("sessions").alias("source_table"), F.col("session_id").alias("record_key"), F.lit("turns").alias("field_name"), F.posexplode("turns").alias("turn_index", "turn"))
    out = turns.select("source_table", "record_key", "field_name", "turn_index", F.col("turn.content").alias("text"))
    for f in ("raw", "fact"):
        out = out.unionByName(memories.where("id IS NOT NULL").select(F.lit("memories").alias("source_table"), F.col("id").cast("string").alias("record_key"), F.lit(f).alias("field_name"), F.lit(-1).alias("turn_index"), F.col(f).alias("text")))
    return out.where("text IS NOT NULL AND trim(text) <> ''")
