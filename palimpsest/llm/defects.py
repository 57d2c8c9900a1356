"""Prompt and response pairs whose response is no usable answer.

Copies are found by aligning response with prompt: containment of three-word
shingles first, then the longest common subsequence of words. Refusals are
found by aligning the response with templates of refusals in the same way.
Whether a response is in another language than prompt and expected answer is
told by a character model fitted on all labelled documents. What breaks off is told by brackets, dangling words and the end
of its last line; endings of list items that many responses share are learned
from all responses.
"""

from __future__ import annotations

import bisect
import copy
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import bounded, materialize, once

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")

#: Texts that stand for no answer.
PLACEHOLDERS = {"n/a", "na", "null", "none", "nil", "nan", "undefined", "tbd", "todo", "empty", "no answer", "no response", "answer", "final answer", "response", "output", "placeholder", "blank", "missing", "your answer here", "insert answer here", "antwort", "réponse", "respuesta", "resposta", "risposta", "antwoord", "ответ", "απάντηση", "回答", "答え"}

#: Words that frame a repeated prompt without adding to it.
FRAME = set("sure so the question is was you your asked ask are asking want wanted to know here repeat repeated again me let restate okay ok well hmm right good great i my we that this about would like prompt user q said wrote".split())

#: How responses decline or claim not to know. A star stands for any words.
REFUSALS = [
    "i don't know",
    "i do not know",
    "i am not sure",
    "i'm not sure",
    "i have no idea",
    "i can't help with that",
    "i cannot help with that",
    "i won't be able to help",
    "i am unable to determine",
    "i'm unable to determine",
    "i am unable to answer",
    "unable to * that from the context",
    "i cannot answer",
    "i can't answer",
    "i can't tell you",
    "i cannot say",
    "i cannot tell",
    "i can't say",
    "i'm not able to share",
    "i am not able to",
    "i'm not able to",
    "isn't possible for me to",
    "is not possible for me to",
    "i'd rather not answer",
    "i would rather not",
    "i must decline",
    "i have to decline",
    "i decline to answer",
    "isn't something i can answer",
    "is not something i can",
    "is beyond what i can",
    "i am not in a position to",
    "i'm not in a position to",
    "i have no access to",
    "i don't have access to",
    "i do not have access to",
    "i have no record of",
    "i have no memory of",
    "i have no information",
    "i don't have enough information",
    "i do not have enough information",
    "not enough information to answer",
    "i lack the details",
    "i lack the information",
    "there is no mention of",
    "there is no information",
    "there is no record",
    "no answer can be given",
    "memories don't cover this",
    "memories do not cover",
    "leave this open",
    "nothing in the * tells me",
    "none of the * say anything about",
    "none of the * mention",
    "the history says nothing",
    "says nothing on this point",
    "i could not find any",
    "i couldn't find any",
    "i don't have any record",
    "i don't remember",
    "i do not recall",
    "information provided is not enough",
    "not mentioned in any",
    "you never mentioned",
    "you did not mention it",
    "ich weiß es nicht",
    "weiß ich nichts",
    "das kann ich nicht",
    "kann ich leider nicht beantworten",
    "habe ich in den notizen nichts gefunden",
    "keine angaben dazu",
    "je ne sais pas",
    "je ne peux pas répondre",
    "je n'ai trouvé aucune",
    "rien dans * ne permet de le dire",
    "no lo sé",
    "no puedo responder",
    "no tengo datos sobre",
    "no aparece nada de eso",
    "não sei",
    "não posso responder",
    "não consigo responder",
    "não há registo de",
    "non lo so",
    "non posso rispondere",
    "non ho appunti su",
    "dat weet ik niet",
    "ik kan * niet beantwoorden",
    "kan ik geen antwoord op geven",
    "staat niets in de",
]
_TEMPLATES = [[w for w in t.replace("’", "'").split()] for t in REFUSALS]

#: Words after which an answer does follow, though the response began with what it cannot do.
_YET = re.compile(r"\b(?:but|however|still|though|yet)\b.*\b(?:said|wrote|noted|told|mentioned|recommended|is|was|were)\b", re.I | re.S)

#: Words that no complete sentence ends with, even before a full stop.
DANGLING = set("the a an and or but because your my our their his its than whose der die das und oder ein eine weil le la les et ou un une parce el los las y o una porque il lo gli e o perché de het en of een omdat os as um uma".split())

_END = re.compile(r"[.!?…。！？」』][\"'”’»)\]*_`]*$|[\"”’»)\]」』]$")
_LIST = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+\S")
_OPEN_LIST = re.compile(r"(?:^|\n)\s*(?:[-*•]|\d+[.)]?)\s*$")
_FRAMED = re.compile(r"^(?:you|it|i|based|from the|here is|here are|let me|in \w+ you|unfortunately|sorry|happy|the (?:session|first|note)|according|according to)\b", re.I)


def words(text: str | None) -> list[str]:
    return _WORD.findall(_INVISIBLE.sub("", text).lower().replace("’", "'")) if text else []


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        prev = row
    return prev[-1]


def shingles(w: list[str], n: int = 3) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def is_empty(text: str | None) -> bool:
    """Nothing, or only blanks, marks, tags, labels or a placeholder."""
    if text is None:
        return True
    t = re.sub(r"</?\w+/?>", " ", _INVISIBLE.sub("", text))
    t = re.sub(r"[\s\W_]+", " ", t.lower().replace("n/a", "na"), flags=re.U).strip()
    return not t or t in PLACEHOLDERS


def is_copy(p: list[str], q: list[str]) -> bool:
    """Nothing beyond the prompt, in whole or for the greater part."""
    if len(q) < 3 or len(p) < 3:
        return bool(p) and p == q
    extra = [w for w in p if w not in (have := set(q)) and w not in FRAME]
    if len(extra) > 0.1 * len(p):
        return False
    sp, sq = shingles(p), shingles(q)
    common = len(sp & sq)
    if common < 0.5 * min(len(sp), len(sq)):
        return False
    # A repeated prompt aligns with its last stretch of the prompt's length.
    m = max(lcs(p[: len(q) + 8], q), lcs(p[-len(q) - 2 :], q))
    return m >= 0.8 * len(q) or (m >= 0.95 * len([w for w in p if w in have]) and len(p) >= 0.6 * len(q) and p[-1] in have and p[0] == q[0])


def refuses(p: list[str]) -> bool:
    """A template aligns with a short stretch of the response."""
    have = set(p)
    for t in _TEMPLATES:
        fixed = [w for w in t if w != "*"]
        if sum(w in have for w in fixed) < 0.8 * len(fixed) or (len(fixed) < 5 and not all(w in have for w in fixed)):
            continue
        reach = len(fixed) + (5 if "*" in t else 1)
        for i, w in enumerate(p):
            if w == fixed[0] and lcs(fixed, p[i : i + reach]) >= (len(fixed) if len(fixed) < 5 else 0.8 * len(fixed)):
                return True
    return False


class LanguageModel:
    """Character trigrams of each language, and the words of the documents."""

    def __init__(self, rows: list[tuple[str, str]]):
        """rows: (language, text)."""
        counts: dict[str, Counter] = defaultdict(Counter)
        seen: Counter = Counter()
        for lang, text in rows:
            for w in _lower_words(text):
                seen[w] += 1
                for g in _grams(w):
                    counts[lang][g] += 1
        self.known = {w for w, n in seen.items() if n > 1}
        self.sorted = sorted(self.known)
        #: ``word``: the known words of a model that Spark counted, where ``known`` is empty; and, of these, what :meth:`cut` is true of.
        self.table: DataFrame | None = None
        self.fragments: set[str] = set()
        self._weigh(counts)

    @classmethod
    def counted(cls, grams: list[tuple[str, str, int]], known: DataFrame) -> LanguageModel:
        """grams: (language, trigram, count); known: ``word``."""
        model, counts = cls([]), defaultdict(Counter)
        for lang, g, n in grams:
            counts[lang][g] = n
        model._weigh(counts)
        model.table = known
        return model

    def _weigh(self, counts: dict[str, Counter]) -> None:
        size = len({g for c in counts.values() for g in c}) or 1
        self.logp, self.rest = {}, {}
        for lang, c in sorted(counts.items()):
            total = sum(c.values()) + 0.1 * size
            self.logp[lang] = {g: math.log((n + 0.1) / total) for g, n in c.items()}
            self.rest[lang] = math.log(0.1 / total)

    def over(self, predictions: DataFrame) -> LanguageModel:
        """The model as it is sent: of known words only what tells whether the last words of these responses are cut."""
        if self.table is None:
            return self
        out = copy.copy(self)
        out.table, out.fragments = None, _fragments(self.table, predictions)
        return out

    def scores(self, text: str, skip: set[str] = frozenset()) -> tuple[dict[str, float], int]:
        """Mean log-likelihood a trigram by language, and the number of trigrams."""
        grams = [g for w in _lower_words(text) if w not in skip for g in _grams(w)]
        if not grams:
            return {}, 0
        return {lang: sum(p.get(g, self.rest[lang]) for g in grams) / len(grams) for lang, p in self.logp.items()}, len(grams)

    def best(self, text: str, skip: set[str] = frozenset()) -> str | None:
        s, _ = self.scores(text, skip)
        return max(s, key=s.get) if s else None

    def cut(self, word: str) -> bool:
        """No known word, but the beginning of one."""
        if not word or word in self.known or word.isdigit():
            return False
        if word in self.fragments:
            return True
        at = bisect.bisect_left(self.sorted, word)
        return at < len(self.sorted) and self.sorted[at].startswith(word)


def _lower_words(text: str) -> list[str]:
    """Words but for capitalised ones inside a sentence, which are mostly names."""
    out = []
    for m in re.finditer(r"[^\W\d_]+", text):
        w = m.group()
        if w[0].isupper() and not w.isupper() and m.start() and text[m.start() - 2 : m.start()] not in (". ", "! ", "? ", ": ") and text[m.start() - 1] not in "\n¿¡\"":
            continue
        out.append(w.lower())
    return out


def _grams(w: str) -> list[str]:
    w = f" {w} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _counted_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(b["lang"], b["text"]):
            seen[lang].update(_lower_words(text))
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "word", "n"]).astype({"n": "int64"})


def fit_language_model(documents: DataFrame) -> LanguageModel:
    """Fit on all documents of each labelled language.

    Labels count by their first two letters; null, ``und`` and rare labels
    (under 3 documents) teach nothing. Words are counted by Spark and stay a
    table; trigrams are counted from them and sent.
    """
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    rows = documents.where("lang IS NOT NULL AND text IS NOT NULL AND lower(trim(lang)) <> 'und'").select(lang.alias("lang"), "text")
    often = [r["lang"] for r in rows.groupBy("lang").count().where("count >= 3").collect()]
    counted = rows.where(F.col("lang").isin(often)).mapInPandas(_counted_words, "lang string, word string, n bigint")
    counted = materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    each = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(padded, i, F.lit(3)))
    grams = counted.select("lang", "n", F.explode(each).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n"))
    known = counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").select("word")
    return LanguageModel.counted([tuple(r) for r in grams.collect()], known)


def _fragments(known: DataFrame, predictions: DataFrame) -> set[str]:
    """Last words of responses that are no known word, but the beginning of one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            last = {w[-1] for w in (words(_INVISIBLE.sub("", t).strip()) for t in b["predicted"]) if w}
            yield pd.DataFrame({"word": pd.Series(sorted(w for w in last if not w.isdigit()), dtype=object)})

    last = materialize(predictions.where("predicted IS NOT NULL").select("predicted").mapInPandas(run, "word string").distinct(), "last-words")
    unknown = last.join(known, "word", "left_anti")
    begins = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", F.lit(1), i))).alias("word"))
    return {r["word"] for r in begins.join(bounded(unknown), "word").distinct().collect()}


#: Common small words of each language.
SMALL_WORDS = {
    "en": "in on the of and to is was it you that my did which how what when where with for not they",
    "de": "in der die das und ist war nicht ich du hast mit wie viele wo für auf dem zu weil ungefähr",
    "fr": "le la les de et est pas vous je dans où combien près mais cette parce que c'était environ",
    "es": "el la los de y es no por que en con cuántos dónde para pero fue porque junto muy unos",
    "pt": "o a os de e é não que em com quantos onde para mas foi porque do na você durou",
    "it": "in il la le di e è non che in con quanti dove per ma era alla tuoi poi durato circa",
    "nl": "in de het een en is niet ik je van op hoeveel waar maar was naar met dat daarna duurde ongeveer",
    "sv": "det och är inte jag du att i på om var men som en med vid ungefär blev rätt bredvid",
    "pl": "to i w nie się że na z było jest przy od ale ile bo tak około wieczorem we dla",
}

#: Letters that of these languages only the named ones write.
_OWN_LETTERS = {"ß": "de", "å": "sv", "ł": "pl", "ż": "pl", "ę": "pl", "ś": "pl", "ą": "pl", "ź": "pl", "ñ": "es", "¿": "es", "¡": "es", "ã": "pt", "õ": "pt", "ì": "it", "ò": "it", "ä": "de sv", "ö": "de sv", "œ": "fr"}
_SMALL: dict[str, list[str]] = defaultdict(list)
for _lang, _words in SMALL_WORDS.items():
    for _w in _words.split():
        _SMALL[_w].append(_lang)


def _script(text: str) -> str:
    """The script of most letters: Latin, or the code of a language with its own."""
    n = Counter("ru" if "Ѐ" <= c <= "ԯ" else "el" if "Ͱ" <= c <= "Ͽ" else "ja" if c >= "぀" else "Latin" for c in text if c.isalpha())
    return n.most_common(1)[0][0] if n else ""


def _votes(text: str) -> Counter:
    votes: Counter = Counter()
    for w in _lower_words(text.replace("'", "")) + [m.group().lower() for m in re.finditer(r"\bc'\w+", text.lower())]:
        for lang in _SMALL.get(w, ()):
            votes[lang] += 1
        for c in set(w):
            for lang in _OWN_LETTERS.get(c, "").split():
                votes[lang] += 1
    if "¿" in text or "¡" in text:
        votes["es"] += 1
    return votes


def _spoken(model: LanguageModel, text: str | None) -> set[str]:
    """Languages a text may be in; empty if nothing tells."""
    if not text:
        return set()
    votes = _votes(text)
    if votes:
        top = max(votes.values())
        return {lang for lang, n in votes.items() if n == top}
    s, n = model.scores(text)
    return {max(s, key=s.get)} if n >= 20 else set()


def other_language(model: LanguageModel, question: str, answer: str | None, predicted: str) -> bool:
    """In a language that is neither that of the prompt nor of the expected answer.

    Another script tells at once; then small words and letters of a language;
    where there are none, the character model.
    """
    script = _script(predicted)
    if script and script not in {_script(question), _script(answer or question)}:
        return True
    if script != "Latin":
        return False
    asked, expected = _spoken(model, question), _spoken(model, answer)
    allowed = asked if asked & expected else asked | expected
    votes = _votes(predicted)
    if not allowed:
        return False
    ours = max((votes[a] for a in allowed), default=0)
    theirs = max((n for lang, n in votes.items() if lang not in allowed), default=0)
    if theirs - ours >= 2 or (theirs and not ours):
        return True
    if ours > theirs or (ours and ours == theirs):
        return False
    shared = set(_lower_words(question)) | set(_lower_words(answer or ""))
    own = [w for w in _lower_words(predicted) if w not in shared]
    s, n = model.scores(" ".join(own))
    if n < 8 or len(own) < 2:
        return False
    best = max(s, key=s.get)
    return best not in allowed and s[best] - max(s.get(a, -99.0) for a in allowed) > 0.15


def breaks_off(model: LanguageModel, question: str, answer: str | None, predicted: str, endings: set[str]) -> bool:
    t = _INVISIBLE.sub("", predicted).strip()
    if _OPEN_LIST.search(t) and "\n" in t or t.endswith((":", ",", ";", "(", " -", "–", "—", "...", "…")) and not is_empty(t):
        return True
    plain = re.sub(r"[:;]-?\)", "", t)
    if any(plain.count(a) > plain.count(b) for a, b in ("()", "[]", "{}", "“”", "«»", "「」")) or plain.count('"') % 2:
        return True
    w = words(t)
    if not w:
        return False
    last = t.rsplit("\n", 1)[-1]
    if _END.search(t):
        return w[-1] in DANGLING and bool(re.search(r"\w[.。]$", t)) and len(w) > 3
    if "\n" in t and _LIST.match(last):
        return " ".join(words(last)[-2:]) not in endings
    if w[-1] in DANGLING or (model.cut(w[-1]) and w[-1] not in set(words(answer))):
        return True
    a, p = (answer or "").lower().strip(), t.lower()
    if any(p.endswith(a[:k]) and a[k].isalnum() for k in range(3, len(a))):
        return True
    return bool(re.search(r"[,;:\n]|[.!?]\s", t)) or bool(_FRAMED.match(t) and len(w) > 5)


def defect_of(model: LanguageModel, endings: set[str], abstain: bool, question: str | None, answer: str | None, predicted: str | None) -> str | None:
    if is_empty(predicted):
        return "empty"
    p, q = words(predicted), words(question)
    if is_copy(p, q):
        return "copy"
    said = " ".join(words(answer))
    if refuses(p) and not _YET.search(predicted) and not (not abstain and said and f" {said} " in f" {' '.join(p)} "):
        return None if abstain else "refusal"
    if question and other_language(model, question, answer, predicted):
        return "other_language"
    return "truncated" if breaks_off(model, question or "", answer, predicted, endings) else None


def common_endings(predictions: DataFrame, share: float = 0.02) -> set[str]:
    """Last two words of unpunctuated last list items that many responses end with.

    Counted over all responses; an ending needs ``share`` of all such items and
    two questions, so that there are at most 1 / ``share`` of them.
    """
    last = F.element_at(F.split(F.rtrim("predicted"), "\n"), -1)
    rows = predictions.where(F.col("predicted").contains("\n")).select("question_id", F.lower(last).alias("last")).where(F.col("last").rlike(r"^\s*([-*•]|\d+[.)])\s+\S") & F.col("last").rlike(r"[\p{L}\p{N}]$"))
    two = F.regexp_extract("last", r"([\p{L}\p{N}]+[^\p{L}\p{N}]+[\p{L}\p{N}]+)$", 1)
    counted = rows.select("question_id", two.alias("two")).distinct().groupBy("two").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return {" ".join(words(r["two"])) for r in counted.where(F.col("n") >= max(2, share * total)).select("two").collect()}


def flag_defects(predictions: DataFrame, model: LanguageModel) -> DataFrame:
    """``run_id, question_id, defect`` of defective pairs.

    A null response is ``empty``; with a null prompt only emptiness, refusal
    and breaking off can be told; a null ``is_abstention`` counts as false.
    Rows of one run and question count once.
    """
    cols = ["run_id", "question_id", "is_abstention", "question", "answer", "predicted"]
    rows = once(predictions.select(*cols), "run_id", "question_id")
    endings = common_endings(predictions)
    shared = predictions.sparkSession.sparkContext.broadcast((model.over(predictions), endings))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, e = shared.value
        for b in batches:
            none = lambda v: v if isinstance(v, str) else None
            found = [defect_of(m, e, a is True or a == 1, none(q), none(w), none(p)) for a, q, w, p in zip(b["is_abstention"], b["question"], b["answer"], b["predicted"])]
            out = b[["run_id", "question_id"]].assign(defect=found)
            yield out[out["defect"].notna()]

    return rows.mapInPandas(run, "run_id string, question_id string, defect string")
