"""One consistent spelling for text that looks the same.

Every letter has the set of scripts in which a letter drawn alike exists. The
sets of a token's letters are intersected: what is left are the scripts in
which the whole token can be spelled. A token that only one script can spell
fixes the script of its text; an ambiguous token follows the script that most
fixed tokens of the text have, else the first of Latin, Cyrillic and Greek; a
token that no single script can spell is spelled letter by letter in the first
script each letter allows. All of this depends only on how the text looks, so
texts that look the same come out equal.

Before that, widths, joined letters, ways of composing accents, invisible
characters and kinds of blank are brought to one form. Raised digits, missing
accents, case and line breaks stay.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.session import materialize

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")

#: Letters drawn alike, one row a shape, columns as in SCRIPTS; a blank where the script has none.
_ALIKE = """
A А Α .
B В Β .
C С . .
E Е Ε .
G Ԍ . .
H Н Η .
I І Ι .
J Ј . .
K К Κ .
M М Μ .
N . Ν .
O О Ο Օ
P Р Ρ .
Q Ԛ . .
S Ѕ . Տ
T Т Τ .
V Ѵ . .
W Ԝ . .
X Х Χ .
Y У Υ .
Z . Ζ .
a а . .
c с . .
d ԁ . .
e е . .
g . . ց
h һ . հ
i і . .
j ј . .
l ӏ . .
n . . ո
o о ο օ
p р . .
q ԛ . զ
s ѕ . .
u . . ս
v ѵ ν .
w ԝ . .
x х . .
y у . .
. Г Γ .
. П Π .
. Ф Φ Փ
"""

#: Other spellings of a shape above.
_ALSO = {"ɡ": "g", "ɑ": "a", "Ү": "Y", "ү": "y", "Ɩ": "I"}

_SHAPES = [tuple(None if x == "." else x for x in line.split()) for line in _ALIKE.strip().splitlines()]
#: Letter to its shape.
_SHAPE = {x: k for k, row in enumerate(_SHAPES) for x in row if x}
_MASK = {x: sum(1 << i for i, y in enumerate(_SHAPES[k]) if y) for x, k in _SHAPE.items()}

_RANGES = ((0, 0x41, 0x24F), (1, 0x400, 0x52F), (2, 0x370, 0x3FF), (3, 0x530, 0x58F))
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
_BLANKS = re.compile("[\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_LINES = re.compile("\r\n?|[\u0085\u2028\u2029]")
#: Letters and the marks upon them.
_TOKEN = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
_NON_LATIN = re.compile("[\u0370-\u058f]")


@lru_cache(maxsize=65536)
def _plain_form(c: str) -> str:
    """A character without its width or ligature, else itself."""
    d = unicodedata.decomposition(c)
    kind = d.split(" ")[0]
    if kind in ("<wide>", "<narrow>") or (kind == "<compat>" and unicodedata.category(c)[0] == "L" and ("LIGATURE" in (n := unicodedata.name(c, "")) or "DIGRAPH" in n or c in "ĲĳŉǄǅǆǇǈǉǊǋǌǱǲǳ")):
        return "".join(_plain_form(chr(int(x, 16))) for x in d.split(" ")[1:])
    if c in "\u2010\u2011":
        return "-"
    return c


def _invisible(m: re.Match) -> str:
    """Joiners and selectors stay where they change what is drawn: in emoji and in joining scripts."""
    c, s, i = m.group(), m.string, m.start()
    if c in "\u200c\u200d\ufe0e\ufe0f" or "\U000e0000" < c:
        near = s[i - 1 : i], s[i + 1 : i + 2]
        if c == "\ufe0e" or c == "\ufe0f" or c > "\U000e0000":
            near = near[:1]
        if all(x and ("\u0590" <= x <= "\u1cff" or x in "\ufe0f\u200d" or x >= "\U0001f000" or "\u2190" <= x <= "\u2bff") for x in near):
            return c
    return ""


@lru_cache(maxsize=262144)
def _token_mask(token: str) -> int:
    """Bit set of the scripts that can spell a decomposed token; 0 if none, -1 if it has letters of other scripts only."""
    mask, known = (1 << len(SCRIPTS)) - 1, False
    for c in token:
        if "\u0300" <= c <= "\u036f":
            continue
        own = _MASK.get(c)
        if own is None:
            c = _ALSO.get(c, c)
            own = _MASK.get(c)
        if own is None:
            own = next((1 << k for k, low, high in _RANGES if low <= ord(c) <= high), 0)
            if not own:
                return -1
        known = True
        mask &= own
    return mask if known else -1


@lru_cache(maxsize=262144)
def _spell(token: str, script: int | None) -> str:
    out = []
    for c in token:
        c = _ALSO.get(c, c)
        k = _SHAPE.get(c)
        if k is not None:
            row = _SHAPES[k]
            c = row[script] if script is not None and row[script] else next(x for x in row if x)
        out.append(c)
    return "".join(out)


def consistent(text: str | None) -> str | None:
    """The consistent spelling of one text; null stays null."""
    if text is None:
        return None
    if text.isascii():
        return _LINES.sub("\n", text).replace("\t", " ") if "\t" in text or "\r" in text else text
    t = _LINES.sub("\n", text)
    t = _INVISIBLE.sub(_invisible, t)
    t = _BLANKS.sub(" ", t)
    t = "".join([c if c < "\u0100" else _plain_form(c) for c in t])
    t = unicodedata.normalize("NFD", t)
    if _NON_LATIN.search(t) or any(c in t for c in _ALSO):
        votes = [0] * len(SCRIPTS)
        for m in _TOKEN.finditer(t):
            mask = _token_mask(m.group())
            if mask > 0 and not mask & (mask - 1):
                votes[mask.bit_length() - 1] += 1
        order = sorted(range(len(SCRIPTS)), key=lambda k: (-votes[k], k))

        def respell(m: re.Match) -> str:
            mask = _token_mask(m.group())
            if mask < 0:
                return m.group() if m.group().isascii() else _spell(m.group(), None)
            return _spell(m.group(), next((k for k in order if mask >> k & 1), None))

        t = _TOKEN.sub(respell, t)
    return unicodedata.normalize("NFC", t)


def script_report(text: str) -> tuple[str | None, int, int]:
    """``script, mixed, whole`` of a text: the script that most tokens fix, tokens that mix scripts, and whole-script confusables.

    A token mixes scripts if its letters are of more than one; it is a
    whole-script confusable if all are of one script, another one could spell
    it as well, and the text's script is the other.
    """
    if text.isascii():
        return ("Latin" if any(map(str.isalpha, text)) else None), 0, 0
    t = unicodedata.normalize("NFD", _INVISIBLE.sub(_invisible, text))
    votes, seen = [0] * len(SCRIPTS), []
    for m in _TOKEN.finditer(t):
        token = m.group()
        mask = _token_mask(token)
        own = {k for c in token for k, low, high in _RANGES if low <= ord(c) <= high}
        if mask > 0 and not mask & (mask - 1):
            votes[mask.bit_length() - 1] += 1
        seen.append((mask, own))
    best = max(range(len(SCRIPTS)), key=lambda k: (votes[k], -k)) if seen else None
    whole = sum(len(own) == 1 and mask > 0 and best not in own and mask >> best & 1 for mask, own in seen)
    return (SCRIPTS[best] if seen else None), sum(len(own) > 1 for _, own in seen), whole


def scripts_column(c: Column) -> Column:
    """:func:`script_report` as ``struct(script, mixed, whole)``; null for a null text."""

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [script_report(t) if isinstance(t, str) else (None, None, None) for t in s]
        return pd.DataFrame(rows, columns=["script", "mixed", "whole"]).astype({"mixed": "Int32", "whole": "Int32"})

    return F.pandas_udf(run, "script string, mixed int, whole int")(c)


_FIRST = str.maketrans({x: next(y for y in row if y) for row in _SHAPES for x in row if x})


def shape_form(text: str | None) -> str | None:
    """A text by its shapes alone: every letter in the first script that has it drawn alike.

    For comparing passages across texts: the consistent spelling of an
    ambiguous word depends on the other words of its text, this form does not.
    """
    t = consistent(text)
    return t if t is None or t.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(_FIRST))


def _consistent_batch(s: pd.Series) -> pd.Series:
    return s.map(consistent, na_action="ignore")


def consistent_text(c: Column) -> Column:
    """:func:`consistent` as a column; the only step that needs Python."""
    return F.pandas_udf(_consistent_batch, StringType())(c)


def look_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, look, exact``: digests of how each text looks and of what it is.

    Rows with a null text are left out; an empty text is a text. Rows of one
    id with one text count once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    return rows.select("id", F.md5(consistent_text(F.col("text"))).alias("look"), F.md5("text").alias("exact")).distinct()


def lookalike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", expand: int = 50) -> DataFrame:
    """``id_a, id_b``: texts that look the same but differ in characters.

    Classes of one look are found by one aggregate. Of a group of exact copies
    all members stand in pairs where it has up to ``expand`` members, beyond
    that its smallest id stands for it (:func:`membership` names the others);
    no link between different texts is lost. A hot text with no different
    lookalike never reaches the join.
    """
    rows = materialize(look_classes(docs, id_col, text_col), "looks")
    classes = rows.groupBy("look", "exact").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    mixed = classes.groupBy("look").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("look")
    live = classes.join(mixed, "look", "left_semi")
    few = rows.join(live.where(F.col("n") <= expand).select("look", "exact"), ["look", "exact"], "left_semi")
    members = few.unionByName(live.where(F.col("n") > expand).select(F.col("rep").alias("id"), "look", "exact"))
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.exact") != F.col("b.exact")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, class_id, text_class_id``: smallest ids of equal looks and of equal texts."""
    rows = materialize(look_classes(docs, id_col, text_col), "looks")
    exact = rows.groupBy("look", "exact").agg(F.min("id").alias("text_class_id"))
    looks = exact.groupBy("look").agg(F.min("text_class_id").alias("class_id"))
    return rows.join(exact, ["look", "exact"]).join(looks, "look").select("id", "class_id", "text_class_id")
