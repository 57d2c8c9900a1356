"""Text normalizers and token measures as column expressions.

There are three normalizers, which differ on purpose: ``exact_key`` decides
what is the same text, ``normalize_text`` feeds triples and screens (it also
expands contractions), and ``prefilter_text`` feeds the prefilter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` sees it.
WS = r"\t-\r\u001c- \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Contractions and what they stand for.
CONTRACTIONS = {
    "isnt": "is not",
    "arent": "are not",
    "wasnt": "was not",
    "werent": "were not",
    "doesnt": "does not",
    "dont": "do not",
    "didnt": "did not",
    "cant": "can not",
    "cannot": "can not",
    "couldnt": "could not",
    "wont": "will not",
    "wouldnt": "would not",
    "hasnt": "has not",
    "havent": "have not",
    "hadnt": "had not",
    "shouldnt": "should not",
    "mustnt": "must not",
    "aint": "is not",
    "neednt": "need not",
}

#: Words that qualify a number without changing it.
APPROXIMATORS = "about around roughly approximately nearly almost over under close to at least most up more than less only exactly just some currently now".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it uses several times and that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(pairs: dict[str, str]) -> Column:
    """A map literal; one expression, which is folded once, however many pairs. Neither side may hold a bar or a colon."""
    return F.str_to_map(F.lit("|".join(f"{k}:{v}" for k, v in pairs.items())), F.lit("[|]"), F.lit(":"))


def longest_first(phrases: list[str]) -> str:
    """Alternatives of a pattern, longer ones first, so that a scan takes the longest phrase at each place."""
    return "|".join(sorted(phrases, key=len, reverse=True))


def strip(c: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def exact_key(c: Column) -> Column:
    """Lower case, only letters, digits, underscores and white space, collapsed."""
    return collapse(F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}}_{WS}]", ""))


def normalize_text(c: Column) -> Column:
    """``exact_key`` without apostrophes' letters joined apart, contractions expanded word by word."""
    words = F.split(exact_key(F.regexp_replace(c, "['’]", "")), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table(CONTRACTIONS), w), w)), " ")


def prefilter_text(c: Column) -> Column:
    """``exact_key`` with straight apostrophes dropped first; contractions stay joined."""
    return exact_key(F.regexp_replace(c, "'", ""))


def tokens(c: Column) -> Column:
    """Words of a normalized text; an empty array for an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def drop_leading(c: Column, words: list[str]) -> Column:
    """Leading words of a list off a normalized text, while a word remains."""
    return F.regexp_replace(c, rf"^(?:(?:{'|'.join(words)}) )+(?=[^ ])", "")


def token_entropy(c: Column) -> Column:
    """Shannon entropy in bits of the words of a text; 0 for a text without words."""
    words = tokens(normalize_text(c))
    total = F.size(words).cast("double")
    shares = F.transform(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda x: x == w)).cast("double") / total)
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two word arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_share(question: Column, passage: Column) -> Column:
    """Share of the question's words of more than two letters that the passage has; 0 if it has none. Words are parted by white space only."""
    words = lambda c: tokens(collapse(F.lower(c)))
    q = F.array_distinct(F.filter(words(question), lambda w: F.length(w) > 2))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, words(passage))) / F.size(q))


def numbers_of(c: Column) -> Column:
    """Numbers of a normalized value."""
    kept = F.filter(tokens(c), lambda w: ~w.isin(APPROXIMATORS))
    return F.filter(kept, lambda w: w.rlike(r"^\d+(\.\d+)?$"))


def number_residue(c: Column) -> Column:
    """A normalized value without its numbers and approximators."""
    kept = F.filter(tokens(c), lambda w: ~w.isin(APPROXIMATORS) & ~w.rlike(r"^\d+(\.\d+)?$"))
    return F.array_join(kept, " ")


def windows(words: Column, size: int, overlap: int) -> Column:
    """Word windows of ``size`` that share ``overlap`` words; the last ends at the last word.

    A text of up to ``size`` words is one window; no words give one empty window.
    """
    step = size - overlap
    n = F.size(words)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, size))


def first_difference(a: Column, b: Column) -> Column:
    """UTF-8 byte at which two texts first differ; null if they are equal. A prefix differs at its end."""
    x, y = F.hex(F.encode(a, "UTF-8")), F.hex(F.encode(b, "UTF-8"))
    n = F.least(F.length(x), F.length(y)) / 2
    places = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    hit = F.filter(places, lambda i: F.substring(x, i * 2 + 1, 2) != F.substring(y, i * 2 + 1, 2))
    return F.when(a == b, F.lit(None).cast("int")).otherwise(F.coalesce(F.try_element_at(hit, F.lit(1)), n.cast("int")))


def cost_in_tokens(c: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.length(c) / 4).cast("bigint")


def keep_last(c: Column, chars: int) -> Column:
    """The last ``chars`` characters."""
    return F.when(F.length(c) <= chars, c).otherwise(F.substring(c, -chars, chars))
