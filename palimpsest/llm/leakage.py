"""Held-out passages inside training text.

Words are compared by their shapes (``lookalike.shape_form``), whatever their case and
punctuation. Runs of ``SEED`` words of the held-out items are the seeds; a
seed that stands in many items says little and is used only where a stretch of
``min_run`` words has no rarer one. A document is read once: its seeds are
looked up, and around each hit the item is aligned with the document by
Smith-Waterman over words, which scores edited copies; the longest run of
equal consecutive words is taken from the same stretch.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.lookalike import shape_form

SEED = 5
_WORD = re.compile(r"[^\W_]+")

SCHEMA = "doc_id bigint, question_id string, field string, run_words int, score int, matched_words int, item_words int, first_word int, last_word int"


def words_of(text: str | None) -> list[str]:
    """Letters and digits in runs, folded; an apostrophe or hyphen parts words."""
    return _WORD.findall(shape_form(text).casefold()) if text else []


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, miss: int = -1, gap: int = -1) -> tuple[int, int, int, int]:
    """``score, matched words, first and last index in b`` of the best local alignment of word numbers.

    A gap along a row costs ``gap`` a word, so the best cell to the left is a
    running maximum of score minus position; a row is a few array operations.
    The path is then walked back from the best cell.
    """
    step = np.arange(len(b) + 1) * -gap
    h = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a, 1):
        row = np.maximum(h[i - 1] + gap, 0)
        np.maximum(row[1:], h[i - 1][:-1] + np.where(b == x, match, miss), out=row[1:])
        h[i] = np.maximum.accumulate(row + step) - step
    i, j = divmod(int(h.argmax()), len(b) + 1)
    score, last, matched = int(h[i, j]), j - 1, 0
    while h[i, j] > 0:
        same = a[i - 1] == b[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (match if same else miss):
            i, j, matched = i - 1, j - 1, matched + int(same)
        elif h[i, j] == h[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
    return score, matched, j, last


def alignment_scores(pairs: list[tuple[np.ndarray, np.ndarray]], match: int = 2, miss: int = -1, gap: int = -1, block: int = 128) -> np.ndarray:
    """Scores of many alignments at once: a block of pairs of like length goes through the rows together.

    Missing words are padded with numbers that equal nothing.
    """
    out = np.zeros(len(pairs), np.int32)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    for at in range(0, len(order), block):
        some = order[at : at + block]
        rows, width = max(len(pairs[k][0]) for k in some), max(len(pairs[k][1]) for k in some)
        a, b = np.full((len(some), rows), -2), np.full((len(some), width), -3)
        for n, k in enumerate(some):
            a[n, : len(pairs[k][0])], b[n, : len(pairs[k][1])] = pairs[k]
        step = (np.arange(width + 1) * -gap).astype(np.int32)
        prev, best = np.zeros((len(some), width + 1), np.int32), np.zeros(len(some), np.int32)
        for i in range(rows):
            row = np.maximum(prev + gap, 0)
            np.maximum(row[:, 1:], prev[:, :-1] + np.where(b == a[:, i, None], match, miss).astype(np.int32), out=row[:, 1:])
            prev = np.maximum.accumulate(row + step, axis=1) - step
            np.maximum(best, prev.max(axis=1), out=best)
        out[some] = best
    return out


class SeedIndex:
    """Seeds of the held-out items; its size is that of the items."""

    def __init__(self, items: list[tuple[str, str, str]], min_run: int, common: int = 8):
        """items: (question_id, field, text). common: number of items from which a seed counts as common."""
        self.min_run = min_run
        self.items = [(q, f, w) for q, f, t in items if len(w := words_of(t)) >= min(min_run, SEED)]
        places = [[tuple(w[i : i + SEED]) for i in range(len(w) - SEED + 1)] for _, _, w in self.items]
        often = Counter(s for p in places for s in set(p))
        used: set[tuple[str, ...]] = set()
        window = max(1, min_run - SEED + 1)
        for p in places:
            used.update(s for s in p if often[s] <= common)
            for i in range(max(1, len(p) - window + 1)):
                if p[i : i + window] and not any(s in used for s in p[i : i + window]):
                    used.add(min(p[i : i + window], key=lambda s: (often[s], s)))
        self.at: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, p in enumerate(places):
            for i, s in enumerate(p):
                if s in used:
                    self.at[s].append((k, i))
        self.at = dict(self.at)
        number: dict[str, int] = {}
        self.coded = [np.array([number.setdefault(x, len(number)) for x in w]) for _, _, w in self.items]
        self.number = number
        self.first = {s[0] for s in self.at}

    def candidates(self, w: list[str]) -> list[tuple[int, int, list[tuple[int, int]]]]:
        """``item, longest exact run, stretches`` of the items that share a seed with these words."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in range(len(w) - SEED + 1):
            if w[i] in self.first and (at := self.at.get(tuple(w[i : i + SEED]))):
                for k, j in at:
                    hits[k].append((i, j))
        out = []
        for k, pairs in hits.items():
            item = self.items[k][2]
            run, seen = 0, {}
            spans: list[list[int]] = []
            for i, j in pairs:  # in order of i: one exact stretch is walked once
                low, high = max(0, i - j - len(item) // 2), min(len(w), i - j + len(item) + len(item) // 2)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
                if seen.get(i - j, -1) >= i:
                    continue
                lo, hi = 0, SEED
                while i - lo > 0 and j - lo > 0 and w[i - lo - 1] == item[j - lo - 1]:
                    lo += 1
                while i + hi < len(w) and j + hi < len(item) and w[i + hi] == item[j + hi]:
                    hi += 1
                seen[i - j] = i + hi - 1
                run = max(run, lo + hi)
            out.append((k, run, [(a, b) for a, b in spans]))
        return out

    def find(self, texts: list[str | None], min_score: int) -> list[list[tuple]]:
        """For each text the items that share a run of ``min_run`` words with it or align with ``min_score``."""
        out: list[list[tuple]] = [[] for _ in texts]
        todo: list[tuple[int, int, int, int, np.ndarray]] = []
        for n, text in enumerate(texts):
            w = words_of(text)
            found = self.candidates(w) if len(w) >= SEED else []
            if not found:
                continue
            coded = np.array([self.number.get(x, -1) for x in w])
            for k, run, spans in found:
                # Twice the words in common bounds a score from above.
                todo += [(n, k, run, a, coded[a:b]) for a, b in spans if run >= self.min_run or 2 * int(np.isin(coded[a:b], self.coded[k]).sum()) >= min_score]
        scores = alignment_scores([(self.coded[k], part) for _, k, _, _, part in todo])
        best: dict[tuple[int, int], int] = {}
        for x, (n, k, run, _, _) in enumerate(todo):
            if (run >= self.min_run or scores[x] >= min_score) and ((n, k) not in best or scores[x] > scores[best[(n, k)]]):
                best[(n, k)] = x
        for (n, k), x in best.items():
            _, _, run, low, part = todo[x]
            score, matched, first, last = smith_waterman(self.coded[k], part)
            q, f, item = self.items[k]
            out[n].append((q, f, run, score, matched, len(item), low + first, low + last))
        return out


def _collect_items(items: DataFrame, fields: tuple[str, ...], max_chars: int) -> list[tuple[str, str, str]]:
    """The distinct item texts, after a check that they are small enough to send to every executor."""
    rows = None
    for f in fields:
        part = items.select(F.col("question_id"), F.lit(f).alias("field"), F.col(f).alias("text")).where("text IS NOT NULL AND question_id IS NOT NULL")
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.distinct()
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > max_chars:
        raise ValueError(f"held-out items have {size} characters, more than {max_chars}; pass them in blocks of items")
    return [tuple(r) for r in rows.collect()]


def leak_report(docs: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("passage", "question"), min_run: int = 10, min_score: int = 16, max_chars: int = 64_000_000) -> DataFrame:
    """One row for each document, item and field with enough in common.

    Enough is ``run_words >= min_run`` or an alignment score of ``min_score``
    (two a matching word, minus one an edit). Null or short texts match
    nothing; a document id that stands twice gives its rows twice. The items
    are broadcast after a check of their size; ``blocks_of_items`` serves more.
    """
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(SeedIndex(_collect_items(items, fields, max_chars), min_run))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(d, *r) for d, found in zip(batch["doc_id"], index.value.find(list(batch["text"]), min_score)) for r in found]
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL").mapInPandas(scan, SCHEMA)


def blocks_of_items(docs: DataFrame, items: DataFrame, blocks: int, **options) -> DataFrame:
    """:func:`leak_report` for items too many for one broadcast: the documents are read once a block."""
    part = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    out = None
    for k in range(blocks):
        found = leak_report(docs, items.where(part == k), **options)
        out = found if out is None else out.unionByName(found)
    return out


def leaked_documents(docs: DataFrame, items: DataFrame, min_run: int = 10) -> DataFrame:
    """``doc_id, question_id``: at least ``min_run`` consecutive words in common."""
    return leak_report(docs, items, min_run=min_run).where(F.col("run_words") >= min_run).select("doc_id", "question_id").distinct()
