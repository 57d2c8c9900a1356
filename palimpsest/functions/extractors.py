"""What reads facts from rounds: rules, a script, a model, and steps around them.

An extractor turns a frame of rounds, ``key, turns``, into ``key, facts,
truncated``: facts are an array of ``extraction.FACT``, truncated says that an
output broke off. Extractors are composed as frames are, so that a step around
a model runs in the cluster like any other.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from palimpsest.functions import extraction, triples
from palimpsest.functions.extraction import FACT, PARSED, restore_backslashes, rule_facts_column, split_text_column
from palimpsest.session import materialize

Extractor = Callable[[DataFrame], DataFrame]

#: Facts at which an output counts as full.
FULL = 8


def canonical(value) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode("utf-8", "surrogatepass")).hexdigest()


def rule_digests() -> dict[str, str]:
    """Digests of the rules by which a store is written, for its guard rows."""
    lists = ("ACK", "GREETING", "CLOSING", "BOILERPLATE", "SELF_REFERENCE", "IMPERATIVE", "POLITE", "ANAPHORA", "FILLER", "FIRST_PERSON", "DATE_WORDS", "QUESTION_WORDS", "SHORT", "ORDER", "NO_ANSWER")
    return {
        "prefilter_rules": digest({name: getattr(extraction, name) for name in lists}),
        "negation_rules": digest([triples.MARKERS, triples.ANTONYMS]),
        "conflict_rules": digest([triples.FUNCTIONAL, triples.ARTICLES, triples.FIRST_PERSON, triples.AUXILIARIES, triples.NUMBER_WORDS, triples.MAX_VALUE_WORDS]),
    }


def rules(rounds: DataFrame) -> DataFrame:
    """Statements of user turns in the first person."""
    return rounds.select("key", rule_facts_column(F.col("turns")).alias("facts"), F.lit(False).alias("truncated"))


def scripted(script: dict[str, list[tuple]]) -> Extractor:
    """Facts, as tuples of ``extraction.FIELDS``, looked up by a round's first user turn; nothing for others."""

    def extract(rounds: DataFrame) -> DataFrame:
        first = F.try_element_at(F.filter("turns", lambda t: t["role"] == "user"), F.lit(1))["content"]
        known = [F.when(first == said, F.lit(json.dumps([dict(zip(FACT.names, f)) for f in facts]))) for said, facts in script.items()]
        found = F.coalesce(*known, F.lit("[]"))
        return rounds.select("key", F.from_json(found, ArrayType(FACT)).alias("facts"), F.lit(False).alias("truncated"))

    return extract


def model(call: Callable[[list[tuple[str, str]]], tuple[list[tuple], bool]]) -> Extractor:
    """A Python model, called with a round's (role, content) pairs; gives tuples of ``extraction.FIELDS`` and whether it broke off."""

    def run(s: pd.Series) -> pd.Series:
        def one(turns) -> str:
            facts, broken = call([(t["role"] or "", t["content"] or "") for t in (turns if turns is not None else [])])
            return json.dumps({"facts": [dict(zip(FACT.names, f)) for f in facts], "truncated": broken})

        return s.map(one)

    def extract(rounds: DataFrame) -> DataFrame:
        out = rounds.select("key", F.from_json(F.pandas_udf(run, StringType())("turns"), PARSED).alias("out"))
        return out.select("key", "out.facts", "out.truncated")

    return extract


def escaping(inner: Extractor) -> Extractor:
    """The inner extractor sees slashes for backslashes; its facts come back spelled as the turns are."""

    def extract(rounds: DataFrame) -> DataFrame:
        shown = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.translate(t["content"], "\\", "/").alias("content")))
        out = inner(rounds.withColumn("turns", shown)).join(rounds.select("key", "turns"), "key")

        def respelled(f: Column) -> Column:
            return F.struct(*[(restore_backslashes(f[c], F.col("turns")) if c in ("content", "subject", "predicate", "object") else f[c]).alias(c) for c in FACT.names])

        return out.select("key", F.transform("facts", respelled).alias("facts"), "truncated")

    return extract


def splitting(inner: Extractor, most: int = 600) -> Extractor:
    """A round whose output is empty, full or broken is read again in pieces of up to ``most`` characters a turn.

    Piece n of a round holds the nth piece of each turn that has one. The
    pieces' facts are taken where there are more of them; a round of a single
    piece keeps what it has.
    """

    def extract(rounds: DataFrame) -> DataFrame:
        whole = materialize(inner(rounds), "whole")
        poor = whole.where(F.col("truncated") | (F.size("facts") == 0) | (F.size("facts") >= FULL)).select("key")
        turns = rounds.join(poor, "key", "left_semi").select("key", F.posexplode("turns").alias("turn", "t"))
        cut = turns.select("key", "turn", "t.role", F.posexplode(split_text_column(F.coalesce("t.content", F.lit("")), most)).alias("piece", "content"))
        pieces = cut.groupBy("key", "piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))
        long = pieces.where("piece > 0").select("key").distinct()
        pieces = materialize(pieces.join(long, "key", "left_semi").withColumn("whole_key", F.col("key")).withColumn("key", F.concat_ws("\u0001", F.col("key").cast("string"), "piece")), "pieces")
        read = inner(pieces.select("key", "turns")).join(pieces.select("key", "whole_key", "piece"), "key")
        parts = F.array_sort(F.collect_list(F.struct("piece", "facts")))
        more = read.groupBy(F.col("whole_key").alias("key")).agg(F.flatten(F.transform(parts, lambda p: p["facts"])).alias("more"), F.bool_or("truncated").alias("more_truncated"))
        better = F.coalesce(F.size("more") > F.size("facts"), F.lit(False))
        both = whole.join(more, "key", "left")
        return both.select("key", F.when(better, F.col("more")).otherwise(F.col("facts")).alias("facts"), F.when(better, F.col("more_truncated")).otherwise(F.col("truncated")).alias("truncated"))

    return extract


def turns_key(turns: Column) -> Column:
    """The key under which an extractor's output for a round is kept: a digest of roles and contents."""
    return F.sha2(F.to_json(F.transform(turns, lambda t: F.struct(t.role.alias("role"), t.content.alias("content"))), {"ignoreNullFields": "false"}), 256)


def distinct_rounds(rounds: DataFrame) -> DataFrame:
    """``key, turns``: each round once, under its digest."""
    plain = F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.content.alias("content")))
    return rounds.select(turns_key(F.col("turns")).alias("key"), plain.alias("turns")).groupBy("key").agg(F.first("turns").alias("turns"))


def cached_extract(rounds: DataFrame, extractor: Extractor, cache: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rounds with ``facts`` and ``truncated``, and what is new to the cache: only keys that it lacks reach the extractor.

    cache: ``key, facts, truncated``.
    """
    todo = distinct_rounds(rounds)
    if cache is not None:
        todo = todo.join(cache.select("key"), "key", "left_anti")
    fresh = materialize(extractor(todo).select("key", "facts", "truncated"), "extracted")
    known = fresh if cache is None else cache.select(*fresh.columns).unionByName(fresh)
    return rounds.withColumn("key", turns_key(F.col("turns"))).join(known, "key").drop("key"), fresh
