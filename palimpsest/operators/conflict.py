"""Contradicting facts: which pairs conflict, which side stands, what is updated.

Facts of one user and pair key are compared in order of id. The pass reads the
sorted facts of a partition as a stream and keeps, of the key at hand, only the
facts that still stand, in indexes by what they conflict with; every pair that
it looks at ends with a fact that has lost, so that a key of any size takes one
reading. Keys in which every pair conflicts can also be resolved by a window
(``champions``), which spreads a hot key's rows over aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import dates, text, triples
from palimpsest.session import materialize


def trust(raw: Column) -> Column:
    """1 where the user said it."""
    return F.coalesce(F.startswith(raw, F.lit("user:")), F.lit(False)).cast("int")


def order_key(valid_time: Column, created_at: Column, raw: Column, id_: Column) -> Column:
    """What makes a fact stand over another: time it speaks of, session date, timestamp, trust, id."""
    return F.struct(dates.effective_key(valid_time, created_at).alias("t"), dates.session_key(created_at).alias("s"), F.coalesce(created_at, F.lit("")).alias("c"), trust(raw).alias("u"), F.coalesce(id_, F.lit(0)).alias("i"))


def keyed_facts(memories: DataFrame) -> DataFrame:
    """Facts with a pair key and a usable triple, with ``triple`` and ``ok`` (order key)."""
    return ordered_facts(memories).where("pair_key IS NOT NULL AND pair_key <> ''")


def ordered_facts(memories: DataFrame) -> DataFrame:
    """Facts with ``triple``, null where there is none, and ``ok``."""
    f = memories.where("kind = 'fact'").withColumn("triple", triples.triple_column(F.col("subject"), F.col("predicate"), F.col("object")))
    return f.withColumn("ok", order_key(F.col("valid_time"), F.col("created_at"), F.col("raw"), F.col("id")))


class _Standing:
    """The facts of one key that stand, by what a later fact may conflict with."""

    def __init__(self):
        self.by_object: dict[tuple, dict] = {}
        self.functional: dict[str, dict] = {}
        self.numeric: dict[str, dict[str, dict]] = {}

    def _places(self, f) -> list[dict]:
        """The indexes that hold a fact. Facts of the assistant and without a triple conflict with nothing."""
        if f.object is None or f.subject == "assistant":
            return []
        places = [self.by_object.setdefault((f.object, f.polarity), {})]
        if _valued(f):
            if f.functional:
                places.append(self.functional.setdefault(f.object, {}))
            elif f.numbers:
                places.append(self.numeric.setdefault(f.residue, {}).setdefault(f.numbers, {}))
        return places

    def add(self, f) -> None:
        for place in self._places(f):
            place[f.id] = f

    def remove(self, f) -> None:
        for place in self._places(f):
            place.pop(f.id, None)
        same_residue = self.numeric.get(f.residue, {})
        for index, key in ((self.by_object, (f.object, f.polarity)), (self.functional, f.object), (same_residue, f.numbers), (self.numeric, f.residue)):
            if key in index and not index[key]:
                del index[key]

    def against(self, f) -> list[tuple]:
        """``fact, rule`` of the standing facts that conflict with a later one, in order of id."""
        if f.object is None:
            return []
        found = [(x, "negation") for x in self.by_object.get((f.object, -f.polarity), {}).values()]
        if _valued(f):
            found += [(x, "functional") for value, facts in self.functional.items() if value != f.object for x in facts.values()]
            if f.numbers:
                found += [(x, "numeric") for numbers, facts in self.numeric.get(f.residue, {}).items() if numbers != f.numbers for x in facts.values() if x.object != f.object]
        return sorted(found, key=lambda x: x[0].id)


def _valued(f) -> bool:
    """An affirmed value, not a clause."""
    return f.polarity > 0 and len(f.object.split()) <= triples.MAX_VALUE_WORDS


def resolve_all(facts: DataFrame) -> DataFrame:
    """``loser, winner, rule`` of the pass over all pairs of each key in order of id.

    A fact that lost takes no further part. facts: ``id, user_id, pair_key,
    triple, ok`` with ``ok`` as from :func:`order_key`. Facts without a user
    take no part. A key's facts are one task's stream, of which it holds those
    that stand.
    """
    cols = ["id", "user_id", "pair_key", "triple.object", "triple.polarity", "triple.functional", F.col("triple.subject").alias("subject"), F.to_json("ok").alias("ok"), *_numbers()]
    ranked = facts.where("user_id IS NOT NULL AND pair_key IS NOT NULL").select(*cols).withColumn("polarity", F.coalesce("polarity", F.lit(0)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, standing = None, _Standing()
        for b in batches:
            out = []
            for f in b.itertuples(index=False):
                if (f.user_id, f.pair_key) != key:
                    key, standing = (f.user_id, f.pair_key), _Standing()
                mine, lost = None, False
                for other, rule in standing.against(f):
                    mine = mine or _order(f.ok)
                    if mine > _order(other.ok):
                        standing.remove(other)
                        out.append((other.id, f.id, rule))
                    else:
                        out.append((f.id, other.id, rule))
                        lost = True
                        break
                if not lost:
                    standing.add(f)
            yield pd.DataFrame(out, columns=["loser", "winner", "rule"])

    ordered = ranked.repartition("user_id", "pair_key").sortWithinPartitions("user_id", "pair_key", "id")
    return ordered.mapInPandas(walk, "loser bigint, winner bigint, rule string")


def of_assistant(triple: Column, fact: Column) -> Column:
    """Whether a fact speaks of the assistant, by its triple, or without one by how its text begins."""
    return F.coalesce(triple["subject"] == "assistant", F.startswith(text.exact_key(F.coalesce(fact, F.lit(""))), F.lit("the assistant")))


def resolve_new(facts: DataFrame, new: DataFrame, negated: DataFrame | None = None) -> DataFrame:
    """``loser, winner, rule`` of what new facts contradict, without a pass over the other keys.

    facts: the standing facts, ``id, user_id, pair_key, fact, triple, ok``;
    new: ``id`` of those that are new. Only keys of new facts are read. negated:
    ``id, neighbour`` pairs that the negation screen kept apart; they conflict
    where the two have no keys to meet by, neither speaks of the assistant and
    both still stand.
    """
    keyed = facts.where("pair_key IS NOT NULL AND pair_key <> ''")
    touched = keyed.join(new, "id", "left_semi").select("user_id", "pair_key").distinct()
    lost = resolve_all(keyed.join(touched, ["user_id", "pair_key"], "left_semi"))
    if negated is None:
        return lost
    lost = materialize(lost, "lost")
    side = facts.join(lost.select(F.col("loser").alias("id")), "id", "left_anti").where(~of_assistant(F.col("triple"), F.col("fact")))
    a, b = side.select("id", F.col("pair_key").alias("k"), "ok"), side.select(F.col("id").alias("neighbour"), F.col("pair_key").alias("k2"), F.col("ok").alias("ok2"))
    met = negated.join(new, "id", "left_semi").join(a, "id").join(b, "neighbour").where("k IS NULL OR k = '' OR k2 IS NULL OR k2 = ''")
    later = F.col("ok") > F.col("ok2")
    return lost.unionByName(met.select(F.when(later, F.col("neighbour")).otherwise(F.col("id")).alias("loser"), F.when(later, F.col("id")).otherwise(F.col("neighbour")).alias("winner"), F.lit("negation").alias("rule")))


def _numbers() -> list[Column]:
    value = F.col("triple.object")
    return [F.array_join(text.numbers_of(value), " ").alias("numbers"), text.number_residue(value).alias("residue")]


def _order(s: str) -> tuple:
    import json

    o = json.loads(s)
    return (tuple(o["t"].values()), tuple(o["s"].values()), o["c"], o["u"], o["i"])


def champions(facts: DataFrame, key: list[str], value: str, order: Column, id_col: str = "id") -> DataFrame:
    """Fast path where every pair of a key conflicts: ``id, winner, is_active, supersedes``.

    Row and champion of the rows before it meet once; the loser is recorded
    at the winner, which keeps the highest id of those it beat.
    """
    w = Window.partitionBy(*key).orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)
    state = facts.select(*key, F.col(id_col).alias("id"), F.struct(order.alias("o"), F.col(id_col).alias("i")).alias("k"))
    met = state.withColumn("before", F.max("k").over(w))
    duels = met.where("before IS NOT NULL").select(*key, F.greatest("k", "before").alias("win"), F.least("k", "before").alias("lose"))
    beaten = duels.groupBy(*key, F.col("win.i").alias("id")).agg(F.max("lose.i").alias("supersedes"))
    best = state.groupBy(*key).agg(F.max("k").alias("best"))
    joined = state.join(best, key).join(beaten, [*key, "id"], "left")
    return joined.select(*key, "id", (F.col("best.i") == F.col("id")).alias("is_active"), "supersedes")


def supersede_updates(losers: DataFrame) -> DataFrame:
    """``id, salience, supersedes`` to write: losers get salience 0, winners the highest loser."""
    lost = losers.select(F.col("loser").alias("id"), F.lit(0.0).alias("salience"), F.lit(None).cast("bigint").alias("supersedes"))
    won = losers.groupBy(F.col("winner").alias("id")).agg(F.max("loser").alias("supersedes")).select("id", F.lit(None).cast("double").alias("salience"), "supersedes")
    return lost.unionByName(won).groupBy("id").agg(F.min("salience").alias("salience"), F.max("supersedes").alias("supersedes"))


def apply_updates(memories: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """A new version of the records: updated values where there are some, else what was there."""
    new = updates.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    got = memories.join(new, "id", "left")
    return got.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in memories.columns])


def reason(rule: Column, key: Column, lost: Column, won: Column) -> Column:
    """The line that is logged for a superseded fact."""
    return F.concat(rule, F.lit(" "), key, F.lit(": "), lost, F.lit(" -> "), won)


# --- decay -------------------------------------------------------------------


def now_logical(memories: DataFrame) -> DataFrame:
    """``user_id, now``: the latest dated timestamp of each user, ties by text."""
    d = memories.select("user_id", F.struct(dates.anchor_date(F.col("created_at")).alias("d"), F.col("created_at").alias("ts")).alias("k")).where("k.d IS NOT NULL")
    return d.groupBy("user_id").agg(F.max("k").alias("k")).select("user_id", F.col("k.ts").alias("now"))


def decayed(initial: Column, days: Column, half_life: float = 30.0, floor: float = 0.15) -> Column:
    """Salience halves with every half-life, down to the floor, or to where it began if that is lower."""
    return F.greatest(F.least(F.lit(floor), initial), initial * F.pow(F.lit(0.5), days / F.lit(half_life)))


def decay(memories: DataFrame, half_life: float = 30.0, floor: float = 0.15) -> DataFrame:
    """``id, salience`` of active records whose salience changes by their user's logical time."""
    clock = now_logical(memories)
    active = memories.where("salience > 0").join(clock, "user_id", "left")
    new = decayed(F.coalesce("initial_salience", "salience"), dates.logical_days(F.col("now"), F.col("last_accessed")), half_life, floor)
    return active.select("id", F.col("salience").alias("was"), new.alias("salience")).where(F.abs(F.col("salience") - F.col("was")) > 1e-9).select("id", "salience")


def consolidate(memories: DataFrame, half_life: float = 30.0, floor: float = 0.15) -> DataFrame:
    """The records after the pass over contradictions and decay; a second pass changes nothing."""
    losers = resolve_all(keyed_facts(memories.where("salience > 0")))
    resolved = apply_updates(memories, supersede_updates(losers), ["salience", "supersedes"])
    return apply_updates(resolved, decay(resolved, half_life, floor), ["salience"])
