"""Exact top-k retrieval: similarity, score, best record per round, rerank, budget.

Records of a user are cut into blocks by their round, so that a round stays
whole; a user's queries meet each of its blocks once. A block returns the best
rounds of each query, and the best of those are taken over all blocks. Every
result is exact, and no task holds more than one block and its queries.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType

from palimpsest.functions import dates, text
from palimpsest.operators.conflict import now_logical
from palimpsest.session import bounded, materialize

BLOCK = 20_000


@dataclass(frozen=True)
class Weights:
    """Weights of the parts of a score; each finite and not negative."""

    similarity: float = 1.0
    recency: float = 0.0
    time: float = 0.0
    half_life: float = 30.0

    def __post_init__(self):
        for w in (self.similarity, self.recency, self.time):
            if not (0 <= w < float("inf")):
                raise ValueError("weights must be finite and not negative")
        if not self.half_life > 0:
            raise ValueError("half_life must be positive")


def round_identity(round_key: Column, id_: Column) -> Column:
    """The round a record belongs to; a record without one is its own."""
    return F.coalesce(round_key, F.concat(F.lit("id:"), id_.cast("string")))


def recency(days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), days / F.lit(half_life))


def combined_score(similarity: Column, recent: Column, match: Column, salience: Column, w: Weights) -> Column:
    return (w.similarity * similarity + w.recency * recent + w.time * match) * salience


def _vec(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype="<f4").tobytes() for v in s], dtype=object)

    return F.pandas_udf(run, BinaryType())(c)


def _usable(c: Column, dim: int) -> Column:
    return F.coalesce((F.size(c) == dim) & F.exists(c, lambda x: x != 0), F.lit(False))


def rank_rounds(queries: DataFrame, records: DataFrame, k: int = 10, weights: Weights = Weights(), active_only: bool = True, kind: str | None = None, per_round: bool = True, dim: int = 64) -> DataFrame:
    """``qid, rank, id, round, similarity, recency, time_match, score``: the k best rounds of each query.

    queries: ``qid, user_id, embedding`` and, if a question names dates,
    ``start_day, end_day``. records: the columns of the store. Ties go by
    similarity, rounds before facts, then smaller id. Queries or records with
    unusable vectors take no part; a user without records gives no rows.
    """
    rec = records.where(_usable(F.col("embedding"), dim))
    rec = rec.where("salience > 0") if active_only else rec
    rec = rec.where(F.col("kind") == kind) if kind else rec
    eff = dates.effective_time(F.col("valid_time"), F.col("created_at"))
    low = F.when(eff.rlike(r"^\d+-\d+-\d+$"), F.try_to_date(eff, "y-M-d")).when(eff.rlike(r"^\d+-\d+$"), F.try_to_date(F.concat(eff, F.lit("-1")), "y-M-d"))
    high = F.when(eff.rlike(r"^\d+-\d+$"), F.last_day(low)).otherwise(low)
    # What is known of a user (clock, number of blocks) is joined once, by broadcast while there are few users.
    sizes = rec.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    users = bounded(materialize(sizes.join(now_logical(records), "user_id", "left"), "users"))
    identity = round_identity(F.col("round_key"), F.col("id")) if per_round else F.concat(F.lit("id:"), "id")
    rec = rec.join(users, "user_id").select(
        "user_id", "id", (F.col("kind") == "round").cast("int").alias("is_round"), "salience", identity.alias("round"),
        recency(dates.logical_days(F.col("now"), F.col("created_at")), weights.half_life).alias("recency"),
        F.unix_date(low).alias("low"), F.unix_date(high).alias("high"), _vec(F.col("embedding")).alias("vec"),
        F.pmod(F.xxhash64(identity), F.col("blocks")).cast("int").alias("block"),
    )
    start, end = (F.unix_date(F.col(c).cast("date")) if c in queries.columns else F.lit(None).cast("int") for c in ("start_day", "end_day"))
    asked = queries.where(_usable(F.col("embedding"), dim)).select("qid", "user_id", start.alias("start"), end.alias("end"), _vec(F.col("embedding")).alias("vec"))
    asked = asked.join(users, "user_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select("qid", F.col("user_id").alias("asker"), F.col("block").alias("part"), "start", "end", "vec")

    def unit(col):
        x = np.frombuffer(b"".join(col), dtype="<f4").reshape(-1, dim).astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        cols = ["qid", "id", "is_round", "round", "similarity", "recency", "time_match", "score"]
        if not len(q) or not len(r):
            return pd.DataFrame([], columns=cols)
        r = r.sort_values(["is_round", "id"], ascending=[False, True]).reset_index(drop=True)
        rounds, code = np.unique(r["round"].to_numpy().astype(str), return_inverse=True)
        x, s, rec_, lo, hi = unit(r["vec"]), r["salience"].to_numpy(), r["recency"].to_numpy(), r["low"].to_numpy(float), r["high"].to_numpy(float)
        qx, a, b = unit(q["vec"]), q["start"].to_numpy(float), q["end"].to_numpy(float)
        out = []
        for i in range(len(q)):
            cos = np.round(x @ qx[i], 9)
            match = ((lo <= b[i]) & (hi >= a[i])).astype(float)
            score = np.round((weights.similarity * cos + weights.recency * rec_ + weights.time * match) * s, 9)
            order = np.lexsort((np.arange(len(r)), -cos, -score))
            _, first = np.unique(code[order], return_index=True)
            top = order[np.sort(first)[:k]]
            out.append(pd.DataFrame({"qid": q["qid"].iloc[i], "id": r["id"].to_numpy()[top], "is_round": r["is_round"].to_numpy()[top], "round": r["round"].to_numpy()[top], "similarity": cos[top], "recency": rec_[top], "time_match": match[top], "score": score[top]}))
        return pd.concat(out)[cols]

    found = asked.groupBy("asker", "part").cogroup(rec.groupBy("user_id", "block")).applyInPandas(best, "qid bigint, id bigint, is_round int, round string, similarity double, recency double, time_match double, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("similarity"), F.desc("is_round"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "round", "similarity", "recency", "time_match", "score")


def record_text(fact: Column, turns: Column, content: Column) -> Column:
    """What of a record is compared with a question: its fact, else its turns, else its content."""
    lines = F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t.role, F.lit("")), F.lit(": "), F.coalesce(t.content, F.lit("")))), "\n")
    return F.coalesce(fact, F.when(F.size(turns) > 0, lines), content)


def pair_scorer(score: Callable[[list[tuple[str, str]]], list[float]]) -> Callable[[Column, Column], Column]:
    """A model that scores lists of (question, passage), as a function of two columns; it is called with batches."""

    def run(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(list(score(list(zip(q.fillna(""), p.fillna(""))))), dtype=float)

    return F.pandas_udf(run, DoubleType())


def rerank_rounds(candidates: DataFrame, questions: DataFrame, records: DataFrame, k: int = 10, scorer: Callable[[Column, Column], Column] = text.overlap_share, active_only: bool = True) -> DataFrame:
    """``qid, rank, round, pair_score``: candidate rounds ordered by the best score of any of their members.

    candidates: from :func:`rank_rounds` over a pool. questions: ``qid,
    user_id, question``. Members of a round are the record that ranked it and
    its facts, of which inactive ones count only if they are asked for. scorer:
    of question and passage, word overlap by default or a model
    (:func:`pair_scorer`). Ties keep the candidates' order.
    """
    passage = record_text(F.col("fact"), F.col("turns"), F.col("content"))
    wanted = candidates.select("qid", "round", F.col("rank").alias("seed"), F.col("id").alias("own")).join(questions, "qid")
    members = records.select("user_id", "id", round_identity(F.col("round_key"), F.col("id")).alias("round"), (F.col("kind") == "fact").alias("is_fact"), (F.col("salience") > 0).alias("active"), passage.alias("passage"))
    paired = wanted.join(members, ["user_id", "round"]).where((F.col("id") == F.col("own")) | (F.col("is_fact") & (F.col("active") | F.lit(not active_only))))
    scored = paired.withColumn("pair_score", scorer(F.col("question"), F.col("passage"))).groupBy("qid", "round", "seed").agg(F.max("pair_score").alias("pair_score"))
    w = Window.partitionBy("qid").orderBy(F.desc("pair_score"), "seed")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "round", "pair_score")


def above_floor(hits: DataFrame, least: float) -> DataFrame:
    """Hits of at least a similarity; a floor of 0 or less keeps all. Nothing fills the gaps."""
    return hits.where(F.col("similarity") >= least) if least > 0 else hits


def recall_updates(hits: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """``id, last_accessed`` to write after a recall: each hit's representative record was read now."""
    seen = hits.join(queries.select("qid", "user_id"), "qid").join(now_logical(records), "user_id")
    return seen.groupBy("id").agg(F.max("now").alias("last_accessed"))


def within_budget(hits: DataFrame, cost: Column, budget: int) -> DataFrame:
    """The longest prefix of each query's hits within a budget, at least the first; adds ``spent``."""
    w = Window.partitionBy("qid").orderBy("rank")
    return hits.withColumn("spent", F.sum(cost).over(w)).where((F.col("spent") <= budget) | (F.col("rank") == 1))


_HASHED = re.compile(r"\w+")


def hash_embedding(body: str, dim: int) -> list[float]:
    """Signed feature hashing of the words of a text, of unit length; zeros for no words."""
    v = np.zeros(dim)
    for w in _HASHED.findall(body.lower()):
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        v[int.from_bytes(h[:4], "little") % dim] += 1.0 if h[4] & 1 else -1.0
    n = float(np.linalg.norm(v))
    return (v / n if n else v).astype("f4").tolist()


def hash_embedding_column(c: Column, dim: int = 64) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hash_embedding(t, dim) if isinstance(t, str) else None)

    return F.pandas_udf(run, ArrayType(FloatType()))(c)
