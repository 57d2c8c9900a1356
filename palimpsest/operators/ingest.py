"""From messages to rounds, pieces and the texts that are embedded.

A session's turns stand in one array, so segmentation is a fold within the
row: no shuffle, whatever the number of sessions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from palimpsest.functions import dates, extraction, text


def sessions_once(sessions: DataFrame) -> DataFrame:
    """Sessions delivered more than once, kept as they first arrived."""
    picked = sessions.groupBy("session_id").agg(F.min_by(F.struct("user_id", "session_date", "turns"), F.struct(F.coalesce(F.col("arrived_at").cast("string"), F.lit("9")))).alias("s"))
    return picked.select("session_id", "s.*")


def with_defaults(sessions: DataFrame) -> DataFrame:
    """Missing dates become empty, missing turns no turns, missing flags false."""
    return sessions.withColumns({
        "session_date": F.coalesce("session_date", F.lit("")),
        "turns": F.transform(F.coalesce("turns", F.array().cast("array<struct<role:string,content:string,has_answer:boolean>>")), lambda t: F.struct(F.coalesce(t.role, F.lit("")).alias("role"), F.coalesce(t.content, F.lit("")).alias("content"), F.coalesce(t.has_answer, F.lit(False)).alias("has_answer"))),
    })


def messages(sessions: DataFrame) -> DataFrame:
    """``session_id, user_id, turn, role, content, ts``: one row a turn, stamped with its session's date."""
    return with_defaults(sessions).select("session_id", "user_id", F.posexplode("turns").alias("turn", "t"), F.col("session_date").alias("ts")).select("session_id", "user_id", "turn", "t.role", "t.content", "ts")


def with_rounds(df: DataFrame) -> DataFrame:
    """Adds ``rounds`` from ``turns``: a user turn with the assistant's turn right after it, else one turn.

    Blank turns are dropped first. The steps are columns of their own, so that
    each is computed once a row and not once for every use.
    """
    kept = df.withColumn("__kept", F.filter("turns", lambda t: text.strip(t.content) != ""))
    roles = kept.withColumn("__roles", F.transform("__kept", lambda t: t.role)).withColumn("__n", F.size("__kept"))
    follows = lambda r, i: (r == "assistant") & (i > 0) & (F.get(F.col("__roles"), i - 1) == "user")
    marks = F.transform("__roles", lambda r, i: F.when(follows(r, i), F.lit(-1)).otherwise(i))
    opened = roles.withColumn("__opens", F.filter(marks, lambda i: i >= 0))
    ends = F.concat(F.slice("__opens", 2, F.greatest(F.size("__opens"), F.lit(1))), F.array("__n"))
    paired = opened.withColumn("__pairs", F.arrays_zip(F.col("__opens").alias("a"), ends.alias("b")))
    cut = F.transform("__pairs", lambda r: F.slice(F.col("__kept"), r["a"] + 1, r["b"] - r["a"]))
    none = F.array().cast("array<array<struct<role:string,content:string,has_answer:boolean>>>")
    # The second use of the turns keeps the optimizer from computing them anew for every round.
    return paired.withColumn("rounds", F.when(F.size("__kept") > 0, cut).otherwise(none)).drop("__kept", "__roles", "__n", "__opens", "__pairs")


def rounds(sessions: DataFrame) -> DataFrame:
    """``session_id, user_id, ts, round_no, turns, roles, text, has_evidence`` of every round."""
    cut = with_rounds(with_defaults(sessions)).select("session_id", "user_id", F.col("session_date").alias("ts"), F.posexplode_outer("rounds").alias("round_no", "turns")).where("turns IS NOT NULL")  # outer: else a filter on the size repeats the whole fold
    return cut.select("*", F.array_join(F.transform("turns", lambda t: t.role), "+").alias("roles"), round_text(F.col("turns")).alias("text"), F.exists("turns", lambda t: t.has_answer).alias("has_evidence"))


def round_text(turns: Column) -> Column:
    """Stripped texts of the turns, a line each."""
    return F.array_join(F.transform(turns, lambda t: text.strip(t.content)), "\n")


def embed_text(ts: Column, body: Column) -> Column:
    """What of a round is embedded: its text after its session's date, if it has one."""
    return F.when(F.coalesce(ts, F.lit("")) == "", body).otherwise(F.concat(F.lit("[Session date: "), dates.date_of(ts), F.lit("] "), body))


def fact_embed_text(raw: Column, fact: Column) -> Column:
    return F.concat(F.coalesce(raw, F.lit("")), F.lit("\n"), F.coalesce(fact, F.lit("")))


def round_key(ts: Column, body: Column) -> Column:
    """Session date and digest of the text; a null date reads ``None``."""
    return F.concat(F.coalesce(ts, F.lit("None")), F.lit("|"), F.substring(F.sha2(body, 256), 1, 16))


def window_pieces(rounds_df: DataFrame, size: int = 64, overlap: int = 16, places: Callable[[str], list[tuple[int, int]]] | None = None) -> DataFrame:
    """``session_id, round_no, piece, text``: windows of each round's tokens; rounds of up to ``size`` tokens are one piece.

    Tokens are words, or what a tokenizer finds: ``places`` gives the start and
    end of each token of a text, and a window is the text from its first to its
    last token.
    """
    if places is not None:

        def run(s: pd.Series) -> pd.Series:
            def cut(t: str) -> list[str]:
                at = places(t)
                if len(at) <= size:
                    return [t]
                firsts = range(0, len(at) - overlap, size - overlap)
                return [t[at[k][0] : at[min(k + size, len(at)) - 1][1]] for k in firsts]

            return s.map(lambda t: cut(t) if isinstance(t, str) else [])

        return rounds_df.select("session_id", "round_no", F.posexplode(F.pandas_udf(run, ArrayType(StringType()))("text")).alias("piece", "text"))
    words = text.tokens(text.collapse(F.col("text")))
    cut = rounds_df.select("session_id", "round_no", F.posexplode_outer(text.windows(words, size, overlap)).alias("piece", "w"))
    return cut.select("session_id", "round_no", "piece", F.array_join("w", " ").alias("text"))


def prefiltered(rounds_df: DataFrame) -> DataFrame:
    """Adds ``rules`` (of turns that hold no fact) and ``keep`` (a turn is left)."""
    turns = rounds_df.select("session_id", "round_no", F.posexplode("turns").alias("turn", "t"))
    ruled = turns.select("session_id", "round_no", "turn", "t.role", extraction.drop_rule_column(F.col("t.role"), F.col("t.content")).alias("rule"))
    by_round = ruled.groupBy("session_id", "round_no").agg(F.array_sort(F.collect_list("rule")).alias("rules"), (F.count("rule") < F.count(F.lit(1))).alias("keep"))
    return rounds_df.join(by_round, ["session_id", "round_no"])


def drop_rates(rounds_df: DataFrame) -> DataFrame:
    """``role, rule, turns, evidence_turns``: what the prefilter drops, and how much of it was evidence."""
    t = rounds_df.select(F.explode("turns").alias("t")).select("t.*")
    ruled = t.select("role", "has_answer", F.coalesce(extraction.drop_rule_column(F.col("role"), F.col("content")), F.lit("kept")).alias("rule"))
    return ruled.groupBy("role", "rule").agg(F.count(F.lit(1)).alias("turns"), F.count_if("has_answer").alias("evidence_turns"))


def fact_pieces(rounds_df: DataFrame) -> DataFrame:
    """Facts that the rules read from each round, verified, dated and brought to one form.

    ``session_id, user_id, ts, round_no, n, content, raw, how, time_mention, valid_time``.
    """
    got = rounds_df.select("session_id", "user_id", "ts", "round_no", "turns", "text", F.posexplode_outer(extraction.rule_facts_column(F.col("turns"))).alias("n", "f")).where("f IS NOT NULL")
    plain = F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.content.alias("content")))
    seen = got.withColumn("v", extraction.verify_raw_column(F.col("f.content"), F.col("f.raw"), plain)).withColumn("mention", dates.mention_in(F.col("f.when"), F.col("text")))
    return seen.select("session_id", "user_id", "ts", "round_no", "n", "f.content", "v.raw", "v.how", F.col("mention").alias("time_mention"), dates.resolve_column(F.col("mention"), F.col("ts"), F.col("f.content")).alias("valid_time"))


def pieces(rounds_df: DataFrame, size: int = 64, overlap: int = 16) -> DataFrame:
    """Windows and facts of rounds as rows to store: ``session_id, round_no, piece, kind, content, round_key``."""
    keyed = rounds_df.select("session_id", "round_no", F.col("ts").alias("__ts"), round_key(F.col("ts"), F.col("text")).alias("round_key"))
    w = window_pieces(rounds_df, size, overlap).join(keyed, ["session_id", "round_no"])
    w = w.select("session_id", "round_no", "piece", F.lit("round").alias("kind"), embed_text(F.col("__ts"), F.col("text")).alias("content"), "round_key")
    f = fact_pieces(rounds_df).join(keyed.drop("__ts"), ["session_id", "round_no"])
    f = f.select("session_id", "round_no", F.col("n").alias("piece"), F.lit("fact").alias("kind"), fact_embed_text(F.col("raw"), F.col("content")).alias("content"), "round_key")
    return w.unionByName(f)


def evidence_arm(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Messages of the sessions that a question's evidence names: ``question_id`` and the message columns."""
    return messages(sessions).join(wanted.select("question_id", "session_id").distinct(), "session_id")
