"""One store with its write and read paths: add, recall, context, consolidate, export.

Calls plan whole DataFrames; many users and sessions go through one call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import dates, triples
from palimpsest.functions.extractors import Extractor, distinct_rounds, rules, turns_key
from palimpsest.functions.extraction import verify_raw_column
from palimpsest.operators import conflict, dedup, ingest, render, retrieve
from palimpsest.session import materialize
from palimpsest.sources.schema import Config
from palimpsest.sources.store import Store

DIM = 64


class Memory:
    """embed: a function from a text column to an ``array<float>`` column of ``DIM`` numbers."""

    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), extractor: Extractor | None = None, embed=retrieve.hash_embedding_column):
        self.store, self.config, self.extractor, self.embed = Store(spark, path, config), config, extractor, embed
        self.spark = spark

    # --- write ---------------------------------------------------------------

    def _pieces(self, sessions: DataFrame) -> DataFrame:
        rounds = ingest.rounds(sessions)
        turns = F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.content.alias("content")))
        base = rounds.select("user_id", "ts", "session_id", "round_no", turns.alias("turns"), "roles", "text", ingest.round_key(F.col("ts"), F.col("text")).alias("round_key"))
        if self.config.chunk_tokens:
            cut = ingest.window_pieces(rounds, self.config.chunk_tokens, self.config.chunk_overlap).withColumnRenamed("text", "body")
        else:
            cut = rounds.select("session_id", "round_no", F.lit(0).alias("piece"), F.col("text").alias("body"))
        null = F.lit(None).cast("string")
        facts_cols = ("fact", "raw", "subject", "predicate", "object", "valid_time", "time_mention", "pair_key")
        r = base.join(cut, ["session_id", "round_no"]).select("user_id", "ts", "session_id", "round_no", "piece", "turns", "roles", "round_key", F.lit("round").alias("kind"), ingest.embed_text(F.col("ts"), F.col("body")).alias("content"), F.lit(1.0).alias("salience"), *[null.alias(c) for c in facts_cols])
        if self.extractor is None:
            return r
        kept = ingest.prefiltered(rounds).where("keep").select("session_id", "round_no")
        asked = materialize(base.join(kept, ["session_id", "round_no"]).withColumn("key", turns_key(F.col("turns"))), "asked")
        got = asked.join(self.extractor(distinct_rounds(asked)), "key").select("*", F.posexplode_outer("facts").alias("piece", "f")).where("f IS NOT NULL")
        got = got.withColumn("v", verify_raw_column(F.col("f.content"), F.col("f.raw"), F.col("turns"))).withColumn("mention", dates.mention_in(F.col("f.when"), F.col("text"))).withColumn("t", triples.triple_column(F.col("f.subject"), F.col("f.predicate"), F.col("f.object")))
        f = got.select(
            "user_id", "ts", "session_id", "round_no", "piece", "turns", "roles", "round_key", F.lit("fact").alias("kind"), ingest.fact_embed_text(F.col("v.raw"), F.col("f.content")).alias("content"), F.col("f.salience").alias("salience"),
            F.col("f.content").alias("fact"), F.col("v.raw").alias("raw"), F.col("f.subject").alias("subject"), F.col("f.predicate").alias("predicate"), F.col("f.object").alias("object"),
            dates.resolve_column(F.col("mention"), F.col("ts"), F.col("f.content")).alias("valid_time"), F.col("mention").alias("time_mention"), F.concat_ws("|", F.col("t.subject"), F.col("t.predicate")).alias("k"),
        )
        return r.unionByName(f.withColumn("pair_key", F.nullif(F.col("k"), F.lit(""))).drop("k"))

    def add(self, sessions: DataFrame, screens: bool = True) -> dict[str, int]:
        """Store what sessions say: duplicates of earlier records are dropped, contradicted facts superseded.

        sessions: ``session_id, user_id, session_date, turns``. Sessions of a
        user are taken in order of id. Without ``screens`` every piece is stored,
        which is what a plain retrieval store does. Returns counts by outcome.
        """
        old = self.store.read()
        last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        pieces = materialize(self._pieces(sessions), "pieces")
        # Ids follow users, sessions and rounds; places within a user come from one window, users from counts.
        w = Window.partitionBy("user_id").orderBy("session_id", "round_no", F.desc("kind"), "piece")
        placed = pieces.withColumn("n", F.row_number().over(w))
        counts = pieces.groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
        counts = counts.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(1024)))
        earlier = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # Only the sums of 1,024 parts are added up in one place.
        parts = counts.groupBy("part").agg(F.sum("c").alias("c")).select("part", earlier(Window.orderBy("part")).alias("base"))
        inner = counts.select("user_id", "part", earlier(Window.partitionBy("part").orderBy("user_id")).alias("o"))
        before = inner.join(F.broadcast(parts), "part").select(F.col("user_id").alias("u"), (F.col("base") + F.col("o")).alias("b"))
        new = placed.join(before, placed.user_id.eqNullSafe(before.u)).withColumn("id", F.lit(last) + F.col("b") + F.col("n"))
        new = new.select(
            "id", "user_id", "content", F.col("ts").alias("created_at"), "salience", F.col("roles").alias("source"), F.lit(None).cast("bigint").alias("supersedes"), "turns", "round_key", "kind", "fact", "raw", "subject", "predicate", "object", "valid_time", "time_mention", "pair_key",
            F.col("ts").alias("last_accessed"), F.col("salience").alias("initial_salience"), self.embed(F.col("content")).alias("embedding"),
        )
        new = materialize(new, "new")
        if not screens:
            self.store.insert(new)
            return {"pieces": new.count(), "exact": 0, "cosine": 0, "superseded": 0}
        both = old.unionByName(new)
        exact = dedup.exact_duplicates(both).where("id <> first_id").select("id")
        links = dedup.near_links(both.join(exact, "id", "left_anti"), self.config.dedup_cosine_threshold)
        near = dedup.greedy_drops(links, self.config.dedup_scope == "session").select("id", "neighbour")
        screened = materialize(self._screened(near, both), "near")
        near = screened.where("verdict = 'merge duplicate'").select("id")
        kept = new.join(exact, "id", "left_anti").join(near, "id", "left_anti")
        self.store.insert(kept)
        gone = 0
        if self.config.conflict_resolution:
            standing = conflict.ordered_facts(self.store.read().where("salience > 0"))
            gone = self._supersede(conflict.resolve_new(standing, kept.where("kind = 'fact'").select("id"), screened.where("verdict = 'keep negation'").select("id", "neighbour")))
        fresh = F.col("id") > last
        return {"pieces": new.count(), "exact": exact.where(fresh).count(), "cosine": near.where(fresh).count(), "superseded": gone}

    def _screened(self, near: DataFrame, records: DataFrame) -> DataFrame:
        """``id, neighbour, verdict`` of near duplicates; rounds, and all records where contradictions are left alone, are merged."""
        if not self.config.conflict_resolution:
            return near.select("id", "neighbour", F.lit("merge duplicate").alias("verdict"))
        from palimpsest.functions.text import token_entropy

        t = records.select("id", "kind", "fact", triples.triple_column(F.col("subject"), F.col("predicate"), F.col("object")).alias("t"), token_entropy(F.coalesce("fact", F.lit(""))).alias("e"))
        j = near.join(t, "id").join(t.select(F.col("id").alias("neighbour"), F.col("fact").alias("fact_b"), F.col("t").alias("t_b"), F.col("e").alias("e_b")), "neighbour")
        verdict = triples.screen(F.coalesce("fact", F.lit("")), F.col("t"), F.coalesce("fact_b", F.lit("")), F.col("t_b"), self.config.dedup_entropy_gate, F.col("e"), F.col("e_b"))
        return j.select("id", "neighbour", F.when(F.col("kind") == "round", "merge duplicate").otherwise(verdict).alias("verdict"))

    def resolve(self) -> int:
        """Supersede contradicted facts; the number of losers."""
        return self._supersede(conflict.resolve_all(conflict.keyed_facts(self.store.read().where("salience > 0"))))

    def _supersede(self, losers: DataFrame) -> int:
        losers = materialize(losers, "losers")
        n = losers.count()
        if n:
            self.store.update(conflict.supersede_updates(losers), ["salience", "supersedes"])
        return n

    def consolidate(self) -> None:
        """The pass over contradictions, then decay by each user's own clock."""
        if self.config.conflict_resolution:
            self.resolve()
        self.store.update(materialize(conflict.decay(self.store.read(), self.config.decay_half_life_days, self.config.decay_floor), "decay"), ["salience"])

    # --- read ----------------------------------------------------------------

    def recall(self, queries: DataFrame, k: int | None = None, touch: bool = True) -> DataFrame:
        """Best rounds of each query: ``qid, user_id, query``, where a query may begin with ``[Current date: ...]``.

        With ``touch`` the records shown are marked as read at their user's
        logical time, as a new version of the store.
        """
        c = self.config
        q = queries.select("qid", "user_id", dates.query_question(F.col("query")).alias("question"), dates.anchor_date(dates.query_date(F.col("query"))).alias("at"))
        q = q.withColumn("w", dates.question_window(F.col("question"), F.col("at"))).select("qid", "user_id", "question", F.col("w.start").alias("start_day"), F.col("w.end").alias("end_day"), self.embed(F.concat(F.lit(c.query_instruction), F.col("question"))).alias("embedding"))
        q = materialize(q, "queries")
        records = self.store.read()
        weights = retrieve.Weights(c.weights["similarity"], c.weights["recency"], c.time_weight, c.decay_half_life_days) if c.ranking != "similarity" else retrieve.Weights()
        k = k or c.top_k
        hits = retrieve.rank_rounds(q, records, c.rerank_pool if c.ranking == "rerank" else k, weights, c.active_only)
        if c.ranking == "rerank":
            best = retrieve.rerank_rounds(hits, q.select("qid", "user_id", "question"), records, k).select("qid", "round", F.col("rank").alias("new_rank"))
            hits = hits.join(best, ["qid", "round"]).withColumn("rank", F.col("new_rank")).drop("new_rank")
        hits = materialize(retrieve.above_floor(hits, c.recall_min_relevance), "hits")
        if touch:
            self.store.update(materialize(retrieve.recall_updates(hits, q, records), "touched"), ["last_accessed"])
        return hits

    def context(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """``qid, context``: what a reader is given for each query, oldest first."""
        hits = self.recall(queries, k).select("qid", "id")
        r = self.store.read()
        facts = r.where("kind = 'fact'").groupBy("user_id", "round_key").agg(F.array_sort(F.collect_list(F.struct("id", "fact", "valid_time", "raw"))).alias("facts"))
        items = hits.join(r.select("id", "user_id", "round_key", F.col("created_at").alias("ts"), _turns().alias("turns")), "id").join(facts, ["user_id", "round_key"], "left")
        return render.render(items.withColumn("facts", F.coalesce("facts", F.array().cast("array<struct<id:bigint,fact:string,valid_time:string,raw:string>>"))), "qid", self.config.render_unit)

    def export(self, markdown: bool = False) -> DataFrame:
        """The store as lines, or its facts as Markdown bullets."""
        return render.markdown_bullets(self.store.read()) if markdown else render.export_lines(self.store.read())


def _turns() -> Column:
    return F.coalesce(F.when(F.size("turns") > 0, F.col("turns")), F.array(F.struct(F.col("source").alias("role"), F.col("content").alias("content"))))


__all__ = ["DIM", "Memory", "rules"]
