"""Queries that run as streams over what is there now."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.plans.fact_sql import GREEDY_SQL
from palimpsest.plans.ingest_queries import ROUNDS_SQL
from palimpsest.session import once, read_table, scratch_path
from palimpsest.streaming import ingest as stream


def stream_rounds(spark, sf_dir):
    """Rounds read as a stream; equals the batch query."""
    sink = scratch_path(spark, "stream-rounds")
    rounds = stream.stream_rounds(stream.stream_sessions(spark, f"{sf_dir}/sessions.parquet"), "20000 days")
    stream.run_available(rounds.select("session_id", "round_no", F.size("turns").alias("n_turns"), "roles", "text", "has_evidence"), sink, scratch_path(spark, "stream-checkpoint"))
    return spark.read.parquet(sink)


def stream_dedup(spark, sf_dir):
    """Greedy duplicates found by the state function; equals the batch query for records in order of id."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    path, sink = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-dedup")
    m = once(read_table(spark, sf_dir, "memories").select("id", "user_id", "kind", "created_at", "embedding"), "id")
    stream.packed_records(m).write.parquet(path)
    records = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    stream.run_available(stream.stream_dedup(records), sink, scratch_path(spark, "stream-checkpoint"))
    return spark.read.schema("id bigint, neighbour bigint, cosine double").parquet(sink)


QUERIES = {"stream_rounds": stream_rounds, "stream_dedup": stream_dedup}
ORACLES = {"stream_rounds": ROUNDS_SQL + "SELECT session_id, round_no, n_turns, roles, text, has_evidence FROM rnd", "stream_dedup": GREEDY_SQL}
