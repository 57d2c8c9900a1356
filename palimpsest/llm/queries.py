"""Queries of the operators for training text."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.llm import defects, leakage, linkage, lookalike, mixing, neighbours, personal
from palimpsest.llm.oracles import ORACLES  # noqa: F401
from palimpsest.session import read_table


def _personal(spark, sf_dir):
    texts = personal.memory_texts(read_table(spark, sf_dir, "sessions"), read_table(spark, sf_dir, "memories"))
    return texts, personal.learn(texts, read_table(spark, sf_dir, "given_names"))


def p1_found(spark, sf_dir):
    texts, lexicon = _personal(spark, sf_dir)
    return personal.find(texts, lexicon, ["source_table", "record_key", "field_name", "turn_index"])


def p1_redacted(spark, sf_dir):
    texts, lexicon = _personal(spark, sf_dir)
    return personal.redact(texts, lexicon)


def p2_found(spark, sf_dir):
    model = defects.fit_language_model(read_table(spark, sf_dir, "documents"))
    return defects.flag_defects(read_table(spark, sf_dir, "predictions"), model)


def p3_found(spark, sf_dir):
    return neighbours.mutual_pairs(neighbours.nearest(read_table(spark, sf_dir, "memories")))


def p3_neighbours(spark, sf_dir):
    return neighbours.nearest(read_table(spark, sf_dir, "memories"), least=-1.0, probe=neighbours.PROBE)


def p4_decisions(spark, sf_dir):
    return linkage.link_batches(read_table(spark, sf_dir, "memories"), read_table(spark, sf_dir, "arrivals"))


def p4_found(spark, sf_dir):
    return p4_decisions(spark, sf_dir).where("screen IS NOT NULL").select(F.col("id").alias("arrival_id"), "screen")


def p6_found(spark, sf_dir):
    return leakage.leaked_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "heldout_items"))


def p6_report(spark, sf_dir):
    return leakage.leak_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "heldout_items"))


def p7_mix(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), by_size=True)


def p7_shares(spark, sf_dir):
    return mixing.shares(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), by_size=True)


def p8_found(spark, sf_dir):
    pairs = lookalike.lookalike_pairs(read_table(spark, sf_dir, "documents"))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_normalized(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = docs.select("doc_id", lookalike.consistent_text(F.col("text")).alias("text"), lookalike.scripts_column(F.col("text")).alias("s"))
    return found.select("doc_id", "text", "s.script", F.col("s.mixed").alias("mixed_tokens"), F.col("s.whole").alias("confusable_tokens"))


def p8_classes(spark, sf_dir):
    return lookalike.membership(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "p4_found": p4_found,
    "p4_decisions": p4_decisions,
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_normalized": p8_normalized,
    "p8_classes": p8_classes,
}
