"""Files of an evaluation: benchmark JSON, prediction and request lines, label sheets, tables."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.schema import BENCHMARK, PREDICTIONS
from palimpsest.sources.store import parsed_label


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """``question_id, ..., session_no, session_id, session_date, turns, is_evidence``: one row a session of each question.

    A session without an id is named by its place, one without a date has an
    empty one. A question without sessions gives no rows.
    """
    q = spark.read.schema(BENCHMARK).json(path, multiLine=True)
    return parse_benchmark(q)


def parse_benchmark(q: DataFrame) -> DataFrame:
    s = q.select("question_id", "question_type", "question", "answer", "question_date", "haystack_session_ids", "haystack_dates", "answer_session_ids", F.posexplode("haystack_sessions").alias("session_no", "turns"))
    at = lambda c: F.get(F.col(c), F.col("session_no"))
    named = s.withColumn("session_id", F.coalesce(at("haystack_session_ids"), F.concat(F.lit("session-"), F.col("session_no").cast("string"))))
    return named.select(
        "question_id", "question_type", "question", "answer", "question_date", F.endswith("question_id", F.lit("_abs")).alias("is_abstention"),
        "session_no", "session_id", F.coalesce(at("haystack_dates"), F.lit("")).alias("session_date"), "turns",
        F.coalesce(F.array_contains("answer_session_ids", F.col("session_id")), F.lit(False)).alias("is_evidence"),
    )


def write_predictions(predictions: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order, nulls kept; an existing folder is refused."""
    predictions.select(canonical_json(predictions)).write.mode("errorifexists").text(path)


def canonical_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction lines; unknown keys are dropped, missing ones are null, a line that is no JSON is an error."""
    return spark.read.schema(PREDICTIONS).option("mode", "FAILFAST").json(path)


def write_requests(items: DataFrame, path: str) -> None:
    """Request lines of ``custom_id, model, prompt, max_tokens``."""
    body = F.struct("model", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"), "max_tokens")
    items.select(F.to_json(F.struct("custom_id", body.alias("body")))).write.mode("errorifexists").text(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("custom_id string, body struct<model:string,messages:array<struct<role:string,content:string>>,max_tokens:int>").json(path)


#: What a probe of one question found: ranks of its evidence, what was dropped on the way, and counts by stage.
PROBE = (
    "question_id string, category string, is_abstention boolean, n_rounds int, n_evidence_rounds int, stored int, evidence_ranks array<int>, top_sessions array<string>, "
    "drops array<struct<session_id:string,round_index:int,screen:string,cosine:double,neighbour_session_id:string,is_evidence:boolean,piece:int,kind:string>>, "
    "facts_stored int, rounds_sent_to_model int, empty_extractions int, truncated_outputs int, truncated_inputs int, prefilter_skips int, "
    "screen_keeps map<string,int>, conflicts map<string,int>, superseded int, stale_facts_top10 int, decayed int, time_matches_top10 int"
)


def write_probes(rows: DataFrame, path: str) -> None:
    """Probe rows as JSON lines; columns that a probe does not have are left out, existing rows refused."""
    names = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", PROBE)]
    rows.select(*[c for c in names if c in rows.columns]).write.mode("errorifexists").json(path)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Probe rows; what an older file lacks reads as an empty list, an empty map or 0."""
    rows = spark.read.schema(PROBE).option("mode", "FAILFAST").json(path)
    blank = {"array": lambda t: F.array().cast(t), "map": lambda t: F.create_map().cast(t), "int": lambda t: F.lit(0)}
    return rows.select(*[F.coalesce(c, blank[k](t)).alias(c) if (k := t.split("<")[0]) in blank else F.col(c) for c, t in rows.dtypes])


def write_sheet(rows: DataFrame, path: str) -> None:
    """A label sheet as CSV with a header; an existing one is refused."""
    rows.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, human``: labels of a filled-in sheet; what is neither yes nor no is an error."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select("row_id", parsed_label(F.col("human")).alias("human"))


def summary_json(accuracy: DataFrame) -> DataFrame:
    """One JSON object a run: counts and bounds by group."""
    cell = F.struct("group", "correct", "total", "accuracy", "low", "high")
    return accuracy.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list(cell))).alias("summary"))


def file_digest(path: str, block: int = 1 << 20) -> str:
    """SHA-256 of a local file, read in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def folder_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of every file of a shared folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    """A small result as a Markdown table; a result of more than ``most`` rows is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def latex_table(df: DataFrame, most: int = 10_000) -> str:
    """The same as a LaTeX tabular."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else "".join("\\" + c if c in "&%$#_{}" else c for c in str(v))
    body = "\n".join(" & ".join(map(cell, r)) + r" \\" for r in rows)
    head = " & ".join(map(cell, df.columns)) + r" \\"
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{head}\n\\hline\n{body}\n\\end{{tabular}}"
