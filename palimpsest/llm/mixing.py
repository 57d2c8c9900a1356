"""Sources mixed to target weights of tokens.

Every source gets its share of the total. What exceeds its tokens is met by
whole copies of all its documents, up to its cap; the rest by a Pareto sample:
a document with inclusion probability p and a random u has the rank
``u/(1-u) / (p/(1-p))``, and documents are taken in order of rank until the
quota is full. The probabilities are equal within a source, or follow a weight
of the documents, and differ between sources with their quotas. A document
whose probability reaches one is taken for certain.

The cut in the order of ranks is found by descent over histograms of the ranks
of all documents (a few passes of one aggregate), not by sorting a source in
one task, so that a source may hold any part of all rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialize, small_enough

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Bits of the rank that one pass of the descent looks at, and all of them.
STEP, BITS = 10, 50

_LOADED: dict[str, object] = {}


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s_-]+|[\s_-]+$", ""), r"[\s_-]+", "_")


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            _LOADED[path] = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _LOADED[path]


def with_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, text_col: str = "text") -> DataFrame:
    """Adds ``tokens``: length of the whole text in tokens; 0 for null and empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _tokenizer(tokenizer)
        for b in batches:
            yield b.assign(tokens=count([t if isinstance(t, str) else "" for t in b[text_col]])).drop(columns=[text_col])

    rest = [f for f in docs.schema if f.name != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", tokens bigint"
    return docs.mapInPandas(run, schema)


def plan(sizes: dict[str, float], targets: list[tuple[str, float, int]], total: float | None) -> dict[str, tuple[float, int]]:
    """``source: (tokens wanted, cap)`` of sources that have documents and a positive weight.

    Without a total the largest one is taken at which every share is met
    within its cap. With a total, a source that would pass its cap stops there
    and the others keep their quotas.
    """
    live = [(s, w, r) for s, w, r in targets if sizes.get(s, 0) > 0 and w and w > 0 and r and r > 0]
    weight = sum(w for _, w, _ in live)
    if not live:
        return {}
    if total is None:
        total = min(r * sizes[s] / (w / weight) for s, w, r in live)
    return {s: (min(total * w / weight, r * sizes[s]), r) for s, w, r in live}


def _ranks(docs: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """Adds ``copies`` (whole ones) and ``k``, the rank as a whole number of ``BITS`` bits; -1 for certain documents."""
    rows = docs.join(F.broadcast(wanted), "source")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.least(F.lit(1.0), F.col("scale") * F.col("weight"))
    odds = (u / (1 - u)) / (p / (1 - p))
    k = F.when(p >= 1, F.lit(-1)).when(p <= 0, F.lit(1 << BITS)).otherwise((odds / (1 + odds) * float(1 << BITS)).cast("bigint"))
    return rows.withColumn("k", k)


def _scales(docs: DataFrame, rest: dict[str, float]) -> dict[str, float]:
    """For each source the factor from weight to probability whose expected tokens are the rest.

    Documents whose probability would pass one are certain; what they do not
    fill is spread over the others, in a few passes of an aggregate.
    """
    spark = docs.sparkSession
    scale = {s: 0.0 for s in rest}
    for turn in range(12):
        table = F.broadcast(spark.createDataFrame([(s, scale[s]) for s in rest], "source string, now double"))
        sure = (F.col("now") * F.col("weight") >= 1) if turn else F.lit(False)
        got = docs.join(table, "source").groupBy("source").agg(
            F.sum(F.when(sure, F.col("tokens")).otherwise(0)).alias("certain"),
            F.sum(F.when(sure, 0.0).otherwise(F.col("tokens") * F.col("weight"))).alias("open"),
        )
        new = {r["source"]: (max(0.0, rest[r["source"]] - r["certain"]) / r["open"] if r["open"] else scale[r["source"]]) for r in got.collect()}
        if all(abs(new[s] - scale[s]) <= 1e-12 + 1e-9 * scale[s] for s in new):
            break
        scale.update(new)
    return scale


def _cuts(ranked: DataFrame, rest: dict[str, float]) -> dict[str, tuple[int, float]]:
    """``source: (rank of the document at which the quota fills, tokens before it)``, by descent over histograms.

    Each pass cuts the open range of every source into 1,024 bins; Spark sums
    the bins and picks the one in which the quota fills, so that one row a
    source comes to the driver.
    """
    spark = ranked.sparkSession
    before = {s: 0.0 for s in rest}
    for r in ranked.where("k < 0").groupBy("source").agg(F.sum("tokens").alias("t")).collect():  # certain documents come first
        before[r["source"]] = float(r["t"])
    low = {s: 0 for s in rest}
    live = {s for s in rest if before[s] < rest[s]}
    upto = Window.partitionBy("source").orderBy("bin")
    for shift in range(BITS - STEP, -1, -STEP):
        if not live:
            break
        table = F.broadcast(spark.createDataFrame([(s, low[s], rest[s] - before[s]) for s in live], "source string, low bigint, need double"))
        width = 1 << (shift + STEP)
        inside = ranked.join(table, "source").where((F.col("k") >= F.col("low")) & (F.col("k") < F.col("low") + width))
        bins = inside.groupBy("source", "need", F.shiftright(F.col("k") - F.col("low"), shift).alias("bin")).agg(F.sum("tokens").alias("t"))
        summed = bins.withColumn("sum", F.sum("t").over(upto))
        full = F.min(F.when(F.col("sum") >= F.col("need"), F.struct("bin", (F.col("sum") - F.col("t")).alias("passed"))))
        found = {r["source"]: r for r in summed.groupBy("source").agg(full.alias("full"), F.max("sum").alias("all")).collect()}
        for s in list(live):
            r = found.get(s)
            if r and r["full"]:
                low[s] += r["full"]["bin"] << shift
                before[s] += r["full"]["passed"]
            else:
                low[s] = 1 << BITS  # the source ends before its quota is full
                before[s] += r["all"] if r else 0
                live.discard(s)
    return {s: (low[s] if before[s] < rest[s] else -1, before[s]) for s in rest}


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 11, tokenizer: str = TOKENIZER, weight_col: str | None = None, by_size: bool = False) -> DataFrame:
    """``doc_id, source, tokens, repeats`` of the chosen documents.

    docs: ``doc_id, source, text``. targets: ``source, weight, max_repeats``.
    Sources are compared in one spelling; those without a target, documents
    without text, and targets of no weight give nothing; of several targets of
    one source the weights add up and the largest cap holds. A weight column
    (null or negative counts as 0) makes documents more likely to get the
    extra copy; by size, a document's tokens are its weight. The same seed
    gives the same mix.
    """
    weight = F.greatest(F.lit(0.0), F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))) if weight_col else F.lit(1.0)
    rows = docs.where("text IS NOT NULL AND text <> '' AND doc_id IS NOT NULL").select("doc_id", source_name(F.col("source")).alias("source"), weight.alias("weight"), "text")
    goals = _targets(targets)
    known = docs.sparkSession.createDataFrame([(g[0],) for g in goals], "source string")
    sized = materialize(with_tokens(rows.join(F.broadcast(known), "source", "left_semi"), tokenizer).where("tokens > 0").withColumn("weight", F.col("tokens").cast("double") if by_size else F.col("weight")), "tokens")
    sizes = {r["source"]: float(r["t"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    quotas = plan(sizes, goals, total_tokens)
    empty = docs.sparkSession.createDataFrame([], "doc_id bigint, source string, tokens bigint, repeats int")
    if not quotas:
        return empty
    copies = {s: int(q / sizes[s] + 1e-9) for s, (q, _) in quotas.items()}
    rest = {s: max(0.0, q - copies[s] * sizes[s]) for s, (q, _) in quotas.items()}
    rest = {s: 0.0 if x < 0.5 else x for s, x in rest.items()}
    scale = _scales(sized, rest)
    wanted = docs.sparkSession.createDataFrame([(s, copies[s], float(scale.get(s, 0.0))) for s in quotas], "source string, copies int, scale double")
    ranked = materialize(_ranks(sized, wanted, seed), "ranked")
    cuts = _cuts(ranked, rest)
    table = docs.sparkSession.createDataFrame([(s, c, rest[s] - b) for s, (c, b) in cuts.items()], "source string, cut bigint, gap double")
    # The document at the cut comes in if it brings the source nearer to its quota.
    take = (F.col("k") < F.col("cut")) | ((F.col("k") == F.col("cut")) & (F.col("tokens") <= 2 * F.col("gap")))
    sure = (F.col("k") < 0) & (F.col("gap") > -F.col("tokens"))
    chosen = ranked.join(F.broadcast(table), "source").withColumn("repeats", (F.col("copies") + F.when(F.col("scale") > 0, (take | sure).cast("int")).otherwise(0)).cast("int"))
    return chosen.where("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def _targets(targets: DataFrame, most: int = 100_000) -> list[tuple[str, float, int]]:
    rows = targets.where("source IS NOT NULL").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("cap"))
    if not small_enough(rows, most):
        raise ValueError(f"more than {most} sources in the targets")
    return [(r["source"], r["weight"] or 0.0, r["cap"] or 0) for r in rows.collect()]


def shares(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """What the mix holds of each target: ``source, target_share, reachable_share, actual_share, documents, tokens, most_repeats``.

    The reachable share is that among sources that have documents.
    """
    chosen = mix(docs, targets, **options)
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    goals = docs.sparkSession.createDataFrame([(s, float(w)) for s, w, _ in _targets(targets)], "source string, weight double")
    rows = goals.join(got, "source", "left")
    live = F.when(F.col("tokens") > 0, F.col("weight"))
    sums = rows.agg(F.sum("weight"), F.sum(live), F.sum("tokens")).first()
    sums = {name: F.lit(float(x or 0) or None).cast("double") for name, x in zip(("all_weight", "live_weight", "all_tokens"), sums)}
    return rows.withColumns(sums).select(
        "source",
        F.round(F.col("weight") / F.col("all_weight"), 6).alias("target_share"),
        F.round(F.coalesce(live / F.col("live_weight"), F.lit(0.0)), 6).alias("reachable_share"),
        F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
