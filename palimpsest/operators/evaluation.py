"""Evaluation of runs: accuracy, paired tests, agreement, recall, drift, costs, samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import stats, text
from palimpsest.session import once


def graded(predictions: DataFrame) -> DataFrame:
    """``run_id, question_id, group, correct``: the first verdict of each graded answer; unanswerable questions are a group."""
    p = once(predictions.select("run_id", "question_id", "category", "is_abstention", "verdicts"), "run_id", "question_id").where("size(verdicts) > 0")
    group = F.when(F.coalesce("is_abstention", F.lit(False)), F.lit("abstention")).otherwise(F.coalesce("category", F.lit("unknown")))
    return p.select("run_id", "question_id", group.alias("group"), F.col("verdicts")[0]["correct"].alias("correct"), "verdicts")


def accuracy(grades: DataFrame) -> DataFrame:
    """``run_id, group, correct, total, accuracy, low, high`` by group and overall."""
    sets = grades.groupingSets([["run_id", "group"], ["run_id"]], "run_id", "group").agg(F.count_if("correct").alias("right"), F.count(F.lit(1)).alias("total"), F.grouping("group").alias("all"))
    low, high = stats.wilson(F.col("right"), F.col("total"))
    return sets.select("run_id", F.when(F.col("all") == 1, "overall").otherwise(F.col("group")).alias("group"), F.col("right").alias("correct"), "total", F.round(F.col("right") / F.col("total"), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def paired(grades: DataFrame, min_shared: int = 1) -> DataFrame:
    """``first, second, b, c, pairs, p, p_holm`` of all pairs of runs over their shared questions."""
    g = grades.select("run_id", "question_id", "correct")
    a, b = g.select(F.col("run_id").alias("first"), "question_id", F.col("correct").alias("x")), g.select(F.col("run_id").alias("second"), "question_id", F.col("correct").alias("y"))
    both = a.join(b, "question_id").where("first < second").groupBy("first", "second").agg(F.count_if(F.col("y") & ~F.col("x")).alias("b"), F.count_if(F.col("x") & ~F.col("y")).alias("c"), F.count(F.lit(1)).alias("pairs"))
    tested = both.where(F.col("pairs") >= min_shared).withColumn("p", stats.mcnemar_p(F.col("b"), F.col("c")))
    return stats.holm(tested, ["first"], "second")


def agreement(grades: DataFrame) -> DataFrame:
    """``run_id, n, yy, yn, ny, nn, rate, kappa`` of first and second verdicts, by run and pooled."""
    two = grades.where("size(verdicts) > 1").select("run_id", F.col("correct").alias("x"), F.col("verdicts")[1]["correct"].alias("y"))
    cells = two.groupingSets([["run_id"], []], "run_id").agg(F.count_if(F.col("x") & F.col("y")).alias("yy"), F.count_if(F.col("x") & ~F.col("y")).alias("yn"), F.count_if(~F.col("x") & F.col("y")).alias("ny"), F.count_if(~F.col("x") & ~F.col("y")).alias("nn"), F.count(F.lit(1)).alias("n"), F.grouping("run_id").alias("all"))
    k = stats.kappa(*[F.col(x) for x in ("yy", "yn", "ny", "nn")])
    return cells.select(F.when(F.col("all") == 1, "pooled").otherwise(F.col("run_id")).alias("run_id"), "n", "yy", "yn", "ny", "nn", F.round((F.col("yy") + F.col("nn")) / F.col("n"), 6).alias("rate"), F.round(k, 6).alias("kappa"))


def retest(grades: DataFrame) -> DataFrame:
    """``run_id, regraded, unstable, to_wrong, to_right``: answers whose gradings disagree."""
    flat = F.transform("verdicts", lambda v: v.correct)
    later = F.slice(flat, F.lit(2), F.greatest(F.size(flat) - 1, F.lit(0)))
    g = grades.where("size(verdicts) > 1").select("run_id", (F.size(F.array_distinct(flat)) > 1).alias("u"), F.when(F.col("correct"), F.size(F.filter(later, lambda x: ~x))).otherwise(0).alias("w"), F.when(~F.col("correct"), F.size(F.filter(later, lambda x: x))).otherwise(0).alias("r"))
    return g.groupBy("run_id").agg(F.count(F.lit(1)).alias("regraded"), F.count_if("u").alias("unstable"), F.sum("w").alias("to_wrong"), F.sum("r").alias("to_right"))


def buckets(grades: DataFrame, system: str, oracle: str) -> DataFrame:
    """How a run fares against the run with the evidence, by group and overall; unstable answers apart."""
    unstable = F.exists("verdicts", lambda v: v.correct != F.col("correct"))
    s = grades.where(F.col("run_id") == system).select("question_id", "group", F.col("correct").alias("s"), unstable.alias("u1"))
    o = grades.where(F.col("run_id") == oracle).select("question_id", F.col("correct").alias("o"), unstable.alias("u2"))
    j = s.join(o, "question_id").withColumn("ok", ~(F.col("u1") | F.col("u2")))
    count = lambda c: F.count_if(F.col("ok") & c)
    cells = j.groupingSets([["group"], []], "group").agg(count(F.col("s") & F.col("o")).alias("both_right"), count(~F.col("s") & F.col("o")).alias("oracle_only"), count(F.col("s") & ~F.col("o")).alias("system_only"), count(~F.col("s") & ~F.col("o")).alias("both_wrong"), F.count_if(~F.col("ok")).alias("unstable"), F.grouping("group").alias("all"))
    return cells.select(F.when(F.col("all") == 1, "overall").otherwise(F.col("group")).alias("group"), "both_right", "oracle_only", "system_only", "both_wrong", "unstable")


def evidence_ranks(predictions: DataFrame, evidence: DataFrame) -> DataFrame:
    """``run_id, question_id, category, is_abstention, ranks``: places of retrieved sessions that hold evidence."""
    p = once(predictions.select("run_id", "question_id", "category", "is_abstention", "retrieved_ids"), "run_id", "question_id")
    placed = p.select("run_id", "question_id", F.posexplode("retrieved_ids").alias("pos", "session_id")).join(evidence.select("session_id").distinct(), "session_id", "left_semi")
    ranks = placed.groupBy("run_id", "question_id").agg(F.array_sort(F.collect_list(F.col("pos") + 1)).alias("ranks"))
    return p.drop("retrieved_ids").join(ranks, ["run_id", "question_id"], "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))


def recall_at(ranked: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """``category, questions, any_at_k, all_at_k``: answerable questions whose evidence is within the first k, by category and overall."""
    inside = lambda k: F.filter("ranks", lambda r: (r > 0) & (r <= k))
    aggs = [F.count(F.lit(1)).alias("questions")]
    for k in ks:
        aggs += [F.count_if(F.size(inside(k)) > 0).alias(f"any_at_{k}"), F.count_if((F.size("ranks") > 0) & (F.size(inside(k)) == F.size("ranks"))).alias(f"all_at_{k}")]
    rows = ranked.where("NOT coalesce(is_abstention, false)").withColumn("category", F.coalesce("category", F.lit("unknown")))
    sets = rows.groupingSets([["category"], []], "category").agg(*aggs, F.grouping("category").alias("all"))
    return sets.withColumn("category", F.when(F.col("all") == 1, "overall").otherwise(F.col("category"))).drop("all")


def misses(grades: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """``run_id, kind, answers``: wrong answers by whether their evidence was missed or misread."""
    j = grades.where("NOT correct").select("run_id", "question_id").join(ranked, ["run_id", "question_id"])
    found = F.exists("ranks", lambda r: (r > 0) & (r <= k))
    kind = F.when(F.coalesce("is_abstention", F.lit(False)) | found, "reading-miss").otherwise("retrieval-miss")
    return j.groupBy("run_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("answers"))


def drops(events: DataFrame) -> DataFrame:
    """``kind, screen, drops, evidence, cross_session, with_cosine`` of dropped pieces."""
    cross = (F.col("screen") == "cosine") & F.col("neighbour_session_id").isNotNull() & (F.col("neighbour_session_id") != F.col("session_id"))
    return events.groupBy("kind", "screen").agg(F.count(F.lit(1)).alias("drops"), F.count_if("is_evidence").alias("evidence"), F.count_if(cross).alias("cross_session"), F.count("cosine").alias("with_cosine"))


def drift(predictions: DataFrame, first: str, second: str) -> DataFrame:
    """``question_id, first_divergence, tokens_changed`` of answers that differ between two runs."""
    p = once(predictions.select("run_id", "question_id", "predicted", "reader_prompt_tokens"), "run_id", "question_id")
    side = lambda r, a, t: p.where(F.col("run_id") == r).select("question_id", F.coalesce("predicted", F.lit("")).alias(a), F.col("reader_prompt_tokens").alias(t))
    j = side(first, "x", "tx").join(side(second, "y", "ty"), "question_id")
    return j.where("x <> y").select("question_id", text.first_difference(F.col("x"), F.col("y")).alias("first_divergence"), (~F.col("tx").eqNullSafe(F.col("ty"))).alias("tokens_changed"))


def flips(grades: DataFrame) -> DataFrame:
    """``run_id, compared, to_correct, to_wrong, verdict`` of a second grading against the first."""
    g = grades.where("size(verdicts) > 1").select("run_id", F.col("correct").alias("x"), F.col("verdicts")[1]["correct"].alias("y"), (F.col("verdicts")[0]["judge_hash"] != F.col("verdicts")[1]["judge_hash"]).alias("fresh"))
    s = g.groupBy("run_id").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("y") & ~F.col("x")).alias("to_correct"), F.count_if(F.col("x") & ~F.col("y")).alias("to_wrong"), F.count_if("fresh").alias("fresh"))
    n = F.col("to_correct") + F.col("to_wrong")
    return s.select("run_id", "compared", "to_correct", "to_wrong", F.when(n == 0, "MATCHES").when(F.col("fresh") > 0, "WITHIN RE-GRADE").otherwise("DIVERGES").alias("verdict"))


def truncation(predictions: DataFrame) -> DataFrame:
    """``run_id, truncated, total, mean_fed, dropped_share`` of prompts."""
    p = once(predictions.select("run_id", "question_id", "truncated", "reader_prompt_tokens", "tokens_dropped"), "run_id", "question_id")
    return p.groupBy("run_id").agg(
        F.count_if("truncated").alias("truncated"), F.count(F.lit(1)).alias("total"), F.round(F.avg("reader_prompt_tokens"), 6).alias("mean_fed"),
        F.round(F.sum("tokens_dropped") / (F.sum("tokens_dropped") + F.sum("reader_prompt_tokens")), 6).alias("dropped_share"),
    )


def token_percentiles(predictions: DataFrame) -> DataFrame:
    """``run_id, n, p50, p90, mean``: the median, and the value at place ``int(0.9 (n - 1))`` in order."""
    p = once(predictions.select("run_id", "question_id", "reader_prompt_tokens"), "run_id", "question_id").where("reader_prompt_tokens IS NOT NULL")
    w = Window.partitionBy("run_id")
    placed = p.withColumn("i", F.row_number().over(w.orderBy("reader_prompt_tokens", "question_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at90 = F.when(F.col("i") == F.floor(0.9 * (F.col("n") - 1)), F.col("reader_prompt_tokens"))
    return placed.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("reader_prompt_tokens", 0.5), 6).alias("p50"), F.max(at90).alias("p90"), F.round(F.avg("reader_prompt_tokens"), 6).alias("mean"))


def spent(ledger: DataFrame) -> DataFrame:
    """``stage, lines, usd``: actual else projected costs; lines that a later one supersedes do not count."""
    gone = ledger.where("supersedes_ts IS NOT NULL").select(F.col("supersedes_ts").alias("ts")).distinct()
    live = ledger.join(gone, "ts", "left_anti")
    return live.groupBy("stage").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.coalesce("actual_usd", "projected_usd", F.lit(0.0)).cast("decimal(18,4)")).cast("double").alias("usd"))


def projected_costs(requests: DataFrame, prices: DataFrame, batch: bool = False) -> DataFrame:
    """``model, requests, prompt_tokens, usd``: an upper bound from text lengths and answer limits.

    requests: ``model, prompt, max_tokens``. A model without a price is an error.
    """
    sums = requests.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.floor(F.length("prompt") / 4)).alias("prompt_tokens"), F.sum("max_tokens").alias("answer_tokens"))
    j = sums.join(prices.select("model", "input_usd", "output_usd"), "model", "left")
    price = lambda c: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit("no price for "), F.col("model"))).cast("double"))
    usd = (F.col("prompt_tokens") * price("input_usd") + F.col("answer_tokens") * price("output_usd")) / 1e6 * (0.5 if batch else 1.0)
    return j.select("model", "requests", "prompt_tokens", F.round(usd, 6).alias("usd"))


def parity(runs: DataFrame, fields: list[str], key: str = "run_id") -> DataFrame:
    """``field, values_seen``: fields in which runs differ that should be the same."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("\u0000")).alias("value")) for f in fields])
    rows = runs.select(key, F.explode(pairs).alias("p")).select("p.field", "p.value")
    return rows.groupBy("field").agg(F.countDistinct("value").alias("values_seen")).where("values_seen > 1")


def accuracy_table(grades: DataFrame, runs: list[str]) -> DataFrame:
    """Groups by rows, runs by columns: correct answers."""
    return grades.groupBy("group").pivot("run_id", runs).agg(F.count_if("correct")).na.fill(0)


def distinct_answers(predictions: DataFrame) -> DataFrame:
    """``question_id, digest, run_ids``: each answer text once, with the runs that gave it."""
    p = once(predictions.select("run_id", "question_id", "predicted"), "run_id", "question_id")
    return p.groupBy("question_id", F.sha2(F.coalesce("predicted", F.lit("")), 256).alias("digest")).agg(F.array_join(F.array_sort(F.collect_set("run_id")), ",").alias("run_ids"))


def id_digest(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """One digest of each key's set of ids."""
    return df.select(key, id_col).distinct().groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(id_col)), "\n"), 256).alias("digest"))


# --- samples and chunks ------------------------------------------------------


def _draw(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def sample_stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, as evenly over the strata as they allow: rounds of one row a stratum, strata in order of name.

    The result is n rows by definition, so the final order by round is a top-n.
    """
    w = Window.partitionBy(stratum).orderBy(_draw(seed, key), key)
    placed = df.withColumn("round", F.row_number().over(w)).where(F.col("round") <= n)
    return placed.orderBy("round", stratum).limit(n)


def sample_deciles(df: DataFrame, size: str, key: str, n: int, seed: int) -> DataFrame:
    """``n / 10`` rows of each tenth in order of size; tenths as slices ``d n / 10`` of the ordered rows.

    Places in the order come from counts of each size, added up within ranges
    of sizes and then over the ranges, not from sorting all rows in one task.
    """
    earlier = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = df.groupBy(size).agg(F.count(F.lit(1)).alias("c")).withColumn("range", F.floor(F.col(size) / 256))
    ranges = counts.groupBy("range").agg(F.sum("c").alias("c")).select("range", earlier(Window.orderBy("range")).alias("base"))
    inner = counts.withColumn("start", earlier(Window.partitionBy("range").orderBy(size)))
    before = inner.join(ranges, "range").select(size, "c", (F.col("base") + F.col("start")).alias("start"))
    total = df.agg(F.count(F.lit(1))).first()[0]
    within = Window.partitionBy(size).orderBy(key)
    placed = df.join(before, size).withColumn("i", F.col("start") + F.row_number().over(within) - 1)
    decile = F.floor(((F.col("i") + 1) * 10 - 1) / F.lit(total))
    w = Window.partitionBy("decile").orderBy(_draw(seed, key), key)
    return placed.withColumn("decile", decile).withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(1, n // 10)).drop("c", "start", "i", "n")


def draw_sheet(df: DataFrame, kind: str, keys: list[str], n: int, seed: int) -> DataFrame:
    """Up to ``n`` rows of each kind, drawn without replacement and numbered in drawn order."""
    w = Window.partitionBy(kind).orderBy(_draw(seed, *keys), *keys)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def plan_chunks(items: DataFrame, group: str, order: str, cost: str, limit: int) -> DataFrame:
    """Adds ``chunk``: items in order packed greedily under a limit; one that is too large alone is a chunk.

    A chunk's end depends on all before it, so each group is one walk over
    (order, cost) pairs, which is all that reaches its task.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("o", kind="stable")
        chunk, load, out = 0, 0, []
        for k, c in enumerate(g["c"]):
            if k and load + c > limit:
                chunk, load = chunk + 1, 0
            load += c
            out.append(chunk)
        return g.assign(chunk=out)

    o, g = items.schema[order].dataType.simpleString(), items.schema[group].dataType.simpleString()
    slim = items.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(cost).cast("bigint").alias("c"))
    return slim.groupBy("g").applyInPandas(run, f"g {g}, o {o}, c bigint, chunk int").select(F.col("g").alias(group), F.col("o").alias(order), F.col("c").alias(cost), "chunk")


def replan(items: DataFrame, chunks: DataFrame, group: str, order: str, cost: str, limit: int) -> DataFrame:
    """Chunks that have not run, packed anew under another limit and numbered after the kept ones.

    chunks: ``group, order, chunk, status``; null and ``failed`` have not run.
    """
    ran = chunks.where("status IS NOT NULL AND status <> 'failed'")
    kept = ran.groupBy(group).agg(F.countDistinct("chunk").alias("kept"))
    left = items.join(ran.select(group, order), [group, order], "left_anti")
    fresh = plan_chunks(left, group, order, cost, limit).join(kept, group, "left")
    return fresh.withColumn("chunk", F.col("chunk") + F.coalesce("kept", F.lit(0)).cast("int")).drop("kept")


# --- records of pairs, differences, gaps ---------------------------------------


def win_lists(grades: DataFrame) -> DataFrame:
    """``first, second, first_wins, second_wins``: the questions that only one run of a pair got right, in order."""
    g = grades.select("run_id", "question_id", "correct")
    a, b = g.select(F.col("run_id").alias("first"), "question_id", F.col("correct").alias("x")), g.select(F.col("run_id").alias("second"), "question_id", F.col("correct").alias("y"))
    j = a.join(b, "question_id").where("first < second AND x <> y")
    ids = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c), F.col("question_id")))), ",")
    return j.groupBy("first", "second").agg(ids("x").alias("first_wins"), ids("y").alias("second_wins"))


def same_questions(grades: DataFrame, first: str, second: str) -> DataFrame:
    """``question_id, only_in`` of questions that one of two runs did not answer; paired tests need none."""
    a = grades.where(F.col("run_id") == first).select("question_id", F.lit(True).alias("a"))
    b = grades.where(F.col("run_id") == second).select("question_id", F.lit(True).alias("b"))
    return a.join(b, "question_id", "full_outer").where("a IS NULL OR b IS NULL").select("question_id", F.when(F.col("b").isNull(), first).otherwise(second).alias("only_in"))


def pin_differences(first: DataFrame, second: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """``key, first, second``: shared keys of two ``key, value`` frames that differ; absent is spelled null, empty or ``none``."""
    value = lambda c: F.when(~F.coalesce(F.lower("value"), F.lit("")).isin("", "none", "null"), F.col("value")).alias(c)
    j = first.select("key", value("first")).join(second.select("key", value("second")), "key").where(~F.col("first").eqNullSafe(F.col("second")))
    return j.where(~F.col("key").isin(*ignored)) if ignored else j


def missing_paths(required: DataFrame, present: DataFrame) -> DataFrame:
    """``path, state``: required paths that are missing, or present but ``UNKNOWN``."""
    j = required.select("path").join(present.select("path", "value"), "path", "left")
    return j.where("value IS NULL OR value = 'UNKNOWN'").select("path", F.when(F.col("value").isNull(), "missing").otherwise("unknown").alias("state"))


def slices(rounds: DataFrame, sampled: DataFrame) -> DataFrame:
    """``part, rounds, chars``: rounds of sampled sessions and of the others."""
    mark = rounds.join(sampled.select("session_id").distinct().withColumn("__in", F.lit(True)), "session_id", "left")
    return mark.groupBy(F.when(F.col("__in"), "inside").otherwise("outside").alias("part")).agg(F.count(F.lit(1)).alias("rounds"), F.sum(F.length("text")).alias("chars"))


def emitted_differences(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """``state, rows``: outputs that are the same, differ, or stand on one side only."""
    j = first.select(key, F.struct(F.col(value)).alias("x")).join(second.select(key, F.struct(F.col(value)).alias("y")), key, "full_outer")
    state = F.when(F.col("x").isNull(), "only-second").when(F.col("y").isNull(), "only-first").when(F.col("x").eqNullSafe(F.col("y")), "same").otherwise("different")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("rows"))


def filled(wanted: DataFrame, outputs: DataFrame, keys: list[str], value: str, default: Column) -> DataFrame:
    """Outputs, and a default for each wanted key that has none; of several outputs of a key the smallest."""
    one = outputs.groupBy(*keys).agg(F.min(value).alias(value), F.lit(True).alias("__got"))
    return wanted.select(*keys).distinct().join(one, keys, "left").select(*keys, F.when(F.col("__got"), F.col(value)).otherwise(default).alias(value), F.coalesce("__got", F.lit(False)).alias("answered"))


def score_labels(labels: DataFrame) -> DataFrame:
    """``kind, judge, n, agree, rate, low, high`` of two judges against labels: ``kind, human, first, second``."""
    rows = labels.where("human IS NOT NULL").select("kind", F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), (F.col(j) == F.col("human")).alias("ok")) for j in ("first", "second")])).alias("v")).select("kind", "v.*")
    s = rows.groupBy("kind", "judge").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("agree"))
    low, high = stats.wilson(F.col("agree"), F.col("n"))
    return s.select("kind", "judge", "n", "agree", F.round(F.col("agree") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def sign_agreement(grades: DataFrame) -> DataFrame:
    """``first, second, sign, second_sign, agree``: whether two gradings favour the same run of a pair."""
    g = grades.where("size(verdicts) > 1").select("run_id", "question_id", F.col("correct").alias("c1"), F.col("verdicts")[1]["correct"].alias("c2"))
    a = g.select(F.col("run_id").alias("first"), "question_id", F.col("c1").alias("x1"), F.col("c2").alias("x2"))
    b = g.select(F.col("run_id").alias("second"), "question_id", F.col("c1").alias("y1"), F.col("c2").alias("y2"))
    gap = lambda x, y: F.signum(F.sum(F.col(y).cast("int") - F.col(x).cast("int"))).cast("int")
    s = a.join(b, "question_id").where("first < second").groupBy("first", "second").agg(gap("x1", "y1").alias("sign"), gap("x2", "y2").alias("second_sign"))
    return s.withColumn("agree", F.col("sign") == F.col("second_sign"))


# --- probes of retrieval, and stages with models passed in ---------------------


def probe_ranks(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """``qid, rank``: place of each question's evidence round among its hits, -1 where it is missed.

    evidence: ``qid, round``. Several evidence rounds give several rows.
    """
    found = hits.select("qid", "round", "rank")
    return evidence.join(found, ["qid", "round"], "left").select("qid", "round", F.coalesce("rank", F.lit(-1)).alias("rank"))


def carriers(hits: DataFrame, records: DataFrame) -> DataFrame:
    """``superseded, downweighted, hits``: how many shown records have salience 0, or less than 1."""
    j = hits.select("id").join(records.select("id", "salience"), "id")
    return j.agg(F.count_if(F.col("salience") == 0).alias("superseded"), F.count_if((F.col("salience") > 0) & (F.col("salience") < 1)).alias("downweighted"), F.count(F.lit(1)).alias("hits"))


def evidence_moves(ranked: DataFrame, first: str, second: str, k: int = 2) -> DataFrame:
    """``question_id, same, entered, left``: whether the ranks of evidence changed between runs and crossed place k."""
    side = lambda r, c: ranked.where(F.col("run_id") == r).select("question_id", F.col("ranks").alias(c))
    j = side(first, "a").join(side(second, "b"), "question_id")
    inside = lambda c: F.exists(c, lambda r: (r > 0) & (r <= k))
    return j.select("question_id", F.col("a").eqNullSafe(F.col("b")).alias("same"), (inside("b") & ~inside("a")).alias("entered"), (inside("a") & ~inside("b")).alias("left"))


def histogram(df: DataFrame, value: str, width: int) -> DataFrame:
    """``low, rows, total``: rows and sums in bins of a width."""
    return df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).alias("low")).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))


def answer(questions: DataFrame, reader, batch: int = 64) -> DataFrame:
    """Adds ``predicted``: a reader is called with lists of (question, context) and gives their answers."""

    def run(batches):
        for b in batches:
            said: list = []
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                said += list(reader(list(zip(part["question"], part["context"]))))
            yield b.assign(predicted=said)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema) + ", predicted string"
    return questions.mapInPandas(run, schema)


def judge(predictions: DataFrame, grader, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``question_id, digest, correct`` of every distinct answer, and what is new to the cache.

    A grader is called with a prompt and says yes or no. Only answers that the
    cache lacks reach it; a cached no is held.
    """
    from palimpsest.operators.render import judge_prompt

    p = predictions.select("question_id", F.sha2(F.coalesce("predicted", F.lit("")), 256).alias("digest"), judge_prompt(*[F.col(c) for c in ("category", "question", "answer", "predicted", "is_abstention")]).alias("prompt"))
    wanted = p.groupBy("question_id", "digest").agg(F.min("prompt").alias("prompt"))
    known = cache.select("question_id", "digest", "correct") if cache is not None else predictions.sparkSession.createDataFrame([], "question_id string, digest string, correct boolean")
    todo = wanted.join(known, ["question_id", "digest"], "left_anti")

    def run(batches):
        for b in batches:
            yield b[["question_id", "digest"]].assign(correct=["yes" in grader(x).strip().lower() for x in b["prompt"]])

    fresh = todo.mapInPandas(run, "question_id string, digest string, correct boolean")
    return wanted.select("question_id", "digest").join(known.unionByName(fresh), ["question_id", "digest"]), fresh


#: Families of the contradiction demo: pairs, whether they conflict, and the least share to get right.
DEMO = {"value-change": (30, True, 0.8), "negation": (30, True, 0.9), "dated-update": (20, True, 0.9), "paraphrase": (10, False, 1.0), "unrelated": (10, False, 1.0)}


def demo_pairs(seed: int = 0) -> list[dict]:
    """A hundred made-up pairs of facts by family, from a seed."""
    import random

    r = random.Random(seed)
    towns, foods, firms = ["Boston", "Seattle", "Lisbon", "Oslo", "Quito", "Perth"], ["jazz", "chess", "tennis", "coffee", "sushi", "hiking"], ["Acme", "Globex", "Initech", "Umbrella", "Hooli"]
    out = []
    for family, (n, conflicts, _) in DEMO.items():
        for k in range(n):
            a, b = r.sample(towns, 2)
            f, (g, h) = r.choice(foods), r.sample(firms, 2)
            one, two, times = {
                "value-change": (("user", "lives in", a), ("user", "moved to", b), (None, None)),
                "negation": (("user", "likes", f), ("user", "no longer likes", f), (None, None)),
                "dated-update": (("user", "works at", g), ("user", "works for", h), (f"20{r.randint(10, 14)}", f"20{r.randint(15, 19)}")),
                "paraphrase": (("user", "lives in", a), ("The user", "living in", a.upper()), (None, None)),
                "unrelated": (("user", "likes", f), ("user", "owns", "a bike"), (None, None)),
            }[family]
            out.append({"pair": f"{family}-{k}", "family": family, "conflicts": conflicts, "facts": [(one, times[0], "2023-01-01"), (two, times[1], "2023-06-01")]})
    return out


def demo_result(spark, seed: int = 0) -> DataFrame:
    """``family, pairs, right, gate, passes`` of the contradiction rules over the demo pairs: the later fact must stand."""
    from palimpsest.functions import triples
    from palimpsest.operators import conflict

    rows = [(2 * n + k, p["pair"], *t, vt, at, "user: x") for n, p in enumerate(demo_pairs(seed)) for k, (t, vt, at) in enumerate(p["facts"])]
    f = spark.createDataFrame(rows, "id bigint, user_id string, subject string, predicate string, object string, valid_time string, created_at string, raw string")
    f = f.withColumn("t", triples.triple_column(F.col("subject"), F.col("predicate"), F.col("object"))).withColumn("pair_key", F.concat_ws("|", "t.subject", "t.predicate")).withColumn("kind", F.lit("fact")).drop("t")
    lost = conflict.resolve_all(conflict.keyed_facts(f)).select((F.col("loser") - F.col("loser") % 2).alias("base"), (F.col("winner") % 2 == 1).alias("later_wins"))
    pairs = spark.createDataFrame([(2 * n, p["family"], p["conflicts"]) for n, p in enumerate(demo_pairs(seed))], "base bigint, family string, conflicts boolean")
    right = F.when(F.col("conflicts"), F.coalesce("later_wins", F.lit(False))).otherwise(F.col("later_wins").isNull())
    gate = F.create_map(*[x for k, v in DEMO.items() for x in (F.lit(k), F.lit(v[2]))])
    s = pairs.join(lost, "base", "left").groupBy("family").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(right).alias("right"))
    return s.withColumn("gate", gate[F.col("family")]).withColumn("passes", F.col("right") >= F.col("gate") * F.col("pairs"))
