"""Ordered text: contexts for a reader, exports of a store, prompts for a judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prompts by which answers are judged.
STANDARD = """I will give you a question, a correct answer, and a response from a model. Please answer yes if the response contains the correct answer. Otherwise, answer no. If the response is equivalent to the correct answer or contains all the intermediate steps to get the correct answer, you should also answer yes. If the response only contains a subset of the information required by the answer, answer no. 

Question: {q}

Correct Answer: {a}

Model Response: {r}

Is the model response correct? Answer yes or no only."""
TEMPORAL = """I will give you a question, a correct answer, and a response from a model. Please answer yes if the response contains the correct answer. Otherwise, answer no. If the response is equivalent to the correct answer or contains all the intermediate steps to get the correct answer, you should also answer yes. If the response only contains a subset of the information required by the answer, answer no. In addition, do not penalize off-by-one errors for the number of days. If the question asks for the number of days/weeks/months, etc., and the model makes off-by-one errors (e.g., predicting 19 days when the answer is 18), the model's response is still correct. 

Question: {q}

Correct Answer: {a}

Model Response: {r}

Is the model response correct? Answer yes or no only."""
UPDATE = """I will give you a question, a correct answer, and a response from a model. Please answer yes if the response contains the correct answer. Otherwise, answer no. If the response contains some previous information along with an updated answer, the response should be considered as correct as long as the updated answer is the required answer.

Question: {q}

Correct Answer: {a}

Model Response: {r}

Is the model response correct? Answer yes or no only."""
PREFERENCE = """I will give you a question, a rubric for desired personalized response, and a response from a model. Please answer yes if the response satisfies the desired response. Otherwise, answer no. The model does not need to reflect all the points in the rubric. The response is correct as long as it recalls and utilizes the user's personal information correctly.

Question: {q}

Rubric: {a}

Model Response: {r}

Is the model response correct? Answer yes or no only."""
ABSTENTION = """I will give you an unanswerable question, an explanation, and a response from a model. Please answer yes if the model correctly identifies the question as unanswerable. The model could say that the information is incomplete, or some other information is given but the asked information is not.

Question: {q}

Explanation: {a}

Model Response: {r}

Does the model correctly identify the question as unanswerable? Answer yes or no only."""
PROMPTS = {"single-session-user": STANDARD, "single-session-assistant": STANDARD, "multi-session": STANDARD, "temporal-reasoning": TEMPORAL, "knowledge-update": UPDATE, "single-session-preference": PREFERENCE}


#: Fixed value: the prompt by which a reader answers.
READER = """{b}

I will give you several history chats between you and a user. Please answer the question based on the relevant chat history. Answer the question step by step: first extract all the relevant information, and then reason over the information to get the answer. If the chat history does not contain enough information to answer the question, say that you do not know rather than guessing.


History Chats:

{c}

Current Date: {d}
Question: {q}
Answer (step by step):"""


def reader_prompt(context: Column, question: Column, question_date: Column, first: Column) -> Column:
    """The prompt that a reader answers. ``first`` leads it and differs from question to question, so that no cached beginning is shared; nulls count as empty."""
    return _filled(READER, {"{b}": first, "{c}": context, "{d}": question_date, "{q}": question})


def _filled(template: str, marks: dict[str, Column]) -> Column:
    """A template with columns in place of its marks, which stand in this order."""
    parts, rest = [], template
    for mark, column in marks.items():
        before, rest = rest.split(mark, 1)
        parts += [F.lit(before), F.coalesce(column, F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def judge_prompt(category: Column, question: Column, answer: Column, response: Column, abstention: Column) -> Column:
    """The prompt that judges a response. An unknown category is an error, unless the question cannot be answered."""

    filled = lambda template: _filled(template, {"{q}": question, "{a}": answer, "{r}": response})
    by_kind = None
    for name, template in PROMPTS.items():
        by_kind = F.when(category == name, filled(template)) if by_kind is None else by_kind.when(category == name, filled(template))
    unknown = F.raise_error(F.concat(F.lit("no prompt for category "), F.coalesce(category, F.lit("null"))))
    return F.when(F.coalesce(abstention, F.lit(False)), filled(ABSTENTION)).otherwise(by_kind.otherwise(unknown))


def said_yes(verdict: Column) -> Column:
    return F.contains(F.lower(F.trim(verdict)), F.lit("yes"))


def turn_lines(turns: Column) -> Column:
    """``role: content``, a line a turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t.role, F.lit("")), F.lit(": "), F.coalesce(t.content, F.lit("")))), "\n")


def header(ts: Column) -> Column:
    return F.concat(F.lit("[Session date: "), ts, F.lit("]"))


def session_text(ts: Column, turns: Column) -> Column:
    """A session's turns after its date; a session without a date has no header."""
    return F.when(F.coalesce(ts, F.lit("")) == "", turn_lines(turns)).otherwise(F.concat_ws("\n", header(ts), turn_lines(turns)))


def fact_text(fact: Column, valid_time: Column) -> Column:
    return F.when(F.coalesce(valid_time, F.lit("")) == "", F.coalesce(fact, F.lit(""))).otherwise(F.concat(F.coalesce(fact, F.lit("")), F.lit(" ("), valid_time, F.lit(")")))


def render(items: DataFrame, group: str, unit: str = "turns") -> DataFrame:
    """``group, context``: the items of each group as one text, oldest first.

    items: ``group, ts, id, turns`` and for other units ``facts`` (array of
    struct ``fact, valid_time, raw``). A header stands where the date changes;
    an item without a date stays under the one before. Units: ``turns``;
    ``round+facts`` (facts before the turns); ``facts`` (facts and their
    sources; the turns where there are none).
    """
    if unit not in ("turns", "round+facts", "facts"):
        raise ValueError(f"unknown unit {unit!r}")
    w = Window.partitionBy(group).orderBy(F.coalesce("ts", F.lit("")), F.coalesce("id", F.lit(0)))
    dated = F.nullif(F.col("ts"), F.lit(""))
    before = F.last(dated, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = dated.isNotNull() & ~before.eqNullSafe(dated)
    body = turn_lines(F.col("turns"))
    if unit == "round+facts":
        lines = F.transform("facts", lambda f: F.concat(F.lit("- "), fact_text(f.fact, f.valid_time)))
        body = F.when(F.size("facts") > 0, F.concat(F.lit("facts:\n"), F.array_join(lines, "\n"), F.lit("\n"), body)).otherwise(body)
    elif unit == "facts":
        lines = F.transform("facts", lambda f: F.concat(F.lit("fact: "), fact_text(f.fact, f.valid_time), F.lit("\nsource: "), F.coalesce(f.raw, F.lit(""))))
        body = F.when(F.size("facts") > 0, F.array_join(lines, "\n")).otherwise(body)
    block = F.when(opens, F.concat(header(dated), F.lit("\n"), body)).otherwise(body)
    placed = items.withColumn("n", F.row_number().over(w)).withColumn("block", block)
    return placed.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n").alias("context"))


def fact_line(r: str = "") -> Column:
    """One fact of an export, with all that is needed to read its history."""
    c = lambda n: F.col(f"{r}{n}")
    four = lambda x: x.cast("decimal(12,4)").cast("string")
    return F.concat(F.lit("  "), F.concat_ws(
        "  ",
        F.concat(F.lit("fact: "), F.coalesce(c("fact"), c("content"))),
        F.concat(F.lit("salience "), four(c("salience"))),
        F.when(F.abs(c("initial_salience") - c("salience")) > 1e-9, F.concat(F.lit("(initial "), four(c("initial_salience")), F.lit(")"))),
        F.when(c("salience") == 0, F.lit("superseded")),
        F.concat(F.lit("valid_time "), F.nullif(c("valid_time"), F.lit(""))),
        F.concat(F.lit("pair "), F.nullif(c("pair_key"), F.lit(""))),
        F.concat(F.lit("supersedes "), c("supersedes").cast("string")),
    ))


def export_lines(memories: DataFrame) -> DataFrame:
    """``user_id, ts, round_id, fact_id, line``: a store as lines in order of its columns.

    A round's line is its rendered text (fact_id 0), its facts follow; facts
    without their round come under no round, after all (round_id null). The
    lines stay rows, so that a user of any size is written by many tasks.
    """
    rounds = memories.where("kind = 'round'").select("user_id", F.coalesce("created_at", F.lit("")).alias("ts"), F.col("id").alias("round_id"), "round_key", session_text(F.col("created_at"), F.coalesce(F.when(F.size("turns") > 0, F.col("turns")), F.array(F.struct(F.col("source").alias("role"), F.col("content").alias("content"))))).alias("line"))
    facts = memories.where("kind = 'fact'").select("user_id", F.coalesce("created_at", F.lit("")).alias("fts"), F.col("id").alias("fact_id"), "round_key", fact_line().alias("fline"))
    home = rounds.where("round_key IS NOT NULL").groupBy("user_id", "round_key").agg(F.min(F.struct("ts", "round_id")).alias("h"))
    placed = facts.join(home, ["user_id", "round_key"], "left").select("user_id", F.coalesce("h.ts", "fts").alias("ts"), F.col("h.round_id").alias("round_id"), "fact_id", F.col("fline").alias("line"))
    return rounds.select("user_id", "ts", "round_id", F.lit(0).cast("bigint").alias("fact_id"), "line").unionByName(placed)


def markdown_bullets(memories: DataFrame) -> DataFrame:
    """``id, bullet`` of every fact: struck through if superseded, with the winner where one is known."""
    facts = memories.where("kind = 'fact'")
    won = facts.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("id")).agg(F.max("id").alias("winner"))
    said = F.when(F.coalesce("valid_time", F.lit("")) == "", F.coalesce("fact", "content")).otherwise(F.concat(F.coalesce("fact", "content"), F.lit(" (**"), F.col("valid_time"), F.lit("**)")))
    struck = F.concat(F.lit("- ~~"), said, F.lit("~~ (superseded"), F.coalesce(F.concat(F.lit(" by #"), F.col("winner").cast("string")), F.lit("")), F.lit(")"))
    plain = F.concat(F.lit("- "), said, F.coalesce(F.concat(F.lit(" → supersedes #"), F.col("supersedes").cast("string")), F.lit("")))
    return facts.join(won, "id", "left").select("id", F.when(F.col("salience") == 0, struck).otherwise(plain).alias("bullet"))


def render_json(items: DataFrame, group: str, unit: str = "turns") -> DataFrame:
    """``group, context``: the same blocks as :func:`render` as a JSON array.

    A block holds its date and its turns, or its items (facts, and turns unless
    the unit is ``facts`` and there are some). An item without a date stays in
    the block before; a leading one opens a block with a null date.
    """
    if unit not in ("turns", "round+facts", "facts"):
        raise ValueError(f"unknown unit {unit!r}")
    w = Window.partitionBy(group).orderBy(F.coalesce("ts", F.lit("")), F.coalesce("id", F.lit(0)))
    dated = F.nullif(F.col("ts"), F.lit(""))
    before = F.last(dated, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    n = F.row_number().over(w)
    opens = (dated.isNotNull() & ~before.eqNullSafe(dated)) | (n == 1)
    turns = F.transform("turns", lambda t: F.struct(F.coalesce(t.role, F.lit("")).alias("role"), F.coalesce(t.content, F.lit("")).alias("content")))
    if unit == "turns":
        body = turns
    else:
        facts = F.transform("facts", lambda f: F.struct(f.fact.alias("fact"), f.valid_time.alias("valid_time"), f.raw.alias("source")))
        shown = turns if unit == "round+facts" else F.when(F.size("facts") == 0, turns)
        body = F.array(F.struct(facts.alias("facts"), shown.alias("turns")))
    placed = items.select(group, n.alias("n"), dated.alias("date"), opens.cast("int").alias("opens"), body.alias("body"))
    blocked = placed.withColumn("block", F.sum("opens").over(Window.partitionBy(group).orderBy("n")))
    blocks = blocked.groupBy(group, "block").agg(F.max(F.when(F.col("opens") == 1, F.col("date"))).alias("session_date"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"])).alias("body"))
    one = F.struct("block", F.struct("session_date", F.col("body").alias("turns" if unit == "turns" else "items")).alias("b"))
    keep = {"ignoreNullFields": "false"} if unit == "turns" else {}
    return blocks.groupBy(group).agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["b"]), keep).alias("context"))
