from pyspark.sql import functions as F
import random

import pytest

from palimpsest.llm import mixing

T = "source string, weight double, max_repeats int"


def _docs(spark, seed=1, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.choices(["big", "Mid ", "small-one", "other"], [6, 3, 1, 1])[0]
        rows.append((i, s, " ".join(r.choice(["apple", "stone", "river", "cloud"]) for _ in range(r.randint(1, 60))), i % 3, 9))
    rows += [(9000, "big", None, 1, 9), (9001, "big", "", 1, 9), (9002, None, "text", 1, 9), (None, "big", "text", 1, 9)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, quality int, tokens int")


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("big", 2.0, 1), ("mid", 1.0, 2), ("small_one", 1.0, 8), ("absent", 1.0, 3), ("zero", 0.0, 3), (None, 1.0, 1)], T)
    rows = {r["source"]: r for r in mixing.shares(_docs(spark), targets).collect()}
    assert rows["absent"]["actual_share"] == 0 and rows["zero"]["documents"] == 0
    for s in ("big", "mid", "small_one"):
        assert abs(rows[s]["actual_share"] - rows[s]["reachable_share"]) < 0.01
        assert rows[s]["most_repeats"] <= {"big": 1, "mid": 2, "small_one": 8}[s]


def test_same_seed_same_mix_and_repeats(spark):
    targets = spark.createDataFrame([("big", 1.0, 1), ("mid", 1.0, 5)], T)
    docs = _docs(spark)
    a, b, c = ({tuple(r) for r in mixing.mix(docs, targets, seed=s).collect()} for s in (1, 1, 2))
    assert a == b and a != c and len({x[0] for x in a}) == len(a)


def test_total_beyond_the_caps(spark):
    targets = spark.createDataFrame([("big", 1.0, 2)], T)
    got = mixing.mix(_docs(spark), targets, total_tokens=1e9).collect()
    assert {r["repeats"] for r in got} == {2}


def test_weights_make_documents_likelier(spark):
    targets = spark.createDataFrame([("big", 1.0, 1), ("mid", 1.0, 1)], T)
    docs = _docs(spark)
    got = mixing.mix(docs, targets, total_tokens=2000, weight_col="quality").join(docs.select("doc_id", "quality"), "doc_id").collect()
    assert got and all(r["quality"] > 0 for r in got)
    assert sum(r["quality"] == 2 for r in got) > sum(r["quality"] == 1 for r in got)


def test_inclusion_is_fair(spark):
    targets = spark.createDataFrame([("s", 1.0, 1), ("t", 1.0, 1)], T)
    docs = spark.createDataFrame([(i, "s", "one two three four", 1) for i in range(300)] + [(1000 + i, "t", "one two three four", 1) for i in range(100)], "doc_id bigint, source string, text string, k int")
    hits = [r["doc_id"] for seed in range(6) for r in mixing.mix(docs, targets, seed=seed).where("source = 's'").collect()]
    assert abs(len(hits) / 6 - 100) <= 1 and len(set(hits)) > 200


def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], T)
    docs = _docs(spark)
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
    assert mixing.shares(docs.limit(0), targets).collect()[0]["actual_share"] == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokens_of_whole_texts(spark, name):
    df = spark.createDataFrame([(1, "hello " * 20000), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.with_tokens(df, f"/opt/tokenizers/{name}").collect()}
    assert got[1] >= 20000 and got[2] == 0 and got[3] == 0 and got[4] > 1


def test_inclusion_follows_size(spark):
    """Over many sources of the same documents, a document comes in about as often as its share of the probability says."""
    sizes = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10] * 3
    docs = spark.createDataFrame([(1000 * s + k, f"s{s}", " ".join(["dog"] * n)) for s in range(300) for k, n in enumerate(sizes)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([(f"s{s}", 1.0, 1) for s in range(300)], "source string, weight double, max_repeats int")
    unit = mixing.with_tokens(docs.limit(1).select("doc_id", F.lit("dog dog").alias("text"))).first()["tokens"] / 2
    total = 300 * unit * sum(sizes) * 0.3
    got = mixing.mix(docs, targets, total, by_size=True).groupBy((F.col("doc_id") % 10 + 1).alias("n")).count().collect()
    seen = {r["n"]: r["count"] / 900 for r in got}
    scale = sum(sizes) * 0.3 / sum(n * n for n in sizes)
    assert all(abs(seen[n] - scale * n) < 0.06 for n in range(1, 11))
