import datetime as dt
import random
import re

import pytest

from palimpsest.operators import history as h

SCHEMA = "id bigint, user_id string, pair_key string, object string, valid_time string, created_at string, supersedes bigint, salience double, leaf string, start string"


def _model(rows):
    def start(v, c):
        for pattern, tail in ((r"\d{4}", "-01-01"), (r"\d{4}-\d{2}", "-01"), (r"\d{4}-\d{2}-\d{2}", "")):
            if v and re.fullmatch(pattern, v.strip()):
                try:
                    return dt.date.fromisoformat(v.strip() + tail)
                except ValueError:
                    break
        m = re.search(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", c or "")
        try:
            return dt.date(*map(int, m.groups())) if m else None
        except ValueError:
            return None

    keys = {}
    for i, u, k, o, v, c, s, sal, *_ in {r[0]: r for r in rows}.values():
        o = " ".join((o or "").split()).lower()
        d = start(v, c)
        if k is not None and o and d:
            keys.setdefault((u, "|".join(x.strip() for x in k.lower().split("|"))), {}).setdefault(d, []).append((i, o, s, sal))
    out = set()
    for days in keys.values():
        win = []
        for d in sorted(days):
            rs = days[d]
            named = {s for i, _, s, _ in rs if s is not None and s != i}
            rs = [r for r in rs if r[0] not in named]
            if not rs:
                continue
            rs = [r for r in rs if r[3] != 0] or rs
            win.append((d, max(rs)))
        heads = [w for k, w in enumerate(win) if not k or w[1][1] != win[k - 1][1][1]]
        for k, (d, r) in enumerate(heads):
            out.add((r[0], d.isoformat(), heads[k + 1][0].isoformat() if k + 1 < len(heads) else ""))
    return out


def _rows(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(1, n):
        rows.append((i, r.choice(["u", "v", None]), r.choice(["a|b", " A | B ", "a|c", None]), r.choice(["X", "x ", " y", "z  z", "Z z", "", None]),
                     r.choice([None, "2022", "2022-03", "2022-13", "2022-02-30", "2022-03-05", "soon", "0000"]),
                     r.choice(["2022-03-0%d" % r.randint(1, 9), "2022/3/5 (Sat) 10:00", "2023-01-02T00:00:00", "none", None]),
                     r.choice([None, None, r.randint(1, n)]), r.choice([0.0, 0.5, 1.0, None]), "x", "y"))
    return rows + rows[:9]


@pytest.mark.parametrize("seed,snapshots,bits", [(1, 1, 16), (2, 3, 4), (3, 2, 8)])
def test_equals_the_model(spark, seed, snapshots, bits):
    rows = _rows(seed)
    got = {tuple(r) for r in h.attribute_history(spark.createDataFrame(rows, SCHEMA), snapshots, bits).select("id", "valid_from", "valid_to").collect()}
    assert got == _model(rows)


def test_only_differing_leaves_are_found(spark):
    a = spark.createDataFrame([(i, f"k{i}", "v") for i in range(500)], "id int, key string, value string")
    b = a.where("id <> 7").unionByName(spark.createDataFrame([(900, "k900", "v"), (8, "k8", "w")], a.schema)).where("NOT (id = 8 AND value = 'v')")
    x, y = h.merkle_leaves(a, ["key"]), h.merkle_leaves(b, ["key"])
    got = {r["leaf"] for r in h.differing_leaves(x, y).collect()}
    want = {r["leaf"] for r in a.where("key IN ('k7', 'k8')").unionByName(b.where("key IN ('k8', 'k900')")).select(h._leaf(["key"], 16).alias("leaf")).collect()}
    assert got == want and h.differing_leaves(x, x).count() == 0


def test_keys_that_leave_are_closed(spark):
    rows = spark.createDataFrame([(1, "u", "a|b", "x", "2022", "2022-01-01", None, 1.0, "", ""), (2, "u", "a|c", "y", "2022", "2022-01-01", None, 1.0, "", ""), (3, None, "a|d", "z", "2022", "2022-01-01", None, 1.0, "", "")], SCHEMA)
    hist = h.MerkleHistory()
    facts = h.fact_records(rows)
    ends = lambda df: {r["id"]: r["valid_to"] for r in df.collect()}
    assert ends(hist.apply(facts)) == {1: "", 2: "", 3: ""}
    assert ends(hist.apply(facts.where("key = 'a|b'"), "2023-05-01")) == {1: "", 2: "2023-05-01", 3: "2023-05-01"}
    assert ends(hist.apply(facts)) == {1: "", 2: "", 3: ""}
    assert ends(hist.apply(facts.where("key = 'none'"))) == {1: "", 2: "", 3: ""}  # an empty snapshot has no day


def test_only_changes_are_appended(spark):
    rows = [(i, "u", f"a|k{i % 50}", f"v{i}", f"2022-{1 + i // 50:02d}", "2022-01-01", None, 1.0, "", "") for i in range(200)]
    facts = h.fact_records(spark.createDataFrame(rows, SCHEMA))
    hist = h.MerkleHistory(16)
    hist.apply(facts.where("id < 199"))
    hist.apply(facts)
    assert [spark.read.parquet(d).count() for d in hist.log] == [199, 3]  # the version before ends: one withdrawn and two added
    hist.apply(facts)
    assert spark.read.parquet(hist.log[-1]).count() == 0 and hist.table().count() == 200


def test_empty_and_bad_bits(spark):
    assert h.attribute_history(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        h.MerkleHistory(5)
