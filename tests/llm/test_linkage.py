import re

import numpy as np
import pytest

from palimpsest.llm import linkage

DIM = 6
MEM = "id bigint, user_id string, kind string, content string, created_at string, embedding array<float>, rec string, scope string"
ARR = "arrival_id bigint, batch_no int, user_id string, kind string, content string, created_at string, embedding array<float>, g string, kh string"


def _model(memories, arrivals, threshold=0.95):
    norm = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (t or "").lower())).strip()

    def vec(v):
        if v is None or len(v) != DIM or not any(v):
            return None
        x = np.asarray(v, "f4").astype(float)
        return x / np.linalg.norm(x)

    known, near, out = set(), {}, {}
    for i, u, k, c, _, v in {m[0]: m for m in memories}.values():
        known.add((u, k, norm(c)))
        if vec(v) is not None:
            near.setdefault((u, k), []).append(vec(v))
    for a, b, u, k, c, _, v in sorted({a[0]: a for a in arrivals}.values(), key=lambda a: (a[1], a[0])):
        n, x = norm(c), vec(v)
        if n and (u, k, n) in known:
            out[a] = "exact"
        elif x is not None and any(round(float(x @ y), 6) >= threshold for y in near.get((u, k), [])):
            out[a] = "cosine"
        else:
            out[a] = None
            known.add((u, k, n))
            if x is not None:
                near.setdefault((u, k), []).append(x)
    return out


def _data(seed, n=120, m=200):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(25, DIM))
    texts = [f"Text number {i}!" for i in range(60)] + ["", "  ", None, "?!"]

    def row(i):
        u, k = [None, "u0", "u1"][rng.integers(3)], ["round", "fact"][rng.integers(2)]
        v = (base[rng.integers(25)] + rng.normal(size=DIM) * 0.15).astype("f4").tolist()
        if rng.random() < 0.1:
            v = [None, [0.0] * DIM, [1.0]][rng.integers(3)]
        t = texts[rng.integers(len(texts))] if rng.random() < 0.5 else f"own text {i}"
        return u, k, t if t is None or rng.random() < 0.7 else t.upper() + " .", "2023-01-0%d" % rng.integers(1, 9), v

    memories = [(i, *row(i)) for i in range(n)]
    arrivals = [(i, int(rng.integers(1, 4)), *row(1000 + i)) for i in range(m)]
    return memories + memories[:5], arrivals + arrivals[:7]


def _frames(spark, memories, arrivals):
    return spark.createDataFrame([(*m, "x", "y") for m in memories], MEM), spark.createDataFrame([(*a, "x", "y") for a in arrivals], ARR)


@pytest.mark.parametrize("rounds", [False, True])
def test_equals_the_walk(spark, monkeypatch, rounds):
    if rounds:
        monkeypatch.setattr(linkage, "WALK_ROWS", 0)
    memories, arrivals = _data(7)
    got = linkage.link_batches(*_frames(spark, memories, arrivals), dim=DIM).collect()
    assert {r["id"]: r["screen"] for r in got} == _model(memories, arrivals)
    for r in got:
        assert (r["cosine"] is not None) == (r["screen"] == "cosine") == (r["weight"] is not None) and (r["neighbour"] is None) == (r["screen"] is None)


def _links(memories, arrivals, dropped, threshold=0.95):
    """Pairs of records that the model joins: equal content or near vectors of one scope, an arrival's with what was there before it."""
    norm = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (t or "").lower())).strip()

    def vec(v):
        x = np.zeros(DIM) if v is None or len(v) != DIM or not any(v) else np.asarray(v, "f4").astype(float)
        return x / (np.linalg.norm(x) or 1)

    old = [(f"m:{i}", (u, k), norm(c), vec(v)) for i, u, k, c, _, v in {m[0]: m for m in memories}.values()]
    out = [(a[0], b[0]) for a in old for b in old if a[1] == b[1] and ((a[2] and a[2] == b[2]) or (a[3].any() and (a[3] == b[3]).all()))]
    by_batch: dict = {}
    for a, n, u, k, c, _, v in sorted({a[0]: a for a in arrivals}.values(), key=lambda a: (a[1], a[0])):
        by_batch.setdefault(n, []).append((f"a:{a}", (u, k), norm(c), vec(v), a))
    for n in sorted(by_batch):
        new = by_batch[n]
        for x in new:
            for y in old + [z for z in new if z[4] < x[4]]:
                if x[1] == y[1] and x[3] @ y[3] > threshold - 5e-7:
                    out.append((x[0], y[0]))
                if x[1] == y[1] and x[2] and x[2] == y[2] and dropped.get(x[4]) == "exact":
                    out.append((x[0], y[0]))
        old = old + [z[:4] for z in new if dropped[z[4]] is None]
    return out


@pytest.mark.parametrize("rows,deepest", [(linkage.UNION_ROWS, linkage.DEEPEST), (0, 2)])
def test_clusters(spark, monkeypatch, rows, deepest):
    """With every agreement speaking for a match, clusters are the components of all links, named by their first record."""
    monkeypatch.setattr(linkage, "UNION_ROWS", rows)
    monkeypatch.setattr(linkage, "DEEPEST", deepest)
    monkeypatch.setattr(linkage, "learn_weights", lambda counts: np.ones(linkage.PATTERNS))
    memories, arrivals = _data(9, n=80, m=60)
    got = linkage.link_batches(*_frames(spark, memories, arrivals), dim=DIM).collect()
    forest = linkage._Forest()
    order = lambda rec: (rec[0] == "a", int(rec[2:]))
    for a, b in _links(memories, arrivals, {r["id"]: r["screen"] for r in got}):
        forest.join(order(a), order(b))
    want = {r["id"]: forest.find((True, r["id"])) for r in got}
    assert {r["id"]: r["cluster"] for r in got} == {i: f"{'a' if x[0] else 'm'}:{x[1]}" for i, x in want.items()}
    assert len({r["cluster"] for r in got}) > 3


def test_weights():
    none = linkage.learn_weights(np.zeros(linkage.PATTERNS))
    counts = np.zeros(linkage.PATTERNS)
    counts[linkage.FULL], counts[linkage.FULL - 2], counts[0], counts[1] = 300, 40, 5000, 2000
    w = linkage.learn_weights(counts)
    assert none[linkage.FULL] > 0 > none[0] and w[linkage.FULL] > w[linkage.FULL - 2] > 0 > w[0]
    at = linkage.pattern(np.array([0.8, 0.95, 0.9499, 1.0]), np.array([False, True, True, True]), np.array([False, False, True, True]))
    assert at.tolist() == [0, 10, 7, linkage.FULL]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    forest = linkage._Forest()
    for a, b in edges:
        forest.join(a, b)
    want = {n: forest.find(n) for a, b in edges if a != b for n in (a, b)}
    df = spark.createDataFrame(edges, "x bigint, y bigint")
    for few in (True, False):
        assert {r["node"]: r["root"] for r in linkage.components(df, few).collect()} == want


def test_only_probed_lists_are_read(spark, monkeypatch):
    """A batch of one user gets no stored row of another user to Python, and reads no part or bucket but its own."""
    memories, arrivals = _data(11, n=300)
    m, a = _frames(spark, memories, [x for x in arrivals if x[2] == "u0"][:5])
    with linkage.IncrementalLinkage(spark, dim=DIM) as state:
        state.bootstrap(m)
        seen = spark.sparkContext.accumulator(0)
        plain = linkage.unpack
        monkeypatch.setattr(linkage, "unpack", lambda col, dim: seen.add(len(col)) or plain(col, dim))
        rows = linkage.materialize(state._lists(linkage._records(a, "arrival_id", linkage.ARRIVALS, DIM), *linkage.PROBE), "rows")
        state._links(rows, 2, len(arrivals)).count()
        own = len({x[0] for x in memories if x[1] == "u0"})
        assert 0 < seen.value <= own + 12 * 5


def test_rounds_of_a_hot_cluster(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, linkage.ARRIVALS + i, "s", None, i, None, None, None, None) for i in range(18)], "id bigint, rec bigint, scope string, kh binary, g bigint, same bigint, near bigint, near_c double, near_pat int")
    near = spark.createDataFrame([(i, j, 0.96, 10, "s") for i in range(18) for j in range(i) if i < 15 or i - j == 1], "g bigint, h bigint, c double, pat int, scope string")
    cols = ["id", "screen", "neighbour", "cosine", "pat", "g"]
    want = sorted(map(tuple, linkage.walk_scopes(nodes, near).select(*cols).collect()))
    made, plain = [], linkage.materialize
    monkeypatch.setattr(linkage, "materialize", lambda df, name: made.append(name) or plain(df, name))
    for most, states in ((0, 7), (4, 4)):  # rounds to the end of the chain; rounds, then a task
        monkeypatch.setattr(linkage, "WALK_ROWS", most)
        made.clear()
        assert sorted(map(tuple, linkage.walk_rounds(nodes, near).select(*cols).collect())) == want
        assert made.count("state") <= states


def test_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "LIST_ROWS", 20)
    monkeypatch.setattr(linkage, "BLOCK", 4)
    memories, arrivals = _data(8, n=300)
    got = {r["id"]: r["screen"] for r in linkage.link_batches(*_frames(spark, memories, arrivals), dim=DIM).collect()}
    want = _model(memories, arrivals)
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)


def test_hot_copies(spark):
    arrivals = [(i, 1, "u", "round", "the same", "2023-01-01", [1.0] * DIM) for i in range(400)]
    got = linkage.link_batches(*_frames(spark, [], arrivals), dim=DIM).collect()
    assert sum(r["screen"] is None for r in got) == 1 and sum(r["screen"] == "exact" for r in got) == 399


def test_empty(spark):
    assert linkage.link_batches(*_frames(spark, [], []), dim=DIM).count() == 0
    m, _ = _data(3)
    assert linkage.link_batches(*_frames(spark, m, []), dim=DIM).count() == 0


def test_a_batch_broadcasts_little(spark):
    """What a batch broadcasts and plans stays in the driver for a while, so it adds up over batches."""
    store, (memories, arrivals) = spark._jsparkSession.sharedState().statusStore(), _data(12)
    with linkage.IncrementalLinkage(spark, dim=DIM) as state:
        m, a = _frames(spark, memories, arrivals)
        state.bootstrap(m)
        a = linkage.materialize(linkage.once(a.drop("g", "kh"), "arrival_id"), "arrivals")
        begun = store.executionsCount()
        for n in (1, 2, 3):
            state.process(a.where(f"batch_no = {n}"))
        for done in state.joins:
            done.result()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        ids = [e.executionId() for e in _seq(store.executionsList(begun, 10_000))]
        names = [x.name() for i in ids for x in _seq(store.planGraph(i).allNodes())]
    assert 0 < names.count("BroadcastExchange") <= 3 * 7


def _seq(s):
    return [s.apply(k) for k in range(s.size())]
