import numpy as np
import pytest

from palimpsest.llm import neighbours, vectors


def _frame(spark, rows):
    return spark.createDataFrame([(i, u, None if v is None else [float(x) for x in v], "r", 1) for i, u, v in rows], "id bigint, user_id string, embedding array<float>, rep string, rows int")


def _brute(rows, k, least, dim):
    fine = {}
    for i, u, v in rows:
        if v is not None and len(v) == dim and any(x != 0 for x in v) and np.isfinite(v).all():
            x = np.asarray(v, "f4").astype(float)
            fine[i] = (u, x / np.linalg.norm(x))
    out = set()
    for i, (u, x) in fine.items():
        c = sorted((-round(float(x @ y), 6), j) for j, (w, y) in fine.items() if w == u and j != i and round(float(x @ y), 6) >= least)
        out |= {(i, j) for _, j in c[:k]}
    return out


def _data(n, dim, users, seed, copies=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 8), dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(size=dim) * 0.25
        if i and rng.random() < copies:
            v = np.asarray(rows[rng.integers(i)][2]) * (2.0 if rng.random() < 0.3 else 1.0)
        rows.append((i, f"u{rng.integers(users)}", v.astype("f4").tolist()))
    return rows


def test_exact_where_scopes_are_small(spark):
    rows = _data(400, 8, 3, 1)
    rows += [(900, "u0", None), (901, "u0", [0.0] * 8), (902, "u0", [1.0] * 5), (903, None, [1.0] * 8), (904, None, [1.0] * 8), (905, "u1", [float("nan")] * 8)]
    rows += [rows[3], rows[3]]
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(_frame(spark, rows), dim=8).collect()}
    assert got == _brute([(i, u or "\0", v) for i, u, v in rows], 5, 0.9, 8)


def test_hot_copies(spark):
    rows = [(i, "u", [1.0, 0.0, 0.0]) for i in range(300)] + [(1000, "u", [0.99, 0.1, 0.0])]
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(_frame(spark, rows), dim=3).collect()}
    assert got == _brute(rows, 5, 0.9, 3)


@pytest.mark.parametrize("block", [4096, 40])
def test_recall_with_lists(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 100)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rows = _data(4000, 16, 1, 2, copies=0.05)
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(_frame(spark, rows), dim=16).collect()}
    want = _brute(rows, 5, 0.9, 16)
    assert len(got & want) / len(want) >= 0.9


def test_query_has_no_floor(spark, tmp_path):
    from palimpsest.llm import queries

    rows = _data(300, 64, 3, 5)
    _frame(spark, rows).write.parquet(str(tmp_path / "memories.parquet"))
    got = {(r["id"], r["neighbour"]) for r in queries.p3_neighbours(spark, str(tmp_path)).collect()}
    assert got == _brute(rows, 5, -1, 64) and len(got) == 5 * len(rows)


def test_recall_without_floor(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 40)
    rows = _data(600, 16, 1, 6, copies=0.05)
    rows += [(9000 + i, "v", [1.0] * 15 + [float(i)]) for i in range(3)]
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(_frame(spark, rows), least=-1.0, dim=16, probe=12).collect()}
    want = _brute(rows, 5, -1, 16)
    assert len(got) == len(want)
    assert len(got & want) / len(want) >= 0.95


def test_few_in_a_list_ask_all(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 2)
    rows = _data(60, 8, 1, 9, copies=0)
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(_frame(spark, rows), least=-1.0, dim=8, probe=1).collect()}
    assert len(got) == 5 * len(rows)


def test_graph_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(4)
    c = rng.normal(size=(3000, 16)).astype("f4")
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    level = vectors.Level(c)
    q = c[rng.integers(3000, size=400)] + rng.normal(size=(400, 16)).astype("f4") * 0.15
    ids, _ = level.nearest(q, 8)
    assert (ids[:, 0] == (q @ c.T).argmax(axis=1)).mean() >= 0.95


def test_pairs_and_empty(spark):
    rows = [(2, "u", [1.0, 0.0]), (1, "u", [1.0, 0.01])]
    found = neighbours.nearest(_frame(spark, rows), dim=2)
    assert [tuple(r) for r in neighbours.mutual_pairs(found).collect()] == [(1, 2)]
    assert neighbours.nearest(_frame(spark, []), dim=2).count() == 0
