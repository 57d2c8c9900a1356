"""Posting lists over vectors: packing, balanced codebooks, centroid search.

A codebook has levels of growing size. A scope (one user, say) uses the level
that brings its lists to about ``list_rows`` rows: a scope of up to that size
is one list, in which every search is exact. The centroids of a level are
fitted on a bounded sample (``FIT_ROWS``) by k-means with a penalty for large
lists; every row is then assigned, whatever its place in the sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Rows that the codebook is fitted on, at most.
FIT_ROWS = 20_000
LEVEL_GROWTH = 4
#: Centroids that a walk keeps in view, at least.
BEAM = 64
#: Centroids of the largest level, at most; larger lists than planned are searched in blocks.
MAX_CENTROIDS = 4096


def pack(c: Column, dim: int) -> Column:
    """A usable array of floats as bytes, which move to Python without conversion of each number; else no bytes.

    Usable is an array of ``dim`` numbers, none missing or not finite, not all
    zero. Looked at by matrices, as a function of each number would cost more
    than all else that is done with it.
    """

    def packed(s: pd.Series) -> pd.Series:
        out = np.full(len(s), b"", dtype=object)
        at = np.flatnonzero([v is not None and len(v) == dim for v in s])
        if len(at):
            x = np.array([s.iloc[k] for k in at], dtype="<f4").reshape(len(at), dim)
            fine = np.isfinite(x).all(axis=1) & x.any(axis=1)
            for k, row in zip(at[fine], x[fine]):
                out[k] = row.tobytes()
        return pd.Series(out, dtype=object)

    return F.pandas_udf(packed, BinaryType())(c)


def unpack(col, dim: int) -> np.ndarray:
    """Rows of unit length, in double."""
    x = np.frombuffer(b"".join(col), dtype="<f4").reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Level:
    """Centroids of unit length with a graph over them."""

    centroids: np.ndarray
    hubs: np.ndarray = field(default=None)
    graph: np.ndarray = field(default=None)

    def __post_init__(self):
        n = len(self.centroids)
        if n <= 1:
            return
        c = self.centroids.astype(np.float32)
        degree = min(16, n - 1)
        near = np.empty((n, degree), dtype=np.int32)
        for at in range(0, n, 512):
            s = c[at : at + 512] @ c.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
            near[at : at + 512] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
        self.graph = near
        self.hubs = np.unique(np.linspace(0, n - 1, max(1, int(np.ceil(n**0.5 * 2)))).astype(np.int64))

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``ids, cosines`` of up to ``width`` near centroids of each row, best first.

        A walk over the graph: it starts at the best hubs and replaces its
        beam by the best of the beam and its neighbours until none improves.
        The beam is wider than what is asked for, as a narrow one ends beside
        the nearest centroid. Where the beam's neighbours are as many as the
        centroids, all of them are looked at.
        """
        n = len(self.centroids)
        c = self.centroids.astype(np.float32)
        width = min(width, n)
        beam = min(n, max(BEAM, 2 * width))
        out_i, out_s = np.empty((len(x), width), np.int32), np.empty((len(x), width), np.float32)
        step = 2048 if n <= beam * 17 else 256
        for at in range(0, len(x), step):
            q = x[at : at + step].astype(np.float32)
            if n <= beam * 17:
                best = q @ c.T
                ids = np.broadcast_to(np.arange(n, dtype=np.int32), best.shape)
            else:
                s = q @ c[self.hubs].T
                k = min(beam, len(self.hubs))
                pos = np.argpartition(-s, k - 1, axis=1)[:, :k]
                ids, best = self.hubs[pos].astype(np.int32), np.take_along_axis(s, pos, 1)
                for _ in range(12):
                    more = self.graph[ids].reshape(len(q), -1)
                    both = np.sort(np.concatenate([ids, more], axis=1), axis=1)
                    score = np.einsum("nd,nkd->nk", q, c[both], optimize=False)
                    score[:, 1:][both[:, 1:] == both[:, :-1]] = -3
                    w = min(beam, both.shape[1])
                    pos = np.argpartition(-score, w - 1, axis=1)[:, :w]
                    new, got = np.take_along_axis(both, pos, 1), np.take_along_axis(score, pos, 1)
                    done = new.shape == ids.shape and np.allclose(np.sort(got, axis=1), np.sort(best, axis=1))
                    ids, best = new, got
                    if done:
                        break
            top = np.argpartition(-best, width - 1, axis=1)[:, :width]
            ids, best = np.take_along_axis(ids, top, 1), np.take_along_axis(best, top, 1)
            order = np.argsort(-best, axis=1, kind="stable")
            ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
            out_i[at : at + step], out_s[at : at + step] = ids, best
        return out_i, out_s


@dataclass
class Codebook:
    dim: int
    list_rows: int
    levels: list[Level]

    def level_of(self, rows: np.ndarray) -> np.ndarray:
        """Level of scopes of so many rows."""
        sizes = np.array([len(v.centroids) for v in self.levels])
        want = np.ceil(np.asarray(rows) / self.list_rows)
        return np.minimum(np.searchsorted(sizes, want), len(sizes) - 1)

    def lists(self, x: np.ndarray, level: np.ndarray, replicas: int, ratio: float, share: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row, list, rank`` of every row's lists, nearest first.

        A row near a boundary stands in several lists: in each whose centroid
        is at most ``ratio`` times as far as the nearest one, up to
        ``replicas``, or up to a ``share`` of all lists where that is more.
        """
        rows, lists, ranks = [], [], []
        for k, lev in enumerate(self.levels):
            at = np.flatnonzero(level == k)
            if not len(at):
                continue
            if len(lev.centroids) == 1:
                rows.append(at), lists.append(np.zeros(len(at), np.int32)), ranks.append(np.zeros(len(at), np.int32))
                continue
            most = max(replicas, int(share * len(lev.centroids)))
            ids, cos = lev.nearest(x[at], max(most, 4))
            dist = np.sqrt(np.maximum(2 - 2 * cos, 0))
            keep = dist <= ratio * np.maximum(dist[:, :1], 1e-6)
            keep[:, 0] = True
            keep[:, most:] = False
            r, j = np.nonzero(keep)
            rows.append(at[r]), lists.append(ids[r, j]), ranks.append(j.astype(np.int32))
        if not rows:
            none = np.empty(0, np.int64)
            return none, none.astype(np.int32), none.astype(np.int32)
        return np.concatenate(rows), np.concatenate(lists), np.concatenate(ranks)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means in which a large list costs similarity, so that lists come out balanced."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    weight = np.zeros(k, np.float32)
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[a : a + 4096] @ c.T - weight, axis=1) for a in range(0, len(x), 4096)])
        size = np.bincount(own, minlength=k)
        c = np.zeros_like(c)
        np.add.at(c, own, x)
        empty = size == 0
        if empty.any():
            c[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        weight = (0.05 * np.clip(size / max(1.0, len(x) / k) - 1, 0, 2)).astype(np.float32)
    return c


def fit_codebook(vectors: DataFrame, dim: int, total: int, largest_scope: int, list_rows: int = 800, fit_rows: int = FIT_ROWS, seed: int = 7) -> Codebook:
    """Fit on about ``fit_rows`` of the ``total`` rows of ``vec`` (packed), picked by hash of their content, and at most 1.2 times as many."""
    want, sizes = -(-max(1, largest_scope) // list_rows), [1]
    while sizes[-1] < want and sizes[-1] < MAX_CENTROIDS:
        sizes.append(sizes[-1] * LEVEL_GROWTH)
    levels = [Level(np.zeros((1, dim)))]
    if len(sizes) > 1:
        share = min(1.0, fit_rows / max(1, total))
        drawn = vectors.select("vec").where(F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
        picked = drawn.limit(int(1.2 * fit_rows)).toPandas()["vec"]
        x = unpack(picked, dim).astype(np.float32)
        rng = np.random.default_rng(seed)
        levels += [Level(_kmeans(x, min(k, len(x)), rng)) for k in sizes[1:]]
    return Codebook(dim, list_rows, levels)
