"""The most similar vectors of every vector, within its scope.

Equal vectors of a scope are searched once: the group's smallest ids stand for
it, as no other of its members can be among anyone's nearest. Groups are put
into balanced posting lists (``vectors``), near a boundary into several; all
members of a list are compared with each other by matrix products in double.
The best of every list are merged into the best of every group, and groups are
written out to records again. A list larger than planned (a level at its last
size) is compared in blocks by several tasks, so that its size is bounded only
by the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.vectors import Codebook, fit_codebook, pack, unpack
from palimpsest.session import materialize, small_enough

REPLICAS, RATIO, LIST_ROWS = 4, 1.12, 800
#: Lists that a vector asks where there is no floor, each vector standing in its nearest list only, and their share of all lists at least.
PROBE, SHARE = 12, 0.05
#: Rows of the lists that go to Python in one group, about.
GROUP_ROWS = 50_000
#: Rows of a list compared by one task at a time.
BLOCK = 4096


def vector_members(rows: DataFrame, scope: str, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``scope, id, vec`` of records that take part; null scopes form one scope."""
    packed = rows.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim)).select(F.coalesce(F.col(scope).cast("string"), F.lit("\u0000")).alias("scope"), F.col(id_col).alias("id"), pack(F.col(vec_col), dim).alias("vec"))
    return packed.where(F.octet_length("vec") > 0)


def vector_groups(members: DataFrame) -> DataFrame:
    """``scope, vec, rep, many``: one row for each distinct vector of a scope.

    A record delivered twice falls into one group. ``many``: more than one id.
    """
    return members.groupBy("scope", "vec").agg(F.min("id").alias("rep"), (F.min("id") < F.max("id")).alias("many"))


def _assign(rows: DataFrame, book_b, probe: int) -> DataFrame:
    """Rows ``scope, rep, vec, rows`` written into their lists: adds ``list, held``.

    With ``probe`` a row is held by its nearest list and asks that many; else it
    is held by all lists that it asks.
    """
    width, ratio, share = (probe, float("inf"), SHARE) if probe else (REPLICAS, RATIO, 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book: Codebook = book_b.value
        for b in batches:
            if not len(b):
                continue
            level = book.level_of(b["rows"].to_numpy())
            r, lists, ranks = book.lists(unpack(b["vec"], book.dim), level, width, ratio, share)
            out = b.iloc[r][["scope", "rep", "vec"]].reset_index(drop=True)
            out["list"], out["held"] = lists, ranks == 0 if probe else True
            yield out

    return rows.mapInPandas(run, "scope string, rep bigint, vec binary, list int, held boolean")


def top_of_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, neighbour, cosine``: the k best of ``ids`` for each of ``qids``, equal cosines by smaller id."""
    out_q, out_n, out_c = [], [], []
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    for at in range(0, len(qids), 1024):
        s = q[at : at + 1024] @ x.T
        floor = least - 1e-6
        if k + 1 < len(ids):  # beyond the k best besides itself, only what may be equal to them after rounding
            floor = np.maximum(floor, np.partition(s, len(ids) - k - 1, axis=1)[:, [len(ids) - k - 1]] - 2e-6)
        r, j = np.nonzero(s >= floor)
        c = np.round(s[r, j], 6)
        keep = (c >= least) & (ids[j] != qids[at + r])
        r, j, c = r[keep], j[keep], c[keep]
        if not len(r):
            continue
        o = np.lexsort((j, -c, r))
        r, j, c = r[o], j[o], c[o]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        pos = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
        top = pos < k
        out_q.append(qids[at + r[top]]), out_n.append(ids[j[top]]), out_c.append(c[top])
    if not out_q:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0)
    return np.concatenate(out_q), np.concatenate(out_n), np.concatenate(out_c)


def nearest(rows: DataFrame, k: int = 5, least: float = 0.9, scope: str = "user_id", id_col: str = "id", vec_col: str = "embedding", dim: int = 64, probe: int = 0) -> DataFrame:
    """``id, neighbour, cosine, rank``: up to k most similar records of each record's scope.

    Only neighbours of cosine ``least`` or more (rounded to 6 decimals) are
    given; a low floor wants ``probe`` lists asked (``PROBE``), and then those
    that still lack neighbours ask every list of their scope. Vectors that are null, all zero, of another length or not finite
    take no part; an empty table gives no rows. Recall is that of the lists:
    exact for scopes of up to ``LIST_ROWS`` distinct vectors, else measured in
    the tests against brute force.
    """
    spark = rows.sparkSession
    members = vector_members(rows, scope, id_col, vec_col, dim)
    groups = materialize(vector_groups(members), "groups")
    sizes = groups.groupBy("scope").agg(F.count(F.lit(1)).alias("rows"))
    total, largest = sizes.agg(F.sum("rows"), F.max("rows")).first()
    book_b = spark.sparkContext.broadcast(fit_codebook(groups, dim, total or 1, largest or 1, LIST_ROWS))
    # Scopes that are one list need no size: only large ones are joined, by broadcast while they are few.
    large = sizes.where(F.col("rows") > LIST_ROWS)
    large = F.broadcast(large) if small_enough(large, 100_000) else large
    sized = groups.join(large, "scope", "left").select("scope", "rep", "vec", F.coalesce("rows", F.lit(1)).alias("rows"))
    # Groups of lists that go to Python at once follow the rows, not only the cluster.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-(total or 0) * (probe or REPLICAS) // GROUP_ROWS // 8))
    listed = materialize(_assign(sized, book_b, probe), "lists")
    pairs = materialize(_compare(listed, parts, k, least, dim), "pairs")
    if probe:
        lists = listed.where("held").select("scope", "list").distinct()
        found = pairs.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("q").alias("rep"))
        short = sized.where(F.col("rows") > 1).select("scope", "rep", "vec").join(found, "rep", "left_anti")
        short = materialize(short, "short")
        if short.limit(1).count():
            asks = short.join(lists, "scope").select("scope", "rep", "vec", "list", F.lit(False).alias("held"))
            held = listed.where("held").join(asks.select("scope", "list").distinct(), ["scope", "list"], "left_semi")
            more = _compare(held.select(*asks.columns).unionByName(asks), parts, k, least, dim)
            pairs = materialize(pairs.unionByName(more).distinct(), "pairs")
    return _records(pairs, members, groups, k)


def _compare(listed: DataFrame, parts: int, k: int, least: float, dim: int) -> DataFrame:
    """``q, n, c``: best groups of every group within each of its lists."""
    sizes = listed.groupBy("scope", "list").agg(F.count(F.lit(1)).alias("size"))
    over = sizes.where(F.col("size") > 4 * BLOCK).select("scope", "list", F.ceil(F.col("size") / (2 * BLOCK)).cast("int").alias("blocks"))
    if over.limit(1).count():
        over = F.broadcast(over) if small_enough(over, 100_000) else over
        rows = listed.join(over, ["scope", "list"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        rows = listed.withColumn("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # As data a row stands in its own block; as a query in every block of its list.
    query = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("data", F.col("held") & (F.col("block") == own))
    keyed = query.select(F.xxhash64("scope", "list", "block").alias("lk"), "rep", "vec", "data")
    keyed = keyed.withColumn("bucket", F.pmod("lk", F.lit(parts * 8)).cast("int"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        lk, rep, data = b["lk"].to_numpy(), b["rep"].to_numpy(), b["data"].to_numpy()
        x = unpack(b["vec"], dim)
        order = np.argsort(lk, kind="stable")
        cuts = np.flatnonzero(np.r_[True, lk[order][1:] != lk[order][:-1], True])
        got = []
        for a, z in zip(cuts[:-1], cuts[1:]):
            at = order[a:z]
            if z - a > 1:
                d = at[data[at]]
                got.append(top_of_block(rep[d], x[d], rep[at], x[at], k, least))
        if not got:
            return pd.DataFrame({"q": [], "n": [], "c": []})
        return pd.DataFrame({"q": np.concatenate([g[0] for g in got]), "n": np.concatenate([g[1] for g in got]), "c": np.concatenate([g[2] for g in got])})

    return keyed.groupBy("bucket").applyInPandas(run, "q bigint, n bigint, c double").distinct()


def _records(pairs: DataFrame, members: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """From groups back to records, k nearest of each."""
    best = Window.partitionBy("q").orderBy(F.desc("c"), "n")
    pairs = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    copies = groups.where("many").select("scope", "vec", "rep")
    # Few vectors stand more than once; digests let the members be probed without moving vectors.
    digest = lambda d: d.withColumn("key", F.sha2(F.concat(F.encode(F.concat("scope", F.lit("|")), "UTF-8"), "vec"), 256))
    held = digest(members).select("key", "id").join(digest(copies).select("key", "rep"), "key").select("rep", "id").distinct()
    held = materialize(held, "copies")
    few = Window.partitionBy("rep").orderBy("id")
    small = held.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).select(F.col("rep").alias("n"), F.col("id").alias("m"))
    to = pairs.join(small, "n", "left").select("q", F.coalesce("m", "n").alias("neighbour"), "c")
    # A copy group's own members are neighbours of each other.
    own = small.select(F.col("n").alias("q"), F.col("m").alias("neighbour"), F.lit(1.0).alias("c"))
    to = to.unionByName(own)
    full = to.join(held.select(F.col("rep").alias("q"), "id"), "q", "left").select(F.coalesce("id", "q").alias("id"), "neighbour", F.col("c").alias("cosine"))
    full = full.where(F.col("id") != F.col("neighbour"))
    last = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return full.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


def mutual_pairs(found: DataFrame) -> DataFrame:
    """``id_a, id_b``: each pair of neighbours once, smaller id first."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
