"""Duplicate screens of the write path.

Exact duplicates fall to a window or aggregate. Near duplicates are decided by
the single nearest stored record of the same user and kind: links between
records at or above the threshold are found in blocks of rows, and only rows
with a link are walked in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from palimpsest.functions import text
from palimpsest.session import bounded, materialize

#: Rows of one block of a user's records.
BLOCK = 2000


def exact_duplicates(memories: DataFrame) -> DataFrame:
    """``id, first_id``: for each record the first of its user with the same normalized content.

    Rounds are compared in the whole store, facts within their session. Null
    and blank contents equal each other only where their keys do. One
    aggregate and a join on the digest; a hot text is one row after the first.
    """
    scope = F.when(F.col("kind") == "fact", F.coalesce("created_at", F.lit(""))).otherwise(F.lit(""))
    keyed = memories.select("id", F.xxhash64(F.coalesce("user_id", F.lit("\u0000")), "kind", scope).alias("s"), F.md5(text.exact_key(F.coalesce("content", F.lit("")))).alias("key"))
    first = keyed.groupBy("s", "key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return keyed.join(first.where("n > 1").drop("n"), ["s", "key"], "left").select("id", F.coalesce("first_id", "id").alias("first_id"))


def near_links(memories: DataFrame, threshold: float = 0.95, dim: int = 64) -> DataFrame:
    """``scope, id, earlier, cosine, same_session`` of records of one user and kind at or above the threshold.

    Rows are hashed into blocks by the size of their scope; each block of rows
    meets every block of earlier rows once, so that no task holds more than
    two blocks. Vectors that are null, of another length or all zero have no
    link.
    """
    fine = memories.where((F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0))
    rows = fine.select(F.xxhash64(F.coalesce("user_id", F.lit("\u0000")), "kind").alias("scope"), "id", F.coalesce("created_at", F.lit("")).alias("ts"), _packed_column(F.col("embedding")).alias("vec"))
    rows = materialize(rows, "dedup-rows")
    sizes = rows.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sized = rows.join(bounded(sizes), "scope").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("lo"), F.greatest("b", o).alias("hi")))
    cells = sized.select("scope", "id", "ts", "vec", "b", F.explode(pair).alias("cell"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(g["vec"]), dtype="<f4").reshape(-1, dim).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, ts, b = g["id"].to_numpy(), g["ts"].to_numpy(), g["b"].to_numpy()
        across = g["lo"].iloc[0] != g["hi"].iloc[0]
        out = []
        for at in range(0, len(g), 512):
            c = np.round(x[at : at + 512] @ x.T, 6)
            i, j = np.nonzero(c >= threshold)
            keep = ids[at + i] > ids[j]
            if across:
                keep &= b[at + i] != b[j]
            i, j = i[keep], j[keep]
            out.append(pd.DataFrame({"scope": g["scope"].iloc[0], "id": ids[at + i], "earlier": ids[j], "cosine": c[i, j], "same_session": ts[at + i] == ts[j]}))
        return pd.concat(out)

    grouped = cells.select("scope", "id", "ts", "vec", "b", "cell.lo", "cell.hi").groupBy("scope", "lo", "hi")
    return grouped.applyInPandas(run, "scope bigint, id bigint, earlier bigint, cosine double, same_session boolean")


def _packed_column(c):
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype="<f4").tobytes() for v in s], dtype=object)

    return F.pandas_udf(run, BinaryType())(c)


def nearest_earlier(links: DataFrame) -> DataFrame:
    """``id, earlier, cosine, same_session``: the nearest earlier record of each, ties by smaller id."""
    best = links.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("earlier")).alias("k"), "same_session")).alias("b"))
    return best.select("id", (-F.col("b.k")).alias("earlier"), "b.cosine", "b.same_session")


def greedy_drops(links: DataFrame, session_scope: bool = True) -> DataFrame:
    """``id, neighbour, cosine``: records dropped by the walk in order of id.

    Only stored records are neighbours. If the nearest one is in another
    session and the scope is the session, the record is stored, whatever else
    is near. The links of a scope are one task's stream, in order; it holds the
    ids dropped so far.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, last, dropped = None, None, set()
        for b in batches:
            out = []
            for s, i, o, c, same in zip(b["scope"].tolist(), b["id"].tolist(), b["earlier"].tolist(), b["cosine"], b["same_session"]):
                if s != scope:
                    scope, last, dropped = s, None, set()
                if i == last or o in dropped:  # decided already, or its neighbour is not stored
                    continue
                last = i
                if same or not session_scope:
                    dropped.add(i)
                    out.append((i, o, c))
            yield pd.DataFrame(out, columns=["id", "neighbour", "cosine"])

    ordered = links.repartition("scope").sortWithinPartitions("scope", "id", F.desc("cosine"), "earlier")
    return ordered.mapInPandas(walk, "id bigint, neighbour bigint, cosine double")
