"""The write path as a stream.

Sessions arrive as files. Segmentation is stateless; sessions delivered again
fall to a state of seen ids, bounded by a watermark on arrival; near
duplicates fall to a state of the stored vectors of each user and kind, walked
in the order in which records arrive. Only event time counts, late records are
taken, and there is no timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from palimpsest.operators.ingest import rounds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one key that are compared at once, and stored records that they meet at once.
BLOCK, PART = 512, 4096


def stream_sessions(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Sessions of a folder to which files are added, or of one file; a glob takes either."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path + "*")


def stream_rounds(sessions: DataFrame, delay: str = "30 days") -> DataFrame:
    """Rounds of each session once; a session delivered again within the delay is dropped.

    Rows without an arrival time are taken as arrived at the epoch.
    """
    timed = sessions.withColumn("arrived", F.coalesce(F.col("arrived_at").cast("timestamp"), F.lit(0).cast("timestamp")))
    once = timed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["session_id"])
    return rounds(once.select("session_id", "user_id", "session_date", "turns"))


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Stored:
    """The stored records of one key, in parts of about ``PART`` rows."""

    def __init__(self, rows: list[tuple]):
        self.parts: list[list] = []  # ids, sessions, vectors
        for at in range(0, len(rows), PART):
            p = rows[at : at + PART]
            self.add([r[0] for r in p], [r[1] for r in p], np.frombuffer(b"".join(r[2] for r in p), dtype="<f4").reshape(len(p), -1))

    def add(self, ids: list[int], ts: list[str], raw: np.ndarray) -> None:
        if self.parts and len(self.parts[-1][0]) + len(ids) <= PART:
            i, t, x = self.parts[-1]
            self.parts[-1] = [np.concatenate([i, np.asarray(ids, dtype=np.int64)]), t + ts, np.vstack([x, raw])]
        else:
            self.parts.append([np.asarray(ids, dtype=np.int64), ts, raw])

    def nearest(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, list, list]:
        """Cosine, id and session of the nearest record of each row, ties by smaller id; None where none is at the threshold."""
        best, found, session = np.full(len(x), -2.0), [None] * len(x), [None] * len(x)
        for ids, ts, raw in self.parts:
            c = _unit(raw) @ x.T
            hit = np.flatnonzero(np.fmax.reduce(c, axis=0) >= threshold - 1e-6)
            c = np.round(c[:, hit], 6)
            top = np.fmax.reduce(c, axis=0)
            first = np.where(c == top, ids[:, None], np.iinfo(np.int64).max).argmin(axis=0)
            for k, m, j in zip(hit.tolist(), top.tolist(), first.tolist()):
                i = int(ids[j])
                if m >= threshold and (found[k] is None or (-m, i) < (-best[k], found[k])):
                    best[k], found[k], session[k] = m, i, ts[j]
        return best, found, session


class GreedyDedup(StatefulProcessor):
    """Drops a record whose nearest stored record of its user and kind is near and in scope."""

    def __init__(self, threshold: float = 0.95, session_scope: bool = True):
        self.threshold, self.session_scope = threshold, session_scope

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getListState("stored", "id bigint, ts string, vec binary")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        """Rows are compared in blocks with all that is stored, then walked in order within their block."""
        kept, out = _Stored(list(self.stored.get())), []
        new = pd.concat(list(rows)).sort_values("id")
        for at in range(0, len(new), BLOCK):
            b = new.iloc[at : at + BLOCK]
            ids, ts, vec = b["id"].tolist(), b["ts"].tolist(), b["vec"].tolist()
            raw = np.frombuffer(b"".join(vec), dtype="<f4").reshape(len(b), -1)
            x = _unit(raw)
            cosine, neighbour, session = kept.nearest(x, self.threshold)
            inner = np.nan_to_num(np.round(x @ x.T, 6), nan=-2.0)
            inner[np.triu_indices(len(b))] = -2.0  # to earlier rows only
            close = inner.max(axis=1) >= self.threshold
            stays: list[int] = []
            for k in range(len(b)):
                c, other, t = cosine[k], neighbour[k], session[k]
                if close[k] and stays:
                    near = inner[k, stays]
                    j = stays[int(near.argmax())]
                    if inner[k, j] >= self.threshold and (other is None or (-inner[k, j], ids[j]) < (-c, other)):
                        c, other, t = inner[k, j], ids[j], ts[j]
                if other is not None and (t == ts[k] or not self.session_scope):
                    out.append((ids[k], other, float(c)))
                else:
                    stays.append(k)
            if stays:
                self.stored.appendList([(ids[k], ts[k], bytes(vec[k])) for k in stays])
                kept.add([ids[k] for k in stays], [ts[k] for k in stays], raw[stays])
        yield pd.DataFrame(out, columns=["id", "neighbour", "cosine"]).astype({"id": "int64", "neighbour": "int64", "cosine": "float64"})

    def close(self) -> None:
        pass


def packed_records(memories: DataFrame, dim: int = 64) -> DataFrame:
    """``user_id, kind, id, ts, vec`` of records with a usable vector."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype="<f4").tobytes() for v in s], dtype=object)

    fine = memories.where((F.size("embedding") == dim) & F.exists("embedding", lambda e: e != 0))
    return fine.select(F.coalesce("user_id", F.lit("")).alias("user_id"), "kind", "id", F.coalesce("created_at", F.lit("")).alias("ts"), F.pandas_udf(run, "binary")(F.col("embedding")).alias("vec"))


def stream_dedup(records: DataFrame, threshold: float = 0.95, session_scope: bool = True) -> DataFrame:
    """``id, neighbour, cosine`` of dropped records, from a stream of :func:`packed_records`.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    out = StructType.fromDDL("id bigint, neighbour bigint, cosine double")
    return records.groupBy("user_id", "kind").transformWithStateInPandas(GreedyDedup(threshold, session_scope), out, "Append", "None")


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Write what is there now to Parquet and stop."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
