"""History of changing attributes, kept from snapshots by Merkle comparison.

A snapshot is a frame of records. Every record has a hash; the hashes of the
records of one key bucket (leaf) are summed, the sums of sixteen leaves make
their parent's hash, and so on up to the root. Two snapshots are compared from
the root down: only children of differing nodes are looked at, and only keys
of differing leaves are diffed. Their versions are computed anew, and what is
new against the versions they had is appended to a log of additions and
withdrawals; nothing that was written is written again. The history is what
the log adds and does not withdraw.

Hashes of 64 bits are summed as DECIMALs, which commutes, so that a node's
hash needs no order, combines map-side and stands a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialize, once, scratch_path

FANOUT_BITS = 4

#: Blanks that Python's ``str.strip`` would also remove.
_BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f\u0085]"


def squeeze(c: Column) -> Column:
    """Lower case, blanks trimmed and collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), f"{_BLANK}+", " "))


def pair_key_of(c: Column) -> Column:
    """``subject|predicate`` in lower case without blanks around either half."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), rf"{_BLANK}*\|{_BLANK}*", "|"), rf"^{_BLANK}+|{_BLANK}+$", "")


def start_of(valid_time: Column, created_at: Column) -> Column:
    """First day of a real year, month or day, else the date in ``created_at``."""
    v = F.trim(valid_time)
    full = F.when(v.rlike(r"^\d{4}$"), F.concat(v, F.lit("-01-01"))).when(v.rlike(r"^\d{4}-\d{2}$"), F.concat(v, F.lit("-01"))).when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v)
    said = F.when(~full.startswith("0000"), F.try_to_date(full, "yyyy-MM-dd"))
    seen = F.regexp_extract(created_at, r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", 0)
    return F.coalesce(said, F.try_to_date(F.regexp_replace(seen, "/", "-"), "yyyy-M-d"))


# --- Merkle tree -------------------------------------------------------------


def _leaf(keys: list[str], leaf_bits: int) -> Column:
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]), F.lit(1 << leaf_bits))


def merkle_leaves(df: DataFrame, keys: list[str], leaf_bits: int = 16) -> DataFrame:
    """``leaf, h, n``: hash and number of records of each key bucket."""
    row = F.struct(*[F.col(c) for c in sorted(df.columns)])
    rows = df.select(_leaf(keys, leaf_bits).alias("leaf"), F.xxhash64(F.to_json(row, {"ignoreNullFields": "false"})).cast("decimal(20,0)").alias("h"))
    return rows.groupBy("leaf").agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))


def _level(leaves: DataFrame, shift: int) -> DataFrame:
    """Nodes ``shift`` bits above the leaves."""
    return leaves.groupBy(F.shiftright("leaf", shift).alias("node")).agg(F.sum((F.xxhash64("leaf", "h", "n")).cast("decimal(20,0)")).alias("h"))


def differing_leaves(old: DataFrame, new: DataFrame, leaf_bits: int = 16) -> DataFrame:
    """Leaves whose records differ, found by descending differing nodes only.

    Both inputs are outputs of :func:`merkle_leaves`. A leaf present on one
    side only differs. Two empty trees have no differing leaf.
    """
    live: DataFrame | None = None
    for shift in range(leaf_bits - FANOUT_BITS, 0, -FANOUT_BITS):
        if live is None:
            a, b = old, new
        else:
            up = live.select(F.col("node").alias("__up"))
            on = F.shiftright("leaf", shift + FANOUT_BITS) == F.col("__up")
            a, b = old.join(up, on, "left_semi"), new.join(up, on, "left_semi")
        x, y = _level(a, shift).withColumnRenamed("h", "h_old"), _level(b, shift).withColumnRenamed("h", "h_new")
        live = x.join(y, "node", "full_outer").where(~F.col("h_old").eqNullSafe(F.col("h_new"))).select("node")
    if live is not None:
        on = F.shiftright("leaf", FANOUT_BITS) == F.col("node")
        old, new = old.join(live, on, "left_semi"), new.join(live, on, "left_semi")
    x = old.select("leaf", F.struct("h", "n").alias("x"))
    y = new.select("leaf", F.struct("h", "n").alias("y"))
    return x.join(y, "leaf", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("leaf")


# --- versions ----------------------------------------------------------------


def fact_records(memories: DataFrame) -> DataFrame:
    """``user_id, key, value, start, id, supersedes, live`` of usable records.

    Records without a ``pair_key``, with a blank ``object`` or without any date
    take no part; a record delivered more than once counts once; a null
    ``user_id`` is a user of its own; a null ``salience`` counts as not 0.
    """
    cols = ["id", "user_id", "pair_key", "object", "valid_time", "created_at", "supersedes", "salience"]
    rows = memories.select(*cols).where(F.col("pair_key").isNotNull() & (squeeze(F.col("object")) != ""))
    rows = once(rows, "id")
    return rows.select(
        "user_id",
        pair_key_of(F.col("pair_key")).alias("key"),
        squeeze(F.col("object")).alias("value"),
        start_of(F.col("valid_time"), F.col("created_at")).alias("start"),
        "id",
        "supersedes",
        (~F.col("salience").eqNullSafe(F.lit(0.0))).alias("live"),
    ).where(F.col("start").isNotNull())


def winners(records: DataFrame) -> DataFrame:
    """The one record of each user, key and start that stands.

    Superseded records drop out by an equi-join on key *and* id, which a hot
    key does not gather in one task; the rest is one aggregate with map-side
    combine, after which a key has at most one row for each day.
    """
    named = records.where("supersedes IS NOT NULL AND supersedes <> id").select(
        F.col("user_id").alias("u"), F.col("key").alias("k"), F.col("start").alias("s"), F.col("supersedes").alias("i")
    )
    on = records.user_id.eqNullSafe(named.u) & (records.key == named.k) & (records.start == named.s) & (records.id == named.i)
    left = records.join(named, on, "left_anti")
    best = left.groupBy("user_id", "key", "start").agg(F.max(F.struct("live", "id", "value")).alias("w"))
    return best.select("user_id", "key", "start", "w.id", "w.value")


def versions(records: DataFrame) -> DataFrame:
    """``user_id, key, id, value, valid_from, valid_to`` from :func:`fact_records`.

    A record whose value equals the one before it joins its version. Two
    records that name each other in ``supersedes`` on one day both drop out.
    """
    w = Window.partitionBy("user_id", "key").orderBy("start")
    runs = winners(records).withColumn("before", F.lag("value").over(w)).where("before IS NULL OR before <> value")
    return runs.select(
        "user_id", "key", "id", "value",
        F.date_format("start", "yyyy-MM-dd").alias("valid_from"),
        F.coalesce(F.date_format(F.lead("start").over(w), "yyyy-MM-dd"), F.lit("")).alias("valid_to"),
    )


_VERSION = ["user_id", "key", "id", "value", "valid_from", "valid_to"]
#: Keys that a leaf holds at most, about, when the tree is laid out.
LEAF_KEYS = 16


class MerkleHistory:
    """A version history kept up to date from one snapshot to the next.

    ``leaf_bits`` is the depth of the tree; by default it follows the number of
    keys of the first snapshot, so that leaves stay small.
    """

    KEYS = ["user_id", "key"]

    def __init__(self, leaf_bits: int | None = None):
        if leaf_bits is not None and (leaf_bits % FANOUT_BITS or not FANOUT_BITS <= leaf_bits <= 32):
            raise ValueError("leaf_bits must be a multiple of 4 from 4 to 32")
        self.leaf_bits = leaf_bits
        self.leaves: DataFrame | None = None
        self.log: list[str] = []

    def _lay_out(self, snapshot: DataFrame) -> int:
        keys = snapshot.agg(F.approx_count_distinct(F.xxhash64(*self.KEYS))).first()[0]
        wanted = max(1, keys // LEAF_KEYS).bit_length()
        return min(32, max(FANOUT_BITS, -(-wanted // FANOUT_BITS) * FANOUT_BITS))

    def _logged(self) -> DataFrame:
        """All parts of the log by one reading, however many there are."""
        return self.spark.read.schema("user_id string, key string, id bigint, value string, valid_from string, valid_to string, leaf bigint, change int").parquet(*self.log)

    @staticmethod
    def _standing(log: DataFrame) -> DataFrame:
        """What a log adds and does not withdraw."""
        return log.groupBy(*_VERSION, "leaf").agg(F.sum("change").alias("change")).where("change > 0").select(*_VERSION, "leaf")

    def table(self) -> DataFrame:
        """The history: ``user_id, key, id, value, valid_from, valid_to``."""
        return self._standing(self._logged()).select(*_VERSION)

    def apply(self, snapshot: DataFrame, as_of: str | None = None) -> DataFrame:
        """Bring the history up to a whole snapshot of :func:`fact_records`.

        Returns the history. The last version of a key that left the snapshot
        ends at ``as_of``, by default the latest start in the snapshot; a key
        that comes back has the versions of its records. Nothing is computed
        or written for keys in equal leaves.
        """
        self.spark = snapshot.sparkSession
        self.leaf_bits = self.leaf_bits or self._lay_out(snapshot)
        mark = lambda d: d.withColumn("leaf", _leaf(self.KEYS, self.leaf_bits))
        leaves = materialize(merkle_leaves(snapshot, self.KEYS, self.leaf_bits), "leaves")
        if self.leaves is None:
            changes = mark(versions(snapshot)).select(*_VERSION, "leaf", F.lit(1).alias("change"))
        else:
            diff = materialize(differing_leaves(self.leaves, leaves, self.leaf_bits), "diff")
            changed = mark(snapshot).join(diff, "leaf", "left_semi")
            fresh = mark(versions(changed.drop("leaf")))
            old = self._standing(self._logged().join(diff, "leaf", "left_semi"))
            here = changed.select(F.xxhash64(*self.KEYS).alias("here")).distinct()
            day = F.lit(as_of) if as_of else F.lit(snapshot.agg(F.date_format(F.max("start"), "yyyy-MM-dd")).first()[0])
            gone = old.join(here, F.xxhash64(*self.KEYS) == F.col("here"), "left_anti")
            closed = gone.withColumn("valid_to", F.when(F.col("valid_to") == "", F.coalesce(day, F.lit(""))).otherwise(F.col("valid_to")))
            now = fresh.unionByName(closed).withColumn("change", F.lit(1))
            changes = now.unionByName(old.withColumn("change", F.lit(-1))).groupBy(*_VERSION, "leaf").agg(F.sum("change").cast("int").alias("change")).where("change <> 0")
        self.log.append(scratch_path(self.spark, "changes"))
        changes.write.parquet(self.log[-1])
        self.leaves = leaves
        return self.table()


def attribute_history(memories: DataFrame, snapshots: int = 3, leaf_bits: int | None = None) -> DataFrame:
    """The history after loading ``memories`` as successive snapshots.

    Snapshot *k* holds the records whose id lies in the first *k* of
    ``snapshots`` equal parts of the id range, as ids run in order of arrival.
    """
    records = materialize(fact_records(memories), "facts")
    low, high = records.agg(F.min("id"), F.max("id")).first()
    history = MerkleHistory(leaf_bits)
    if low is None:
        return history.apply(records)
    for k in range(1, snapshots + 1):
        history.apply(records.where(F.col("id") <= low + (high - low) * k // snapshots))
    return history.table()
