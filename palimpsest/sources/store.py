"""A store of records as versioned Parquet tables with guard rows.

A version is a folder that is written once; readers see the version that the
newest marker names. Updates are copy-on-write. One writer per store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.extractors import rule_digests
from palimpsest.operators.conflict import apply_updates
from palimpsest.sources.schema import KINDS, LEDGER, MEMORIES, META, REGISTRY, Config


class GuardError(ValueError):
    """A store was opened under other rules than it was written with."""


def guard_differences(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """``key, expected, stored`` of guard rows that differ or are missing on a side."""
    e, s = expected.select("key", F.col("value").alias("expected")), stored.select("key", F.col("value").alias("stored"))
    return e.join(s, "key", "full_outer").where(~F.col("expected").eqNullSafe(F.col("stored")))


def validated(records: DataFrame) -> DataFrame:
    """Records fit to insert: defaults filled in; a null timestamp, an unknown kind or a salience out of range is an error."""

    def checked(c: str, holds: Column, why: str) -> Column:
        kind = dict(records.dtypes)[c]
        return F.when(F.coalesce(holds, F.lit(False)), F.col(c)).otherwise(F.raise_error(F.lit(f"{c}: {why}")).cast(kind)).alias(c)

    tests = {
        "created_at": (F.col("created_at").isNotNull(), "missing"),
        "kind": (F.col("kind").isin(*KINDS), "unknown"),
        "salience": (F.col("salience").between(0, 1), "not in [0, 1]"),
    }
    filled = {"initial_salience": F.coalesce("initial_salience", "salience"), "last_accessed": F.coalesce("last_accessed", "created_at")}
    return records.select(*[checked(c, *tests[c]) if c in tests else filled[c].alias(c) if c in filled else F.col(c) for c in records.columns])


def annotated(predictions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Predictions with a verdict more where there is one; those before it stay, other rows are unchanged."""
    new = verdicts.select("run_id", "question_id", F.struct("correct", "judge_hash", "graded_utc").alias("__v"))
    kind = dict(predictions.dtypes)["verdicts"]
    more = F.when(F.col("__v").isNull(), F.col("verdicts")).otherwise(F.array_append(F.coalesce("verdicts", F.array().cast(kind)), F.col("__v")))
    return predictions.join(new, ["run_id", "question_id"], "left").withColumn("verdicts", more).select(*predictions.columns)


def cache_misses(wanted: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the cache does not hold; a cached false or empty value is held."""
    return wanted.join(cache.select(*key), key, "left_anti")


def cached(wanted: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    return wanted.join(cache, key)


def registry_merge(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Registry rows with new states. Only the status may change, and a score that is still pending."""
    u = updates.select("run_id", F.col("status").alias("__status"), F.col("score").alias("__score"))
    j = registry.join(u, "run_id", "left")
    free = (F.col("score") == "pending") | F.col("__score").isNull() | F.col("__score").eqNullSafe(F.col("score"))
    score = F.when(free, F.coalesce("__score", "score")).otherwise(F.raise_error(F.concat(F.lit("score is final: "), "run_id")).cast("string"))
    return j.withColumns({"score": score, "status": F.coalesce("__status", "status")}).select(*registry.columns)


def parsed_label(c: Column) -> Column:
    """yes/y and no/n in any case as a boolean, blank as null; anything else is an error."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("yes", "y"), True).when(t.isin("no", "n"), False).when(F.coalesce(t, F.lit("")) == "", None).otherwise(F.raise_error(F.concat(F.lit("no label: "), c)).cast("boolean"))


class Store:
    """Records, guard rows and logs below one folder."""

    def __init__(self, spark: SparkSession, path: str, config: Config = Config()):
        """Open a store, or create it. Other guard rows than those stored are refused."""
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        expected = spark.createDataFrame([*config.guard_rows(), *rule_digests().items()], META)
        if self._exists("meta"):
            wrong = guard_differences(expected, spark.read.schema(META).parquet(f"{self.path}/meta")).limit(20).collect()
            if wrong:
                raise GuardError("; ".join(f"{r['key']}: {r['stored']} stored, {r['expected']} expected" for r in wrong))
        else:
            expected.write.parquet(f"{self.path}/meta")

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def versions(self) -> list[int]:
        if not self._exists("memories"):
            return []
        names = [str(x.getPath().getName()) for x in self._fs.listStatus(self._at("memories"))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and self._exists(f"memories/{n}/_SUCCESS"))

    def read(self, version: int | None = None) -> DataFrame:
        """The records of a version, the newest by default; an empty store has no rows."""
        seen = self.versions()
        if not seen:
            return self.spark.createDataFrame([], MEMORIES)
        return self.spark.read.schema(MEMORIES).parquet(f"{self.path}/memories/v{version or seen[-1]}")

    def _write(self, records: DataFrame) -> int:
        """A new version; what a failed write left under its number, which no reader sees, is replaced."""
        n = (self.versions() or [0])[-1] + 1
        records.write.partitionBy("kind").mode("overwrite").parquet(f"{self.path}/memories/v{n}")
        return n

    def insert(self, records: DataFrame) -> int:
        """Append validated records as a new version."""
        return self._write(self.read().unionByName(validated(records).select(*self.read().columns)))

    def update(self, updates: DataFrame, columns: list[str]) -> int:
        """Write changed values of some columns by id as a new version."""
        return self._write(apply_updates(self.read(), updates, columns))

    def append(self, log: str, rows: DataFrame) -> None:
        """Lines to an append-only log: ``ledger`` or ``registry``."""
        schema = {"ledger": LEDGER, "registry": REGISTRY}[log]
        names = [c.split(" ")[0] for c in schema.split(", ")]
        rows.select(*names).write.mode("append").parquet(f"{self.path}/{log}")

    def log(self, log: str) -> DataFrame:
        schema = {"ledger": LEDGER, "registry": REGISTRY}[log]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{log}") if self._exists(log) else self.spark.createDataFrame([], schema)
