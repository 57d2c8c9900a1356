"""New batches checked against everything accepted so far, without redoing it.

The state is persisted: digests of normalized content in parts by scope (a user
and kind), vectors in posting lists (``vectors``) in buckets, and a forest of
representatives. Equal stored vectors of a scope are one row. A batch names the
parts, buckets and lists that it probes; the other parts and buckets are not
read, and of those read only rows of probed lists leave the scan. The batch
links its own rows in the same way and is then walked in order: the walk
touches only rows that share content, vector or a link with an earlier row of
the batch. Accepted rows are appended to the tables, decisions are written
batch by batch, so that no plan grows with their number.

The decision of a screen is the exact rule. All compared pairs of some
likeness are counted by the agreement of their fields (band of the cosine, same
day, like length); from these counts the weights of a Fellegi-Sunter model are
learned by expectation maximization. Links of positive weight, and equal
contents, join clusters: a union-find over the roots of the touched clusters
only, whose result is appended to the forest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.vectors import Codebook, fit_codebook, pack, unpack
from palimpsest.operators.history import _BLANK
from palimpsest.session import bounded, drop_scratch, materialize, once, scratch_path

LIST_ROWS, BLOCK = 800, 4096
#: Lists in which a row of the history stands, and that a new row probes: up to so many, each at most so much farther than the nearest.
STORE, PROBE = (1, 1.0), (6, 1.25)
#: Rows of one scope that one task walks; scopes with more are resolved in rounds over frames.
WALK_ROWS = 200_000
#: Links of one batch whose components one task finds; more are found in rounds over frames.
UNION_ROWS = 200_000
#: Rows of a frame that is broadcast, at most.
SMALL_ROWS = 500_000
#: Steps from a node to its root at which the forest is written anew.
DEEPEST = 4
#: Rows of a bucket of the stored vectors, groups within it, and parts of the digests at least.
BUCKET_ROWS, GROUPS, PARTS = 100_000, 4, 16
#: Arrivals and memories have one numbering: arrivals begin here. Ids lie within half of it on both sides of 0.
ARRIVALS = 1 << 62
#: Stands for no record where frames go to Python, which would read whole numbers beside nulls as floats.
NONE = -(1 << 62)


def content_key(c: Column) -> Column:
    """Lower case; letters, digits, underscores and white space; collapsed. Null if blank."""
    kept = F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}}_{_BLANK[1:-1]}]", "")
    return F.nullif(F.trim(F.regexp_replace(kept, f"{_BLANK}+", " ")), F.lit(""))


def record_name(rec: Column) -> Column:
    """``m:`` or ``a:`` and the id."""
    return F.when(rec >= ARRIVALS // 2, F.concat(F.lit("a:"), rec - F.lit(ARRIVALS))).otherwise(F.concat(F.lit("m:"), rec))


def _records(rows: DataFrame, id_col: str, first: int, dim: int) -> DataFrame:
    """``id, rec, scope, part, kh, day, chars, vec``: what the linkage needs of a record. vec is empty if not usable."""
    scope = F.concat_ws("\u0001", F.coalesce("user_id", F.lit("\u0000")), F.coalesce("kind", F.lit("\u0000")))
    key = content_key(F.col("content"))
    return rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        (F.col(id_col) + F.lit(first)).alias("rec"),
        scope.alias("scope"),
        F.when(key.isNotNull(), F.unhex(F.md5(F.concat(scope, F.lit("\u0002"), key)))).alias("kh"),
        F.substring(F.regexp_replace("created_at", "/", "-"), 1, 10).alias("day"),
        F.coalesce(F.length("content"), F.lit(0)).alias("chars"),
        pack(F.col("embedding"), dim).alias("vec"),
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A frame of a known number of rows, to be broadcast while that is small."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


# --- weights of agreement ----------------------------------------------------

#: Lower ends of the bands of cosine; pairs below the first are not counted.
BANDS = (0.8, 0.9, 0.95, 0.97, 0.99, 0.999)
PATTERNS = len(BANDS) * 4
#: Agreement of all fields.
FULL = PATTERNS - 1


def pattern(cosine: np.ndarray, same_day: np.ndarray, like_length: np.ndarray) -> np.ndarray:
    """Number of the agreement of fields: band of the cosine, same day, like length."""
    return (np.searchsorted(BANDS, cosine, "right") - 1) * 4 + same_day.astype(int) * 2 + like_length.astype(int)


def learn_weights(counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Log-odds of each pattern: of its fields' agreement among matches against that among the rest.

    Counts of patterns are split between matches and others by expectation
    maximization from a mild start, with one pair added to each value, so that
    no pairs at all give the start's weights.
    """
    code = np.arange(PATTERNS)
    fields = [code // 4, code // 2 % 2, code % 2]
    m = [np.array([1, 2, 8, 16, 24, 48]) / 99, np.array([0.4, 0.6]), np.array([0.3, 0.7])]
    u = [m[0][::-1], np.array([0.8, 0.2]), np.array([0.6, 0.4])]
    share = 0.2
    for _ in range(rounds if counts.sum() else 0):
        a = share * np.prod([t[f] for t, f in zip(m, fields)], axis=0)
        b = (1 - share) * np.prod([t[f] for t, f in zip(u, fields)], axis=0)
        match = counts * a / (a + b)
        rest = counts - match
        share = min(0.99, max(0.01, match.sum() / counts.sum()))
        m, u = ([(np.bincount(f, weights=w, minlength=len(t)) + 1) / (w.sum() + len(t)) for f, t in zip(fields, m)] for w in (match, rest))
    return np.sum([np.log(x[f] / y[f]) for x, y, f in zip(m, u, fields)], axis=0)


class _Forest:
    """Union-find of one task, for edges that join something."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x, y) -> bool:
        a, b = self.find(x), self.find(y)
        self.up[max(a, b)] = min(a, b)
        return a != b


def components(edges: DataFrame, few: bool) -> DataFrame:
    """``node, root``: the smallest node of each component of ``x, y``, which are whole numbers.

    Few edges are one task's union-find. More are contracted
    in rounds: every edge is hung on the smallest neighbour of its end, larger
    ends first, then smaller ones, until nothing changes. No round gathers a
    node's neighbours.
    """
    some = edges.where("x <> y").distinct()
    if few:

        def run(e: pd.DataFrame) -> pd.DataFrame:
            forest = _Forest()
            for x, y in zip(e["x"].tolist(), e["y"].tolist()):
                forest.join(x, y)
            nodes = list(forest.up)
            return pd.DataFrame({"node": nodes, "root": [forest.find(n) for n in nodes]})

        return some.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "node bigint, root bigint")
    digest = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first())
    star = materialize(some.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "star")
    was = digest(star)
    while True:
        both = star.unionByName(star.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y")))
        old, star = star, materialize(small.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), "star")
        now = digest(star)
        drop_scratch(old)
        if now == was:
            return star.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(star.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
        was = now


def fallen_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, up``: the roots that ``edges`` join to smaller ones; roots: ``node, root`` of all nodes of the edges.

    One task's union-find over both frames, so that neither is joined to the
    other. A root is the smallest node of its cluster.
    """

    def run(e: pd.DataFrame) -> pd.DataFrame:
        forest = _Forest()
        for x, y in zip(e["x"].tolist(), e["y"].tolist()):
            forest.join(x, y)
        tops = e.loc[e["top"], "y"].unique().tolist()
        up = [forest.find(t) for t in tops]
        fell = [k for k, t in enumerate(tops) if up[k] != t]
        return pd.DataFrame({"root": [tops[k] for k in fell], "up": [up[k] for k in fell]})

    both = edges.select("x", "y", F.lit(False).alias("top")).unionByName(roots.select(F.col("node").alias("x"), F.col("root").alias("y"), F.lit(True).alias("top")))
    return both.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "root bigint, up bigint")


class IncrementalLinkage:
    """The state of one linkage; a context that drops it at its end."""

    def __init__(self, spark: SparkSession, threshold: float = 0.95, dim: int = 64):
        if threshold < BANDS[0]:
            raise ValueError(f"a threshold below {BANDS[0]} is not counted")
        self.spark, self.threshold, self.dim = spark, threshold, dim
        self.at = scratch_path(spark, "linkage")
        self.table = f"linkage_{uuid.uuid4().hex}"
        self.counts = np.zeros(PATTERNS)
        self.batch = 0
        self.forest, self.depth = f"{self.at}/forest", 0
        # Clusters of a batch are joined while the next one is decided, batch after batch.
        self.joiner, self.joins = ThreadPoolExecutor(1), []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    # --- state ---------------------------------------------------------------

    def bootstrap(self, memories: DataFrame) -> None:
        """Store the history: digests, lists, and clusters of equal contents and equal vectors. Rows of one id and content count once."""
        rows = _records(memories.select("id", "user_id", "kind", "content", "created_at", "embedding"), "id", 0, self.dim)
        rows = materialize(rows, "history")
        self.parts = max(PARTS, -(-rows.count() // BUCKET_ROWS))
        self._append_keys(rows)
        first, many = F.min(F.struct("rec", "day", "chars")).alias("f"), (F.min("rec") < F.max("rec")).alias("many")
        distinct = rows.where(F.octet_length("vec") > 0).groupBy("scope", "vec").agg(first, many).select("scope", "vec", "f.*", "many")
        distinct = materialize(distinct, "distinct")
        sizes = distinct.groupBy("scope").agg(F.count(F.lit(1)).alias("rows"))
        total, largest = sizes.agg(F.sum("rows"), F.max("rows")).first()
        self.book = self.spark.sparkContext.broadcast(fit_codebook(distinct, self.dim, total or 1, largest or 1, LIST_ROWS))
        self.large = bounded(materialize(sizes.where(F.col("rows") > LIST_ROWS), "large"))
        self.buckets = max(self.spark.sparkContext.defaultParallelism, -(-(total or 0) // BUCKET_ROWS))
        listed = self._lists(distinct.drop("many"), *STORE)
        self.over = None
        if (largest or 0) > LIST_ROWS:
            listed = materialize(listed, "listed")
            over = listed.groupBy("scope", F.col("lists")[0].alias("list")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 4 * BLOCK)
            over = materialize(over.select("scope", "list", F.ceil(F.col("size") / (2 * BLOCK)).cast("int").alias("blocks")), "over")
            self.over = bounded(over) if over.limit(1).count() else None
        self._append_vectors(listed)
        # Copies hang on the first of their content and of their vector.
        texts = rows.where("kh IS NOT NULL").groupBy("kh").agg(F.min("rec").alias("y"), many).where("many").select("kh", "y")
        equal = rows.join(bounded(texts), "kh").select(F.col("rec").alias("x"), "y")
        twins = distinct.where("many").select("scope", F.md5("vec").alias("vd"), F.col("rec").alias("y"))
        near = rows.where(F.octet_length("vec") > 0).withColumn("vd", F.md5("vec")).join(bounded(twins), ["scope", "vd"]).select(F.col("rec").alias("x"), "y")
        self._unite(materialize(equal.unionByName(near).where("x <> y"), "copies"))
        drop_scratch(rows)

    def _append_keys(self, rows: DataFrame) -> None:
        """Digests of contents, one row a content, in parts by scope."""
        part = F.pmod(F.xxhash64("scope"), F.lit(self.parts)).cast("int").alias("part")
        keys = rows.drop("part").where("kh IS NOT NULL").select(part, "kh", "rec")
        keys = keys if self.batch else keys.groupBy("part", "kh").agg(F.min("rec").alias("rec"))  # what a batch accepts has no copies
        keys.repartition("part").sortWithinPartitions("part", "kh").write.partitionBy("part").mode("append").parquet(f"{self.at}/keys")

    def _append_vectors(self, listed: DataFrame) -> None:
        """Rows of the lists into their buckets; each row stands in one block of its own list."""
        rows = self._blocked(listed.withColumn("lists", F.slice("lists", 1, 1)), as_query=False).select("bucket", "lk", "rec", "day", "chars", "vec").repartition(self.buckets, "bucket")
        how = rows.write.format("parquet").option("path", f"{self.at}/vectors").bucketBy(self.buckets, "bucket").sortBy("bucket")
        how.mode("append").saveAsTable(self.table)

    def _lists(self, rows: DataFrame, most: int, ratio: float) -> DataFrame:
        """Adds ``lists``: the lists of each row, nearest first, in the level of its scope; none for an empty vector."""
        book, names = self.book, [f.name for f in rows.schema]
        sized = rows.join(self.large, "scope", "left").select(*names, F.coalesce("rows", F.lit(1)).alias("rows"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b: Codebook = book.value
            for batch in batches:
                lists: list[list[int]] = [[] for _ in range(len(batch))]
                full = np.flatnonzero(batch["vec"].map(len).to_numpy() > 0)
                if len(full):
                    r, own, rank = b.lists(unpack(batch["vec"].iloc[full], b.dim), b.level_of(batch["rows"].to_numpy()[full]), most, ratio)
                    for k in np.lexsort((rank, r)):
                        lists[full[r[k]]].append(int(own[k]))
                yield batch[names].assign(lists=lists)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return sized.mapInPandas(run, f"{schema}, lists array<int>")

    def _blocked(self, listed: DataFrame, as_query: bool) -> DataFrame:
        """A row for each list: adds ``lk, bucket, own``. As data a row stands in one block of its list, as a query in each."""
        rows = listed.select("*", F.posexplode("lists").alias("rank", "list")).drop("lists")
        if self.over is None:
            rows = rows.withColumn("block", F.lit(0)).withColumn("own", F.col("rank") == 0)
        else:
            rows = rows.join(self.over, ["scope", "list"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            held = F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")
            rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if as_query else held)
            rows = rows.withColumn("own", (F.col("rank") == 0) & (F.col("block") == held))
        rows = rows.withColumn("lk", F.xxhash64("scope", "list", "block"))
        return rows.withColumn("bucket", F.pmod("lk", F.lit(self.buckets * GROUPS)).cast("int"))

    # --- a batch -------------------------------------------------------------

    def process(self, batch: DataFrame) -> DataFrame:
        """Decide one batch and take what it accepts into the state.

        Returns ``id, screen, neighbour, cosine, weight``: screen is null for
        accepted rows; neighbour is the record that a row was dropped for (the
        nearest, of equally near ones that with more agreement, then the first)
        and weight that of the agreement with it. Blank content never is equal
        to anything, unusable vectors are near nothing, null users and kinds
        are values of their own, an empty batch gives no rows.
        """
        self.batch += 1
        part = F.pmod(F.xxhash64("scope"), F.lit(self.parts)).cast("int")
        rows = materialize(self._lists(_records(batch, "arrival_id", ARRIVALS, self.dim), *PROBE).withColumn("part", part), "batch")
        parts, scopes, count = rows.agg(F.collect_set("part"), F.approx_count_distinct("scope"), F.count(F.lit(1))).first()
        links = self._links(rows, scopes, count)
        self._count(links)
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in self.weights]), F.col("pat") + 1)
        at = f"{self.at}/decisions/{self.batch}"
        walked = self._walk(rows, self._same(rows, parts, count), links, count).withColumn("weight", F.when(F.col("screen") == "cosine", F.round(weight, 6)))
        walked.drop("pat").write.parquet(at)
        decided = self.spark.read.schema(walked.drop("pat").schema).parquet(at)
        accepted = rows.join(_small(decided.where("screen IS NULL").select("id"), count), "id", "left_semi")
        edges = self._edges(links, decided)

        def join():
            written = materialize(edges, "edges")
            self._unite(written)
            drop_scratch(written)
            drop_scratch(links)

        self.joins.append(self.joiner.submit(join))
        with ThreadPoolExecutor(1) as other:
            keys = other.submit(self._append_keys, accepted)
            self._append_vectors(accepted.where(F.octet_length("vec") > 0).select("scope", "rec", "day", "chars", "vec", "lists"))
            keys.result()
        drop_scratch(rows)
        return decided

    def _same(self, rows: DataFrame, parts: list[int], count: int) -> DataFrame:
        """``id, scope, same``: the stored record of equal content, of rows that have one; only the parts of the batch's scopes are read."""
        stored = self.spark.read.schema("kh binary, rec bigint, part int").parquet(f"{self.at}/keys").where(F.col("part").isin(parts))
        return stored.select("kh", F.col("rec").alias("same")).join(_small(rows.where("kh IS NOT NULL").select("kh", "id", "scope"), count), "kh").select("id", "scope", "same")

    def _links(self, rows: DataFrame, scopes: int, count: int) -> DataFrame:
        """``src, a, b, c, pat, scope`` of the distinct vectors of the batch.

        H: the nearest stored record of a vector in a list; B: an earlier
        vector of the batch; E: edges that keep together what links of one
        pattern join within a list; P: how many pairs have pattern a.
        """
        dim, least = self.dim, self.threshold
        first = F.min(F.struct("id", "day", "chars", "lists")).alias("f")
        distinct = rows.where(F.octet_length("vec") > 0).groupBy("scope", "vec").agg(first).select("scope", "vec", "f.*")
        new = self._blocked(distinct, as_query=True).select("bucket", "lk", "own", "id", "day", "chars", "vec", "scope")
        cols = ["src", "a", "b", "c", "pat", "scope"]

        def run(h: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            counts = np.zeros(PATTERNS, np.int64)
            x, blk, own, scope = unpack(b["vec"], dim), b["lk"].to_numpy(), b["own"].to_numpy(), b["scope"].to_numpy()
            code, day, chars = b["id"].to_numpy() + ARRIVALS, b["day"].to_numpy(), b["chars"].to_numpy()
            hx, hlk = (unpack(h["vec"], dim) if len(h) else np.empty((0, dim))), h["lk"].to_numpy()
            hcode, hday, hchars = h["rec"].to_numpy(), h["day"].to_numpy(), h["chars"].to_numpy()
            order, horder = np.lexsort((code, blk)), np.argsort(hlk, kind="stable")
            cuts = np.flatnonzero(np.r_[True, blk[order][1:] != blk[order][:-1], True])
            for s, e in zip(cuts[:-1], cuts[1:]):
                at = order[s:e]
                lo, hi = np.searchsorted(hlk[horder], blk[at[0]], "left"), np.searchsorted(hlk[horder], blk[at[0]], "right")
                forests: dict[int, _Forest] = {}
                sides = [("H", horder[lo:hi], hx, hcode, hday, hchars), ("B", at[own[at]], x, code, day, chars)]
                for k in range(0, len(at), 1024):
                    q = at[k : k + 1024]
                    for src, data, dx, dcode, dday, dchars in sides:
                        if not len(data):
                            continue
                        c = np.round(x[q] @ dx[data].T, 6)
                        r, j = np.nonzero(c >= BANDS[0])
                        if src == "B":
                            r, j = (v[dcode[data[j]] < code[q[r]]] for v in (r, j))
                        i, n, c = q[r], data[j], c[r, j]
                        long = np.maximum(chars[i], dchars[n])
                        pat = pattern(c, (day[i] == dday[n]) & pd.notna(day[i]), np.minimum(chars[i], dchars[n]) >= 0.8 * long)
                        counts += np.bincount(pat, minlength=PATTERNS)
                        hit = c >= least
                        i, n, c, pat = i[hit], n[hit], c[hit], pat[hit]
                        o = np.lexsort((dcode[n], -pat, -c, i))
                        i, n, c, pat = i[o], n[o], c[o], pat[o]
                        keep = np.r_[True, i[1:] != i[:-1]] if src == "H" and len(i) else np.ones(len(i), bool)
                        out += [(src, code[a] - ARRIVALS, dcode[m], v, p, scope[a]) for a, m, v, p in zip(i[keep], n[keep], c[keep], pat[keep])]
                        for a, m, v, p in zip(code[i].tolist(), dcode[n].tolist(), c, pat.tolist()):
                            if forests.setdefault(p, _Forest()).join(a, m):
                                out.append(("E", a - ARRIVALS, m, v, p, None))
            out += [("P", p, 0, float(n), 0, None) for p, n in enumerate(counts) if n]
            return pd.DataFrame(out, columns=cols)

        stored = self.spark.table(self.table)
        # Copies of a vector hurt nothing in what is broadcast, so that needs no grouping.
        probed = (self._blocked(rows.select("scope", "vec", "lists"), as_query=True) if count * PROBE[0] <= SMALL_ROWS else new).select("bucket", "lk")
        if scopes * PROBE[0] < self.buckets * GROUPS:  # a narrow batch leaves buckets untouched
            stored = stored.where(F.col("bucket").isin(probed.agg(F.collect_set("bucket")).first()[0]))
        stored = stored.join(_small(probed.select("lk"), count * PROBE[0]), "lk", "left_semi").select("bucket", "lk", "rec", "day", "chars", "vec")
        none = pd.DataFrame([], columns=cols)
        found = stored.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInPandas(lambda h, b: run(h, b) if len(b) else none, "src string, a bigint, b bigint, c double, pat int, scope string")
        return materialize(found, "links")

    def _count(self, links: DataFrame) -> None:
        """Add the batch's patterns to those counted so far, and learn the weights anew."""
        for r in links.where("src = 'P'").groupBy("a").agg(F.sum("c").alias("n")).collect():
            self.counts[r["a"]] += r["n"]
        self.weights = learn_weights(self.counts)

    def _walk(self, rows: DataFrame, same: DataFrame, links: DataFrame, count: int) -> DataFrame:
        """``id, screen, neighbour, cosine, pat, g`` by the walk in order of id, scope by scope.

        In a batch of more than ``WALK_ROWS`` only rows that are related to
        another row of the batch are walked, and scopes with as many of them
        are resolved in rounds.
        """
        rows = rows.select("id", "rec", "scope", "kh", F.when(F.octet_length("vec") > 0, F.md5("vec")).alias("vd"))
        if count <= WALK_ROWS:
            return walk_batch(rows, same, links)
        groups = rows.where("vd IS NOT NULL").groupBy("scope", "vd").agg(F.min("id").alias("g"))
        near = links.where("src = 'H'").groupBy(F.col("a").alias("g")).agg(F.max(F.struct("c", "pat", (-F.col("b")).alias("first"))).alias("n"))
        near = near.select("g", (-F.col("n.first")).alias("near"), F.col("n.c").alias("near_c"), F.col("n.pat").alias("near_pat"))
        # None of these has more rows than the batch.
        nodes = rows
        for side, on in ((groups, ["scope", "vd"]), (same.drop("scope"), ["id"]), (near, ["g"])):
            nodes = nodes.join(_small(side, count), on, "left")
        nodes = materialize(nodes.select("id", "rec", "scope", "kh", "g", "same", "near", "near_c", "near_pat"), "nodes")
        inner = links.where("src = 'B'").select(F.col("a").alias("g"), (F.col("b") - F.lit(ARRIVALS)).alias("h"), "c", "pat", "scope")
        shared = nodes.where("kh IS NOT NULL").groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kh", F.lit(True).alias("k_shared"))
        twin = nodes.where("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", F.lit(True).alias("g_shared"))
        linked = inner.select("g").unionByName(inner.select(F.col("h").alias("g"))).distinct().withColumn("linked", F.lit(True))
        marked = nodes.join(shared, "kh", "left").join(twin, "g", "left").join(linked, "g", "left")
        marked = marked.withColumn("related", F.coalesce("k_shared", "g_shared", "linked", F.lit(False))).select(*nodes.columns, "related")
        dropped = F.col("same").isNull() & F.col("near").isNotNull()
        alone = marked.where("NOT related").select(
            "id",
            F.when(F.col("same").isNotNull(), "exact").when(dropped, "cosine").alias("screen"),
            F.coalesce("same", "near").alias("neighbour"),
            F.when(dropped, F.col("near_c")).alias("cosine"),
            F.when(dropped, F.col("near_pat")).alias("pat"),
            "g",
        )
        related = marked.where("related").drop("related")
        sizes = related.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= WALK_ROWS:
            return alone.unionByName(walk_scopes(related, inner, max(32, count // 10_000)))
        huge = bounded(materialize(sizes.where(F.col("n") > WALK_ROWS).select("scope"), "huge"))
        small = walk_scopes(related.join(huge, "scope", "left_anti"), inner.join(huge, "scope", "left_anti"), max(32, count // 10_000))
        return alone.unionByName(small).unionByName(walk_rounds(related.join(huge, "scope", "left_semi"), inner.join(huge, "scope", "left_semi")))

    # --- clusters ------------------------------------------------------------

    def _edges(self, links: DataFrame, decided: DataFrame) -> DataFrame:
        """``x, y``: what belongs together by this batch: equal contents, equal vectors, links of positive weight."""
        good = [k for k, w in enumerate(self.weights) if w > 0]
        scored = links.where(F.col("src").eqNullSafe("E") & F.col("pat").isin(good)).select((F.col("a") + F.lit(ARRIVALS)).alias("x"), F.col("b").alias("y"))
        equal = decided.where("screen = 'exact'").select((F.col("id") + F.lit(ARRIVALS)).alias("x"), F.col("neighbour").alias("y"))
        twins = decided.where("g <> id").select((F.col("id") + F.lit(ARRIVALS)).alias("x"), (F.col("g") + F.lit(ARRIVALS)).alias("y"))
        return scored.unionByName(equal).unionByName(twins)

    def _forest(self) -> DataFrame:
        return self.spark.read.schema("node bigint, up bigint").parquet(self.forest)

    def _roots(self, nodes: DataFrame) -> DataFrame:
        """``node, root`` of some nodes, by as many steps up the forest as it is deep; a node outside is its own root."""
        out = nodes.select("node", F.col("node").alias("root"))
        for _ in range(self.depth):
            step = self._forest().select(F.col("node").alias("root"), "up")
            out = out.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        return out

    def _unite(self, edges: DataFrame) -> None:
        """Join the clusters that edges, a written frame, connect.

        Only roots of touched clusters take part in the union-find. A root that
        falls to another, and a node that is new, get one row in the forest;
        nothing else is written. Each joining makes the forest at most one step
        deeper; at ``DEEPEST`` it is written anew with every node at its root.
        """
        count = edges.count()
        if not count:
            return
        nodes = edges.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        roots = self._roots(_small(nodes, 2 * count))
        if self.depth and count <= UNION_ROWS:
            joined = fallen_roots(edges, roots)
        else:
            a, b = (_small(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), 2 * count) for c in "xy")
            found = edges.join(a, "x").join(b, "y").select(F.col("rx").alias("x"), F.col("ry").alias("y")) if self.depth else edges
            joined = components(found, count <= UNION_ROWS).select(F.col("node").alias("root"), F.col("root").alias("up"))
        # Every root that was joined gets its new root; so does a new node, which was its own root until now.
        joined.where("root <> up").select(F.col("root").alias("node"), "up").write.mode("append").parquet(self.forest)
        self.depth += 1
        if self.depth >= DEEPEST:
            all_ = self._roots(self._forest().select("node")).select("node", F.col("root").alias("up"))
            flat = f"{self.at}/forest-{uuid.uuid4().hex}"
            all_.write.parquet(flat)
            self.forest, self.depth = flat, 1

    def clusters(self, rows: DataFrame) -> DataFrame:
        """Adds ``cluster``, the name of the first record of each row's cluster; rows: with ``id`` of arrivals."""
        for done in self.joins:
            done.result()
        nodes = rows.withColumn("node", F.col("id") + F.lit(ARRIVALS))
        roots = self._roots(nodes.select("node")).select("node", record_name(F.col("root")).alias("cluster"))
        return nodes.join(roots, "node").drop("node")

    def close(self) -> None:
        """Drop the state of this run."""
        self.joiner.shutdown(cancel_futures=True)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        drop_scratch(self.at, self.spark)


# --- the walk ----------------------------------------------------------------

_DECIDED = "id bigint, screen string, neighbour bigint, cosine double, pat int, g bigint"


def _walked(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
    """The walk over rows in order of id; e: the links between them."""
    near: dict[int, list[tuple[int, float, int]]] = {}
    for g, h, c, p in zip(e["g"].tolist(), e["h"].tolist(), e["c"], e["pat"]):
        near.setdefault(g, []).append((h, c, p))
        near.setdefault(h, []).append((g, c, p))
    contents: dict[bytes, int] = {}
    taken: dict[int, int] = {}
    out = []
    for i, rec, kh, g, same, stored, c, p in zip(*(n[x].tolist() for x in ("id", "rec", "kh", "g", "same", "near", "near_c", "near_pat"))):
        kh = None if kh is None else bytes(kh)
        if same != NONE:
            out.append((i, "exact", same, None, None, g))
        elif kh is not None and kh in contents:
            out.append((i, "exact", contents[kh], None, None, g))
        else:
            options = [] if stored == NONE else [(c, int(p), -stored)]
            if g != NONE:
                options += [(1.0, FULL, -taken[g])] if g in taken else []
                options += [(x, y, -taken[h]) for h, x, y in near.get(g, ()) if h in taken]
            if options:
                c, p, rec = max(options)
                out.append((i, "cosine", -rec, c, p, g))
            else:
                out.append((i, None, None, None, None, g))
                if kh is not None:
                    contents[kh] = rec
                if g != NONE:
                    taken[g] = rec
    ids, screens, neighbours, cosines, pats, gs = zip(*out) if out else ((),) * 6
    return pd.DataFrame({"id": ids, "screen": screens, "neighbour": pd.array(neighbours, "Int64"), "cosine": cosines, "pat": pd.array(pats, "Int32"), "g": pd.array([None if g == NONE else g for g in gs], "Int64")})


def _scope_bucket(buckets: int) -> Column:
    """Scopes share a task's call in buckets, as contents and vectors of different scopes have different keys anyway."""
    return F.pmod(F.xxhash64("scope"), F.lit(buckets)).alias("bucket")


def walk_scopes(nodes: DataFrame, inner: DataFrame, buckets: int = 32) -> DataFrame:
    """The walk of each scope by one task, in order of id."""
    nodes = nodes.withColumns({c: F.coalesce(c, F.lit(NONE)) for c in ("g", "same", "near")})
    bucket = _scope_bucket(buckets)
    run = lambda n, e: _walked(n.sort_values("id"), e)
    return nodes.withColumn("bucket", bucket).groupBy("bucket").cogroup(inner.withColumn("bucket", bucket).groupBy("bucket")).applyInPandas(run, _DECIDED)


def walk_batch(rows: DataFrame, same: DataFrame, links: DataFrame, buckets: int = 32) -> DataFrame:
    """``walk_scopes`` of a batch as it is: the walking task gathers what else is known of a row.

    Rows: ``id, rec, scope, kh, vd``; same: ``id, scope, same``. The first row of
    a vector, its nearest stored record and the stored record of equal content
    are lookups within a scope, for which no frames need be joined or sent:
    plans, broadcasts and their threads add up in the driver, batch by batch.
    """

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("id")
        src = e["src"].to_numpy()
        h, b, s = e[src == "H"], e[src == "B"], e[src == "S"]
        near: dict[int, tuple[float, int, int]] = {}
        for g, *best in zip(h["a"].tolist(), h["c"].tolist(), h["pat"].tolist(), (-h["b"]).tolist()):
            near[g] = max(near[g], tuple(best)) if g in near else tuple(best)
        equal = dict(zip(s["a"].tolist(), s["b"].tolist()))
        first: dict[tuple[str, str], int] = {}
        ids = n["id"].tolist()
        g = [first.setdefault((k, v), i) if usable else NONE for i, k, v, usable in zip(ids, n["scope"].tolist(), n["vd"].tolist(), n["vd"].notna())]
        c, pat, stored = zip(*(near.get(x, (0.0, 0, -NONE)) for x in g)) if g else ((),) * 3
        n = n.assign(g=g, same=[equal.get(i, NONE) for i in ids], near=[-x for x in stored], near_c=c, near_pat=pat)
        return _walked(n, b.assign(g=b["a"], h=b["b"] - ARRIVALS))

    of_content = same.select(F.lit("S").alias("src"), F.col("id").alias("a"), F.col("same").alias("b"), F.lit(1.0).alias("c"), F.lit(FULL).alias("pat"), "scope")
    known = links.where("src IN ('H', 'B')").unionByName(of_content)
    bucket = _scope_bucket(buckets)
    return rows.withColumn("bucket", bucket).groupBy("bucket").cogroup(known.withColumn("bucket", bucket).groupBy("bucket")).applyInPandas(run, _DECIDED)


def walk_rounds(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    """The same walk in rounds over frames, for scopes too large for one task.

    A row is dropped as soon as an earlier accepted row of equal content or
    near it is known, or a stored one; it is accepted when no earlier related
    row is undecided. The first undecided row of every component always is
    decided, so every round makes progress. What is undecided in scopes of at
    most ``WALK_ROWS`` such rows is walked by tasks: these rows are related to
    no accepted earlier row, so only to each other. Screens and neighbours are
    looked up when all is decided.
    """
    both = inner.select("g", "h", "c", "pat").unionByName(inner.select(F.col("h").alias("g"), F.col("g").alias("h"), "c", "pat"))
    both = materialize(both.distinct(), "edges")
    status = F.when(F.col("same").isNotNull() | F.col("near").isNotNull(), "dropped").otherwise("open")
    state = materialize(nodes.withColumn("status", status), "state")
    before = lambda c: F.coalesce(F.col(c) < F.col("id"), F.lit(False))
    left = None
    while True:
        was, open_rows = left, state.where("status = 'open'")
        left, most = open_rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if not left:
            break
        if was is not None and left >= was:
            raise RuntimeError(f"a round decided none of {left} rows")
        if most <= WALK_ROWS:
            ids = open_rows.select("g").where("g IS NOT NULL").distinct()
            near = inner.join(ids, "g", "left_semi").join(ids.select(F.col("g").alias("h")), "h", "left_semi").select(*inner.columns)
            walked = walk_scopes(open_rows.drop("status"), near).select("id", F.when(F.col("screen").isNull(), "taken").otherwise("dropped").alias("done"))
            new = state.join(walked, "id", "left").withColumn("status", F.coalesce("done", "status"))
        else:
            taken, opened = (F.min(F.when(F.col("status") == x, F.col("id"))) for x in ("taken", "open"))
            by_k = state.where("kh IS NOT NULL").groupBy("kh").agg(taken.alias("k_taken"), opened.alias("k_open"))
            by_g = state.where("g IS NOT NULL").groupBy("g").agg(taken.alias("g_taken"), opened.alias("g_open"))
            side = both.join(by_g.select(F.col("g").alias("h"), "g_taken", "g_open"), "h")
            by_l = side.groupBy("g").agg(F.min("g_taken").alias("l_taken"), F.min("g_open").alias("l_open"))
            new = state.join(by_k, "kh", "left").join(by_g, "g", "left").join(by_l, "g", "left")
            drop, wait = (before(f"k_{x}") | before(f"g_{x}") | before(f"l_{x}") for x in ("taken", "open"))
            new = new.withColumn("status", F.when(F.col("status") != "open", F.col("status")).when(drop, "dropped").when(wait, "open").otherwise("taken"))
        old, state = state, materialize(new.select(*state.columns), "state")
        drop_scratch(old)
    accepted = state.where("status = 'taken'")
    by_k = accepted.where("kh IS NOT NULL").groupBy("kh").agg(F.min("id").alias("k_taken"))
    by_g = accepted.where("g IS NOT NULL").groupBy(F.col("g").alias("h")).agg(F.min("id").alias("t"))
    lost = state.where("status = 'dropped'").join(by_k, "kh", "left")
    lost = lost.withColumn("equal", F.coalesce("same", F.when(before("k_taken"), F.col("k_taken") + F.lit(ARRIVALS))))
    links = both.unionByName(state.where("g IS NOT NULL").select("g", F.col("g").alias("h"), F.lit(1.0).alias("c"), F.lit(FULL).alias("pat")).distinct()).join(by_g, "h")
    of_batch = lost.where("equal IS NULL").join(links, "g").where("t < id").select("id", "c", "pat", (F.lit(-ARRIVALS) - F.col("t")).alias("r"))
    stored = lost.where("equal IS NULL AND near IS NOT NULL").select("id", F.col("near_c").alias("c"), F.col("near_pat").alias("pat"), (-F.col("near")).alias("r"))
    best = of_batch.unionByName(stored).groupBy("id").agg(F.max(F.struct("c", "pat", "r")).alias("best"))
    exact = F.col("equal").isNotNull()
    dropped = lost.join(best, "id", "left").select("id", F.when(exact, "exact").otherwise("cosine").alias("screen"), F.coalesce("equal", -F.col("best.r")).alias("neighbour"), F.when(~exact, F.col("best.c")).alias("cosine"), F.when(~exact, F.col("best.pat")).alias("pat"), "g")
    return accepted.select("id", F.lit(None).cast("string").alias("screen"), F.lit(None).cast("bigint").alias("neighbour"), F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("int").alias("pat"), "g").unionByName(dropped)


def link_batches(memories: DataFrame, arrivals: DataFrame, threshold: float = 0.95, dim: int = 64) -> DataFrame:
    """All numbered batches, one after the other: ``id, batch_no, screen, neighbour, cosine, weight, cluster``.

    Clusters are those after the last batch. Arrivals delivered more than once
    count once, in their first batch; rows without an id or batch number take
    no part.
    """
    spark = memories.sparkSession
    cols = ["batch_no", "user_id", "kind", "created_at", "content", "embedding"]
    rows = materialize(once(arrivals.where("arrival_id IS NOT NULL AND batch_no IS NOT NULL").select("arrival_id", *cols), "arrival_id"), "arrivals")
    numbers = [r[0] for r in rows.select("batch_no").distinct().orderBy("batch_no").collect()]
    if not numbers:
        return spark.createDataFrame([], "id bigint, batch_no int, screen string, neighbour string, cosine double, weight double, cluster string")
    with IncrementalLinkage(spark, threshold, dim) as linkage:
        linkage.bootstrap(memories)
        for n in numbers:
            linkage.process(rows.where(F.col("batch_no") == n))
        # One reading of all decisions, whatever the number of batches.
        decided = spark.read.schema("id bigint, screen string, neighbour bigint, cosine double, weight double").parquet(*[f"{linkage.at}/decisions/{k}" for k in range(1, len(numbers) + 1)])
        out = linkage.clusters(decided).join(rows.select(F.col("arrival_id").alias("id"), "batch_no"), "id")
        return materialize(out.select("id", "batch_no", "screen", record_name(F.col("neighbour")).alias("neighbour"), "cosine", "weight", "cluster"), "decisions")
