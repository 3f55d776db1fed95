"""Near-duplicate documents: min-max hashing finds candidates, full shingle sets confirm them.

Under each of PERMS permutations of the shingle hashes both the smallest and the largest value are kept, so one pass
of hashing gives two signature values, each agreeing with the probability of the Jaccard similarity J. BANDS bands of
ROWS values of as many permutations make the keys, the largest moved on by SHIFT bands from the smallest of the same
permutation; a pair with J = 0.8 shares none with a probability of (1 - 0.8**6)**40 = 5e-6, less for small sets (2e-6 for
a union of 5 shingles, as bands with a common permutation rarely fail together), one with a higher J more rarely still.

Documents with equal shingle sets form one class, known by its smallest id; only classes are compared, in three steps:
1. In each key's bucket all classes are compared with one of them, the pivot. Links merge components.
2. Buckets of up to SMALL classes that still hold several components: all pairs of different components.
3. Classes of larger buckets that still do: pairs that share one of their rarest shingles. In an order of all shingles
   by their frequency, sets of n with a similarity of p % share one of the first n - ceil(p n / 100) + 1, so
   no link is lost (the order is by a sketch of the frequencies of fixed size, which only changes how many pairs there
   are). Classes are first compared with the pivot of the shingle, then those of different components with each other,
   if at the shingle's places so much of both sets is left as a link needs: true of the first one that linked sets share,
   and false where the one has too many rare shingles of its own, as copies of a template have.
So no partner is dropped, and no bucket is expanded into all of its pairs; what remains is quadratic only in
the components that share a rare shingle. Every link is confirmed on the full sets (64-bit hashes of the shingles).
Rows of large buckets are dealt to several tasks by a salt, and a pivot's set is sent once to each.

Components are found by contraction: each vertex points to its smallest neighbour, pointers are doubled until
they reach the roots, edges within a component go; both take logarithmically many rounds. Once no more than SMALL_GRAPH
edges are left, one task merges them. Nothing about single documents is collected on the driver.

Nulls: a null or wordless text has the empty set, linked with nothing; a null id is kept (its component is the smallest
non-null id of an equal set, or null). Repeated rows get equal results; rows with one id and different texts are one
document with several sets, linked by any of them. An empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, each, for_task

PERMS, BANDS, ROWS, SHIFT, CACHE = 120, 40, 6, 7, 150_000
SMALL, DEAL, DEALT, SMALL_GRAPH, CELLS_LOG2 = 8, 256, 1 << 16, 500_000, 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(7).integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = np.random.default_rng(8).integers(0, 2**63, PERMS, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        if len(self) >= CACHE:
            self.clear()
        self[w] = h
        return h


_words = _Words()


def words_for_task() -> contextlib.AbstractContextManager:
    """for_task on the module's own cache: a function within another is sent with a copy of what it names."""
    return for_task(_words)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; words are split at ASCII white space, A-Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    x = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(x):
        return x
    size = min(size, len(x))
    h = np.full(len(x) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h + x[k : k + len(h)]) * _MIX
        h ^= h >> np.uint64(32)
    return np.unique(_finish(h))


def keys(s: np.ndarray) -> np.ndarray:
    """The keys of the bands, for a set that is not empty."""
    lo, hi = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMS, np.uint64)
    for at in range(0, len(s), 512):
        v = (s[None, at : at + 512] ^ _XOR[:, None]) * _ODD[:, None]
        v ^= v >> np.uint64(32)
        v *= _MIX
        np.minimum(lo, v.min(axis=1), out=lo)
        np.maximum(hi, v.max(axis=1), out=hi)
    sig = np.concatenate([lo, np.roll(hi, SHIFT)]).reshape(ROWS, BANDS)  # the values of a band are of different permutations
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in sig:
        h = (h ^ row) * _MIX
        h ^= h >> np.uint64(32)
    return _finish(h).view(np.int64)


_SKETCH = "struct<n:bigint,digest:binary,keys:array<bigint>>"


def sketch(df: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (of shingles), digest and keys (null for the empty set)."""

    @F.arrow_udf(_SKETCH)
    def make(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with words_for_task():
            for batch in texts:
                n, digest, all_keys = [], [], []
                for (t,) in each(batch):
                    s = shingles(t, size)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    all_keys.append(keys(s) if len(s) else None)
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(all_keys, pa.list_(pa.int64()))], ["n", "digest", "keys"])

    return df.select(F.col(id_col).alias("id"), make(F.col(text_col).cast("string")).alias("s")).select("id", "s.*")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) to (v, p): the smallest vertex of each one's component."""
    every = [np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)]) for batch in batches]
    if every:
        names, ends = np.unique(np.concatenate(every, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        up = np.arange(len(names))
        while (up[a] != up[b]).any():
            low = np.minimum(up[a], up[b])
            np.minimum.at(up, np.maximum(up[a], up[b]), low)
            while (up[up] != up).any():
                up = up[up]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[up])], names=["v", "p"])


def contract(put: Scratch, edges: DataFrame) -> DataFrame | None:
    """v, comp (the smallest vertex of its component) of the vertices of edges (a, b); None without edges."""
    labels = None
    while True:
        edges = put.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        n = edges.count()
        if not n:
            return labels
        if n <= SMALL_GRAPH:
            up = put.keep(edges.repartition(1).mapInArrow(_merged, "v bigint, p bigint"), "parents")
        else:
            both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            up = put.keep(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")), "parents")
            moved = True
            while moved:
                hop = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
                far = put.keep(up.join(hop, "p").select("v", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "parents")
                put.drop(up)
                moved, up = not far.where("moved").isEmpty(), far
        if labels is None:
            labels = up.select("v", F.col("p").alias("comp"))
        else:
            step = up.select(F.col("v").alias("comp"), "p")
            labels = put.keep(labels.join(step, "comp", "left").select("v", F.coalesce("p", "comp").alias("comp")), "labels")
        if n <= SMALL_GRAPH:
            return labels
        pa_, pb = up.select(F.col("v").alias("a"), F.col("p").alias("x")), up.select(F.col("v").alias("b"), F.col("p").alias("y"))
        edges = edges.join(pa_, "a").join(pb, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sorted sets, neither of them empty, are similar enough."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b, m: about as many rows may have this a)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, s, b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if (a, s) != key:
                    key, own = (a, s), []
                x = np.frombuffer(x.as_buffer(), np.uint64)
                if b is None:
                    own.append(x.copy())
                elif any(_linked(y, x, percent) for y in own):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["a", "b"])

    dealt = pairs.groupBy("a", "b").agg(F.max("m").alias("m")).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / DEAL)).cast("int").alias("s"))
    each = dealt.join(sets.select(F.col("id").alias("b"), "set"), "b").select("a", "s", "b", "set")
    own = dealt.select("a", "s").distinct().join(sets.select(F.col("id").alias("a"), "set"), "a").select("a", "s", F.lit(None).cast("bigint").alias("b"), "set")
    rows = each.unionAll(own).repartition("a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first())
    return rows.mapInArrow(compare, "a bigint, b bigint")


def _fits(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _rare(put: Scratch, sets: DataFrame, percent: int) -> DataFrame:
    """id, n, at, token: of each set the rarest shingles with their places, of which it shares one with any that it is linked with."""
    size = 1 << CELLS_LOG2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, (np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - CELLS_LOG2)).astype(np.int64), 1)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(total[cell])], names=["cell", "n"])

    cells = sets.select("set").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(size, np.int64)
    often[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(often)

    @F.arrow_udf("array<bigint>")
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch:
                t = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(t) + (-len(t) * percent) // 100 + 1
                out.append(t[np.lexsort((t, shared.value[(t >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)]))[:n]].view(np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    return put.keep(sets.select("id", (F.length("set") / 8).cast("int").alias("n"), F.posexplode(first("set")).alias("at", "token")), "rare")


def components(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept of each row."""
    put = Scratch(df.sparkSession, "neardup")
    ids = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = put.keep(sketch(ids, size, "id", "text"), "sketches")
    classes = put.keep(rows.where("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "n", "keys")).alias("c")).select("digest", "c.id", "c.n", "c.keys"), "classes")
    keyed = classes.where("id is not null").select("id", "n", F.explode("keys").alias("key"))
    counts = put.keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("pivot")).where("m > 1"), "counts")
    buckets = put.keep(_with_counts(keyed, counts).select("key", "id", "n", "m", "pivot"), "buckets")
    labels, links = None, None
    if not buckets.isEmpty():

        @F.arrow_udf("binary")
        def full(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            with words_for_task():
                for batch in texts:
                    yield pa.array([shingles(t, size).tobytes() for (t,) in each(batch)], pa.binary())

        sets = put.keep(ids.join(buckets.select("id").distinct(), "id").distinct().select("id", full("text").alias("set")), "sets")
        sizes = classes.select(F.col("id").alias("a"), F.col("n").alias("na"))
        # 1: each class with the smallest of its bucket
        pairs = buckets.where("id <> pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b"), "n").agg(F.max("m").alias("m"))
        tested = put.keep(pairs.join(sizes, "a").where(_fits(F.col("na"), F.col("n"), percent)).select("a", "b", "m"), "pairs")
        links = put.keep(_confirm(tested, sets, percent), "links")
        labels = contract(put, links)
        # 2: what is left of small buckets
        left = put.keep(_mixed(_named(buckets.where("m > 2").select("key", "id", "n", "m"), labels)), "mixed")
        found = put.keep(_confirm(_pairs(left.where(F.col("m") <= SMALL), percent).join(tested, ["a", "b"], "left_anti"), sets, percent), "links")
        links = links.unionAll(found)
        # 3: what is left of large ones
        large = left.where(F.col("m") > SMALL).select("id").distinct()
        if not large.isEmpty():
            rare = _rare(put, sets.join(large, "id"), percent)
            of_token = rare.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("pivot")).where("m > 1")
            groups = put.keep(_with_counts(rare.withColumnRenamed("token", "key"), of_token.withColumnRenamed("token", "key")).select("key", "id", "n", "at", "m", "pivot"), "groups")
            labels = contract(put, links)
            apart = put.keep(_mixed(_named(groups, labels)), "apart")
            own = apart.where("id <> pivot").join(_named(apart.select(F.col("pivot").alias("id")).distinct(), labels).select(F.col("id").alias("pivot"), F.col("comp").alias("other")), "pivot")
            found = put.keep(_confirm(own.where("comp <> other").select(F.col("pivot").alias("a"), F.col("id").alias("b"), "m"), sets, percent), "links")
            links = links.unionAll(found)
            labels = contract(put, links)
            rest = put.keep(_mixed(_named(apart.select("key", "id", "n", "at", "m"), labels)), "rest")
            links = links.unionAll(put.keep(_confirm(_pairs(rest, percent), sets, percent), "links"))
            put.drop(rare, groups, apart)
        labels = contract(put, links)
        put.drop(sets, tested, left)
    put.drop(buckets, counts)
    out = rows.join(classes.select("digest", F.col("id").alias("class")), "digest", "left")
    if labels is not None:
        out = out.join(labels.withColumnRenamed("v", "class"), "class", "left")
    comp = F.coalesce(*([F.col("comp")] if labels is not None else []), "class", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def _with_counts(keyed: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (key, id, ...) of the keys in counts (key, m, pivot), with m and pivot; those of frequent keys dealt by a salt.

    How many ways is told by a table of DEALT cells of keys, each dealt as its most frequent key is. It has that size for
    any input and is broadcast, so no row is moved to learn its salt and a frequent key meets in no task.
    """
    cell = F.pmod("key", F.lit(DEALT))
    parts = F.ceil(F.col("m") / DEAL).cast("int")
    once = keyed.sparkSession.range(DEALT).select(F.col("id").alias("cell"), F.lit(1).alias("parts"))
    cells = F.broadcast(once.unionAll(counts.where(F.col("m") > DEAL).select(cell.alias("cell"), parts.alias("parts"))).groupBy("cell").agg(F.max("parts").alias("parts")))
    rows = keyed.withColumn("cell", cell).join(cells, "cell").withColumn("s", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("cell", "parts")
    dealt = counts.withColumn("cell", cell).join(cells, "cell").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("cell", "parts")
    return rows.join(dealt, ["key", "s"])


def _named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with the component of id."""
    if labels is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(labels.withColumnRenamed("v", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of keys that hold several components."""
    return rows.join(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "key")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b, m: pairs with a key in common, of different components and sizes that do not rule a link out.

    If rows have places (at), neither do these: at the first shingle that two sets share, in the order of all, so many must
    be left in both as a link needs in common. Each linked pair has such a key.
    """
    placed = "at" in rows.columns
    x = rows.select("key", "m", F.col("id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), *([(F.col("n") - F.col("at")).alias("la")] if placed else []))
    y = rows.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), *([(F.col("n") - F.col("at")).alias("lb")] if placed else []))
    fits = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _fits(F.col("na"), F.col("nb"), percent)
    if placed:
        fits &= F.least("la", "lb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return x.join(y, "key").where(fits).groupBy("a", "b").agg(F.max("m").alias("m"))
