"""Exact top-k search of binary codes in Hamming distance by incremental multi-index hashing.

A code of 64 bits is cut into 4 segments of 16. If two codes differ in d bits, they differ in at most r = d div 4 bits in
one of the segments, or in at most r - 1 in one of the segments above d mod 4. So segment s of the query is looked up
with all masks of r = 0, 1, 2, ... bits as long as 4 r + s does not exceed the bound of the query: the k-th smallest
distance verified so far. When the next step would exceed it, the k nearest are proved to be found. The first bound
comes from a fixed sample of at most SAMPLE codes, which is only used for that.

Equal codes are indexed once, with the k + 1 smallest ids that have them, which is all that a result can hold; equal
query codes are searched once. Lookups are joins on (segment, value) whose condition verifies the whole distance.

Results are ordered by distance, then id; a row is not its own neighbour. Nulls: rows with a null id or vector are
neither queries nor results. Repeated ids count once a code. An empty table gives an empty result; with fewer than k
other rows all of them are returned.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SEGMENTS, BITS, SAMPLE = 4, 16, 4096


def sign_code(vector: str) -> Column:
    """64 bits: the signs of the first 64 dimensions (missing ones are 0)."""
    return F.aggregate(F.transform(F.slice(vector, 1, 64), lambda x: F.coalesce(x > 0, F.lit(False)).cast("long")), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x))


def _masks(bits: int) -> Column:
    """A constant array: a filter over a sequence would be evaluated anew for each row."""
    every = (sum(1 << b for b in chosen) for chosen in itertools.combinations(range(BITS), bits))
    return F.expr(f"cast(split('{','.join(map(str, every))}', ',') as array<int>)")


def _segment(code: Column, s: int) -> Column:
    return F.shiftrightunsigned(code, BITS * s).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance for the rows of df that are queries."""
    spark = df.sparkSession
    put = Scratch(spark, "hamming")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).cast("long").alias("code"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and code is not null").distinct()
    rows = put.keep(rows, "rows")
    few = rows.groupBy("code", "id").agg(F.lit(1)).select("code", "id").withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("r") <= k + 1)
    codes = put.keep(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    sample = codes.orderBy(F.xxhash64("code")).select("code", F.size("ids").alias("n")).limit(SAMPLE).collect()
    some = np.array([r.code for r in sample], np.int64)
    weight = np.array([r.n for r in sample], np.int64)
    near = spark.sparkContext.broadcast((some, weight))

    @F.arrow_udf("int")
    def first_bound(q: pa.Array) -> pa.Array:
        some, weight = near.value
        out = []
        for code in q.to_numpy(zero_copy_only=False):
            n = np.cumsum(np.bincount(np.bitwise_count((some ^ code).view(np.uint64)), weight, minlength=65))
            out.append(int(min(np.searchsorted(n, k + 1), 64)))
        return pa.array(out, pa.int32())

    queries = put.keep(rows.where("q").select("code").distinct().withColumn("bound", first_bound("code")), "queries")
    index = put.keep(
        codes.select(F.col("code").alias("c"), F.size("ids").alias("n"), F.posexplode(F.array(*(_segment(F.col("code"), s) for s in range(SEGMENTS)))).alias("s", "v")), "index"
    )
    found = None
    for r in range(BITS + 1):
        active = queries.where(F.col("bound") >= SEGMENTS * r).repartition(tasks, "code")  # a few rows become many
        if r and active.isEmpty():
            break
        probes = active.select("code", "bound", F.posexplode(F.array(*(_segment(F.col("code"), s) for s in range(SEGMENTS)))).alias("s", "w"))
        probes = probes.where(SEGMENTS * r + F.col("s") <= F.col("bound")).select("code", "bound", "s", F.explode(_masks(r)).alias("m"), "w")
        probes = probes.select("code", "bound", "s", F.col("w").bitwiseXOR(F.col("m").cast("int")).alias("v"))
        d = F.bit_count(F.col("code").bitwiseXOR(F.col("c")))
        hit = probes.join(index.hint("merge"), (probes.s == index.s) & (probes.v == index.v) & (d <= F.col("bound"))).select("code", "c", "n", d.alias("d"))
        found = put.keep((hit if found is None else found.unionAll(hit)).distinct(), f"found{r}")
        # the k-th distance so far, from counts by distance: at most 65 rows a query
        by_d = found.groupBy("code", "d").agg(F.sum("n").alias("n"))
        upto = by_d.withColumn("n", F.sum("n").over(Window.partitionBy("code").orderBy("d")))
        kth = upto.where(F.col("n") >= k + 1).groupBy("code").agg(F.min("d").alias("kth"))
        queries = put.keep(queries.join(kth, "code", "left").select("code", F.least("bound", F.coalesce("kth", "bound")).cast("int").alias("bound")), f"queries{r}")
        found = put.keep(found.join(queries, "code").where("d <= bound").select("code", "c", "n", "d"), f"kept{r}")
    ids = codes.select(F.col("code").alias("c"), "ids")
    each = found.join(ids, "c").select("code", "d", F.explode("ids").alias("id"))
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("d", "id"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("near"))
    asked = rows.where("q").select(F.col("id").alias("query_id"), "code").join(lists, "code")
    mine = F.slice(F.filter("near", lambda x: x.id != F.col("query_id")), 1, k)
    out = asked.select("query_id", F.posexplode(mine).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.d").alias("distance"))
