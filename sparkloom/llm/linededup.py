"""Removal of boilerplate lines by the number of distinct sites that show them, in DataFrame operations only.

A HyperLogLog sketch of sites is built for each line hash and merged by aggregation. Lines whose estimate lies near
the threshold are counted exactly; then all occurrences of lines on `min_sites` or more sites go, from every document:
one that holds nothing else is left with an empty text.

A line is what stands between newlines; it is known by its text without surrounding spaces. Blank lines never count.
Nulls: a null text is kept (no lines); a null source counts as one site of its own; a null doc_id is kept. Repeated
rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key

MIN_SITES, LG_K, BAND = 10, 10, 0.25


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(31), line).alias("b"))


def boilerplate(put: Scratch, lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes h of the lines on min_sites sites or more, for rows (h, site).

    Estimates outside the band decide by themselves: with 2**10 registers the relative error is about 3 %, the band
    is 8 times as wide. In it the exact count decides.
    """
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n"))
    # few lines get this far; written, their true size decides how the joins below are done
    spread = put.keep(spread.where(F.col("n") >= F.lit(int(min_sites * (1 - BAND)))), "spread")
    sure = spread.where(F.col("n") > F.lit(int(min_sites * (1 + BAND)))).select("h")
    near = spread.where(F.col("n") <= F.lit(int(min_sites * (1 + BAND)))).select("h")
    exact = lines.join(near, "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites).select("h")
    return put.keep(sure.unionAll(exact), "boilerplate")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """df with the new text, and the numbers of its lines and of those removed (columns of these names are replaced)."""
    cols = df.columns
    docs = df.withColumn("__k", row_key(id_col, text_col))
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n"))
    parts = df.select(row_key(id_col, text_col).alias("k"), site.alias("site"), F.explode(F.split(text_col, "\n", -1)).alias("line"))
    parts = parts.select("k", "site", F.trim("line").alias("line")).where("line <> ''")
    lines = parts.select("k", "site", _hash(F.col("line")).alias("h"))
    spread = boilerplate(Scratch(df.sparkSession, "lines"), lines.select("h", "site"), min_sites)
    found = lines.select("k", "h").join(spread, "h").groupBy("k").agg(F.collect_set("h").alias("__bad"))
    all_lines = F.split(F.col(text_col), "\n", -1)
    is_bad = lambda x: (F.trim(x) != "") & F.array_contains("__bad", _hash(F.trim(x)))
    out = docs.join(found.withColumnRenamed("k", "__k"), "__k", "left").withColumn("__all", all_lines)
    out = out.withColumn("__gone", F.when(F.col("__bad").isNull(), F.array().cast("array<string>")).otherwise(F.filter("__all", is_bad)))
    change = F.col("__bad").isNotNull()
    text = F.when(change, F.array_join(F.filter("__all", lambda x: ~is_bad(x)), "\n")).otherwise(F.col(text_col))
    return out.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in cols if c not in names),
        F.coalesce(F.size("__all"), F.lit(0)).cast("long").alias(names[0]),
        F.when(change, F.size("__gone")).otherwise(0).cast("long").alias(names[1]),
    )
