"""Packing into token-budget batches with optimal length buckets.

Sequences are documents, or the consecutive pieces of at most `max_len` tokens of longer ones: where these are cut is
either given, from the texts' prefix counts, or after every max_len tokens. Dynamic programming over
the global histogram of lengths (at most max_len + 1 rows on the driver) chooses the bucket lengths that minimise
the total padding; each sequence goes to the shortest bucket that holds it and a batch of a bucket has as many
sequences as fit its token budget when padded.

Within a bucket sequences are in the order of a hash of the id, so batches mix sources.

Nulls: a null length counts as 0, a null list of pieces as one of length 0; a null id is kept. Repeated rows are separate
sequences; which of equal ones gets which slot is arbitrary. Sequences of length 0 stay (in the shortest bucket). An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gapless

MAX_LEN, BUCKETS, BUDGET = 4096, 16, 65_536


def best_lengths(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths with the least total padding, at most `buckets`, the last the largest length."""
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    if not len(x):
        return []
    n, s = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    d = len(x)
    # cost[j]: least padding of the d shortest lengths up to j in k buckets; came[k][j]: where the last one begins
    cost = np.concatenate([[0], x * n[1:] - s[1:]])
    came = [np.zeros(d + 1, np.int64)]
    for _ in range(1, min(buckets, d)):
        new, at = cost.copy(), came[-1] * 0 - 1
        for j in range(1, d + 1):
            t = cost[:j] + x[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            i = int(t.argmin())
            if t[i] < new[j]:
                new[j], at[j] = t[i], i
        came.append(at)
        cost = new
    out, j, k = [], d, len(came) - 1
    while j > 0:
        while k > 0 and came[k][j] < 0:
            k -= 1
        out.append(int(x[j - 1]))
        j = int(came[k][j])
        k -= 1
    return out[::-1]


def pieces_of(df: DataFrame, id_col: str, len_col: str, max_len: int) -> DataFrame:
    """doc_id, piece, n_tokens, of lengths alone."""
    n = F.greatest(F.coalesce(F.col(len_col), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    last = F.when(n > 0, ((n - 1) / max_len).cast("long")).otherwise(0)
    seqs = df.select(F.col(id_col).alias("doc_id"), n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return seqs.select("doc_id", "piece", F.least(F.lit(max_len).cast("long"), F.col("__n") - F.col("piece") * max_len).alias("n_tokens"))


def pieces_given(df: DataFrame, id_col: str, pieces_col: str) -> DataFrame:
    """doc_id, piece, n_tokens, first_char, n_chars, of arrays of (begin, chars, tokens)."""
    given = F.coalesce(pieces_col, F.expr("array(struct(0L as begin, 0L as chars, 0L as tokens))"))
    rows = df.select(F.col(id_col).alias("doc_id"), F.posexplode(given).alias("k", "p"))
    return rows.select("doc_id", F.col("k").cast("long").alias("piece"), F.col("p.tokens").alias("n_tokens"), F.col("p.begin").alias("first_char"), F.col("p.chars").alias("n_chars"))


def pack(
    df: DataFrame, id_col: str = "doc_id", len_col: str = "n_tokens", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, pieces_col: str | None = None
) -> DataFrame:
    """A row for each sequence: id, piece, n_tokens, bucket_len, batch, slot, padding; with given pieces also first_char
    and n_chars. Batches are numbered in each bucket."""
    seqs = pieces_of(df, id_col, len_col, max_len) if pieces_col is None else pieces_given(df, id_col, pieces_col)
    more = seqs.columns[3:]
    # rows without an id are numbered, so that many equal ones are not numbered by one task below
    seqs = Scratch(df.sparkSession, "pack").keep(seqs.withColumn("u", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())))
    hist = seqs.groupBy("n_tokens").count().collect()
    sizes = best_lengths(np.array([r[0] for r in hist]), np.array([r[1] for r in hist]), buckets)
    bucket = F.lit(None).cast("long")
    for b in reversed(sizes):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    placed = seqs.withColumn("bucket_len", bucket)
    placed = gapless(placed, ["bucket_len"], ["doc_id", "piece", "n_tokens"], "__at", F.struct("doc_id", "piece", "u"), sum(r[1] for r in hist))
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return placed.select(
        F.col("doc_id").alias(id_col), "piece", "n_tokens", *more, "bucket_len", F.floor(F.col("__at") / fits).cast("long").alias("batch"),
        F.pmod("__at", fits).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
