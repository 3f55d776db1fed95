"""Minimax contiguous sharding, in DataFrame operations only.

Equal texts form one atomic group. Groups are ordered by the SHA-256 of their text, so a row knows the place of its
group from its own text: neither the search nor the assignment shuffles or joins on texts, and a text with a third of
all rows is just one large summand. The smallest feasible capacity C of `shards` contiguous pieces is found by binary
search with greedy checks. The search runs on a histogram over hash prefixes of bounded size; only cells in which a
cut may fall are split further (each time by two more hex digits) until lower and upper bound of C meet.

With C known there are as a rule many optimal cuts. The plain greedy one fills the first shards and may leave the last
ones empty, so each cut is put at the group border nearest to an even split of what is left, among those from which
the rest still fits into C.

Nulls: a null text has size 8 (no bytes) and all null texts are one group; a null doc_id is kept. Repeated rows are
kept, each with a slot of its own; which of them gets which is arbitrary. An empty table gives an empty result. Fewer groups than shards leave shards empty.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gapless

FIRST_DIGITS, MORE_DIGITS, NULL_KEY = 3, 2, "g"


@dataclass
class Cell:
    """Groups whose key begins with `prefix`; atomic: just one group."""

    prefix: str
    size: int
    atomic: bool


def _starts(cells: list[Cell]) -> list[int]:
    out = [0]
    for c in cells:
        out.append(out[-1] + c.size)
    return out


def _walk(cells: list[Cell], at: list[int], cap: int, shards: int, fluid: bool) -> list[int]:
    """Positions reached by 1, 2, ... shards of this capacity. fluid: cells of several groups can be cut anywhere."""
    x, out = 0, []
    for _ in range(shards):
        t = x + cap
        if t >= at[-1]:
            x = at[-1]
        else:
            j = bisect.bisect_right(at, t) - 1
            x = t if fluid and not cells[j].atomic else max(x, at[j])
        out.append(x)
    return out


def _least(cells: list[Cell], at: list[int], shards: int, fluid: bool) -> int:
    total = at[-1]
    lo, hi = -(-total // shards), total
    while lo < hi:
        mid = (lo + hi) // 2
        if _walk(cells, at, mid, shards, fluid)[-1] >= total:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _even_cuts(at: list[int], cap: int, shards: int) -> list[int]:
    """Indices of the borders to cut at."""
    total = at[-1]
    least = [0] * (shards + 1)  # least[k]: smallest border from which shards - k shards suffice
    least[shards] = total
    for k in range(shards - 1, 0, -1):
        least[k] = at[bisect.bisect_left(at, least[k + 1] - cap)]
    cuts, x = [], 0
    for k in range(1, shards):
        want = x + (total - x) / (shards - k + 1)
        lo, hi = bisect.bisect_left(at, max(least[k], x)), bisect.bisect_right(at, x + cap) - 1
        j = min(max(bisect.bisect_left(at, want), lo), hi)
        if j > lo and want - at[j - 1] < at[j] - want:
            j -= 1
        cuts.append(j)
        x = at[j]
    return cuts


def _cells(rows: DataFrame, digits: int, inside: list[str] | None = None) -> list[Cell]:
    """At most 16 ** FIRST_DIGITS rows, or 16 ** MORE_DIGITS for each cell that is split, reach the driver."""
    if inside is not None:
        rows = rows.where(F.substring("key", 1, len(inside[0])).isin(inside))
    got = (
        rows.groupBy(F.substring("key", 1, digits).alias("p"))
        .agg(F.sum("size").alias("s"), (F.min("key") == F.max("key")).alias("one"))
        .collect()
    )
    return [Cell(r.p, r.s, r.one) for r in sorted(got, key=lambda r: r.p)]


def minimax_cuts(rows: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Smallest capacity, and the key prefixes at which the shards 1, 2, ... begin, for rows with `key` and `size`."""
    cells, digits = _cells(rows, FIRST_DIGITS), FIRST_DIGITS
    while True:
        at = _starts(cells)
        low, high = _least(cells, at, shards, True), _least(cells, at, shards, False)
        if low == high:
            break
        open_ = {j for j, c in enumerate(cells) if not c.atomic and c.size > low}
        if not open_:
            for d, u in zip(_walk(cells, at, low, shards, False), _walk(cells, at, high, shards, True), strict=True):
                first, last = bisect.bisect_right(at, d) - 1, bisect.bisect_right(at, u) - 1
                open_.update(j for j in range(max(0, first), min(last, len(cells) - 1) + 1) if not cells[j].atomic)
        by_depth: dict[int, list[str]] = {}
        for j in open_:
            by_depth.setdefault(len(cells[j].prefix), []).append(cells[j].prefix)
        fresh: dict[str, list[Cell]] = {}
        for depth, inside in by_depth.items():
            for c in _cells(rows, depth + MORE_DIGITS, inside):
                fresh.setdefault(c.prefix[:depth], []).append(c)
        cells = [x for j, c in enumerate(cells) for x in (fresh[c.prefix] if j in open_ else [c])]
        digits += MORE_DIGITS
    return high, [cells[j].prefix if j < len(cells) else "~" for j in _even_cuts(at, high, shards)]


def shard_documents(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `bytes`) of each row."""
    text = F.col(text_col).cast("string")
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(NULL_KEY)).alias("key"),
    )
    # rows without an id are numbered, so that many equal ones are not numbered by one task below
    rows = Scratch(df.sparkSession, "shard").keep(rows.withColumn("u", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())))
    _, cuts = minimax_cuts(rows, shards)
    shard: Column = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("key") >= F.lit(c)).cast("int")
    placed = rows.withColumn("shard", shard.cast("int"))
    out = gapless(placed, ["shard"], ["key", "doc_id"], "slot", F.struct("doc_id", "key", "u"))
    return out.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
