"""Benchmark decontamination by spaced-seed hashing.

A document is contaminated by a benchmark item if, at some alignment without gaps, WINDOW consecutive words of the item
(all of a shorter one) agree with the document in at least 80 % of the places, those beyond the document's ends counted
as different, or RUN words in a row agree. So an item of 5 to 9 words may have one word replaced, one of 10 or 11 two;
one below 5 words must occur exactly. Words are runs of letters and digits in lower case; in scripts without spaces
between words each character is one.

Fixed masks choose which of a few neighbouring words are hashed and which are ignored. For items of LEAST_SPACED words
and more four masks together hit every such overlap, wherever its substitutions lie; for each shorter length the words
are cut into a few parts, and there is a mask for each choice of as many parts to ignore as words may be replaced (both
checked over all patterns in the tests).

Plan. The hashes of the items set bits in a filter of at most 2**FILTER_LOG2 bits (32 MB), which is broadcast; hashes of
the documents' words that pass it are joined with those of the items. A larger benchmark lets more through, and the
join does the rest. Each distinct hit (document, item, shift) is then verified: the document gives the words that
the item would cover, these are joined with the item's words and compared place by place. Nothing is
held for all items at once.

Nulls: a null text on either side never matches, nor does one without words; null ids are kept. Repeated rows give
repeated results (items with equal ids are told apart by their text and reported once, at their best; equal texts are
searched once). Ties go to the first place. Empty tables give an empty result. A column with the name of the result is replaced, other
columns are kept.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, each, for_task

MASKS = ("1101111", "111010011", "1100101011", "110001111")
WINDOW, PERCENT, RUN, LEAST_SPACED, LEAST_TOLERANT = 20, 80, 13, 12, 5
FILTER_LOG2, BITS_A_SEED, CACHE, TOGETHER = 28, 32, 150_000, 100_000
# fixed values: scripts that are written without spaces between words (Thai to Tibetan, Myanmar, Khmer, kana, Han)
UNSPACED = "฀-࿿က-႟ក-៿぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{UNSPACED}]+|(?=\w)[{UNSPACED}]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hash of a word; bounded."""

    def __missing__(self, w: str) -> int:
        h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) >= CACHE:
            self.clear()
        self[w] = h
        return h


_words = _Words()


def words_for_task() -> contextlib.AbstractContextManager:
    """for_task on the module's own cache: a function within another is sent with a copy of what it names."""
    return for_task(_words)


def word_hashes(text: str) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, _WORD.findall(text.lower())), np.uint64)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def seeds(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the words that the mask shows, at each place where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, number + 1, np.uint64)
    for k, shown in enumerate(mask):
        if shown == "1":
            h = h * _MIX + words[k : k + n]
    return _finish(h)


def least_same(n: int) -> int:
    """How many words of a window of n must agree."""
    return -(-n * PERCENT // 100)


def short_masks(n: int) -> list[str]:
    """Masks for items of n words: all words but those of as many parts as words may differ."""
    wrong = n - least_same(n)
    if not wrong:
        return ["1" * n]
    parts = wrong + 2
    edge = [n * k // parts for k in range(parts + 1)]
    part = [next(k for k in range(parts) if i < edge[k + 1]) for i in range(n)]
    return ["".join("0" if part[i] in left_out else "1" for i in range(n)) for left_out in itertools.combinations(range(parts), wrong)]


def masks_for(lengths: list[int]) -> list[tuple[int, str, int]]:
    """(number, mask, item length; 0 for all from LEAST_SPACED on) for items of these lengths."""
    out = [(m, mask, 0) for m, mask in enumerate(MASKS)] if any(n >= LEAST_SPACED for n in lengths) else []
    for n in sorted({n for n in lengths if 0 < n < LEAST_SPACED}):
        out += [(100 * n + j, mask, n) for j, mask in enumerate(short_masks(n))]
    return out


_SEED = "seed bigint, a bigint, b bigint, place int"


def _rows(seed: list[np.ndarray], a: list[int], b: list[int], place: list[np.ndarray]) -> pa.RecordBatch:
    count = [len(s) for s in seed]
    cols = [np.concatenate(seed).view(np.int64), np.repeat(np.array(a, np.int64), count), np.repeat(np.array(b, np.int64), count), np.concatenate(place).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["seed", "a", "b", "place"])


def _item_seeds(masks: list[tuple[int, str, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, b, words) to seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "words")), strict=True):
                words = np.frombuffer(w, np.uint64)
                found = [seeds(words, mask, m) for m, mask, n in masks if (n == len(words) if n else len(words) >= LEAST_SPACED)]
                if found:
                    yield _rows(found, [a] * len(found), [b] * len(found), [np.arange(len(s)) for s in found])

    return run


def _probes(h: np.ndarray, log2: int) -> Iterator[np.ndarray]:
    mask = np.uint64((1 << log2) - 1)
    yield h & mask
    yield (h >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask


def _filter(put: Scratch, hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of two probes in words of 64 bits; executors put its words together."""
    log2 = min(FILTER_LOG2, max(17, (max(1, hashes.count()) * BITS_A_SEED).bit_length()))

    @F.arrow_udf("array<bigint>")
    def places(c: pa.Array) -> pa.Array:
        h = c.to_numpy(zero_copy_only=False).view(np.uint64)
        return pa.array(np.stack([p.view(np.int64) for p in _probes(h, log2)], 1).tolist(), pa.list_(pa.int64()))

    bits = hashes.select(F.explode(places("seed")).alias("p"))
    words = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x")).toPandas()
    out = np.zeros(1 << (log2 - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["x"].to_numpy(np.int64).view(np.uint64)
    return out, log2


def _in_filter(words: np.ndarray, log2: int, h: np.ndarray) -> np.ndarray:
    """Places of h that may be in the filter."""
    at = np.arange(len(h))
    for k in range(2):
        p = next(itertools.islice(_probes(h[at], log2), k, None))
        at = at[(words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
    return at


_GAP = np.arange(1, LEAST_SPACED + 1, dtype=np.uint64)  # no word; longer than each mask, so that none reaches two texts


def _by_words(rows: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Rows of texts of TOGETHER words or a little more, those without words left out."""
    some, n = [], 0
    for row in rows:
        if len(row[2]):
            some.append(row)
            n += len(row[2])
            if n >= TOGETHER:
                yield some
                some, n = [], 0
    if some:
        yield some


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(97), text).alias("b")]


def compare(words: np.ndarray, covered: np.ndarray, begin: int) -> tuple[int, int, int]:
    """Agreeing words of the best window, its begin in the item, longest run; covered: the document from item word `begin` on."""
    same = np.zeros(len(words) + 1, np.int64)
    same[begin : begin + len(covered)] = words[begin : begin + len(covered)] == covered
    total = np.concatenate([[0], np.cumsum(same[:-1])])
    inside = total[min(WINDOW, len(words)) :] - total[: len(total) - min(WINDOW, len(words))]
    gaps = np.flatnonzero(same == 0)
    k = int(inside.argmax())
    return int(inside[k]), k, int(np.diff(gaps, prepend=-1).max()) - 1


_CUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ia", pa.int64()), ("ib", pa.int64()), ("shift", pa.int32()), ("covered", pa.binary())])
HIT = "array<struct<item_id:bigint,n_same:int,first_word:int>>"


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """a, b (hash of a text of docs), item_id, n_same, first_word: the best window of each item that a text holds."""
    put = Scratch(docs.sparkSession, "decontam")

    @F.arrow_udf("binary")
    def hashed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with words_for_task():
            for batch in texts:
                yield pa.array([word_hashes(t).tobytes() for (t,) in each(batch)], pa.binary())

    given = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("t")).where("t is not null").select("item_id", "t", *_text_key(F.col("t"))).distinct()
    wanted = put.keep(given.select("item_id", "a", "b", hashed("t").alias("words")), "items")
    distinct = wanted.select("a", "b", "words").distinct()
    masks = masks_for([r.n for r in distinct.select((F.least(F.length("words") / 8, F.lit(LEAST_SPACED))).cast("int").alias("n")).distinct().collect()])
    sought = put.keep(distinct.mapInArrow(_item_seeds(masks), _SEED), "seeds")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(put, sought.select("seed").distinct()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, log2 = shared.value
        with words_for_task():
            for batch in batches:
                rows = each(*(batch.column(c) for c in ("a", "b", "t")))
                for some in _by_words(((a, b, word_hashes(t)) for a, b, t in rows)):
                    flat = np.concatenate([x for _, _, words in some for x in (_GAP, words)] + [_GAP])
                    begin = np.cumsum([0] + [len(_GAP) + len(words) for _, _, words in some[:-1]]) + len(_GAP)
                    a, b = (np.array([r[k] for r in some], np.int64) for k in (0, 1))
                    for m, mask, _ in masks:
                        h = seeds(flat, mask, m)
                        at = _in_filter(cells, log2, h)
                        doc = np.searchsorted(begin, at + len(mask) - 1, "right") - 1  # a place before the first word is the next document's
                        own = doc >= 0
                        at, doc = at[own], doc[own]
                        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(a[doc]), pa.array(b[doc]), pa.array((at - begin[doc]).astype(np.int32))], names=["seed", "a", "b", "place"])

    texts = docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null").select("t", *_text_key(F.col("t")))
    probes = put.keep(texts.mapInArrow(look, _SEED), "probes")
    on_item = sought.select("seed", F.col("a").alias("ia"), F.col("b").alias("ib"), F.col("place").alias("q"))
    hits = put.keep(probes.join(on_item, "seed").select("a", "b", "ia", "ib", (F.col("place") - F.col("q")).alias("shift")).distinct(), "hits")
    put.drop(probes, sought)
    with_size = hits.join(distinct.select(F.col("a").alias("ia"), F.col("b").alias("ib"), (F.length("words") / 8).cast("int").alias("n")), ["ia", "ib"])
    asked = put.keep(with_size.groupBy("a", "b").agg(F.collect_list(F.struct("ia", "ib", "shift", "n")).alias("asked")), "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with words_for_task():
            for batch in batches:
                for a, b, text, want in each(*(batch.column(c) for c in ("a", "b", "t", "asked"))):
                    words = word_hashes(text)
                    rows = [{"a": a, "b": b, "ia": w["ia"], "ib": w["ib"], "shift": w["shift"], "covered": words[max(0, w["shift"]) : max(0, w["shift"] + w["n"])].tobytes()} for w in want]
                    for k in range(0, len(rows), 5000):
                        yield pa.RecordBatch.from_pylist(rows[k : k + 5000], schema=_CUT)

    # written, as is what each step of Python makes: steps in one task have a worker each, which all live on for other stages
    covered = put.keep(texts.join(asked, ["a", "b"]).dropDuplicates(["a", "b"]).mapInArrow(cut, "a bigint, b bigint, ia bigint, ib bigint, shift int, covered binary"), "covered")

    @F.arrow_udf("struct<n_same:int,first_word:int,run:int,need:int>")
    def held(words: pa.Array, covers: pa.Array, shifts: pa.Array) -> pa.Array:
        out = []
        for w, c, s in zip(words.to_pylist(), covers.to_pylist(), shifts.to_pylist(), strict=True):
            x = np.frombuffer(w, np.uint64)
            n, k, run = compare(x, np.frombuffer(c, np.uint64), max(0, -s))
            out.append({"n_same": n, "first_word": max(0, s + k), "run": run, "need": least_same(min(WINDOW, len(x)))})
        return pa.array(out, pa.struct([(c, pa.int32()) for c in ("n_same", "first_word", "run", "need")]))

    # a condition on what may differ from call to call is not moved below the call, which would be made twice
    on_words = wanted.select("item_id", F.col("a").alias("ia"), F.col("b").alias("ib"), "words")
    checked = covered.join(on_words, ["ia", "ib"]).select("a", "b", "item_id", held.asNondeterministic()("words", "covered", "shift").alias("h")).where(f"h.n_same >= h.need or h.run >= {RUN}")
    best = checked.groupBy("a", "b", "item_id").agg(F.max(F.struct("h.n_same", (-F.col("h.first_word")).alias("f"))).alias("x"))
    found = put.keep(best.select("a", "b", "item_id", "x.n_same", (-F.col("x.f")).alias("first_word")), "found")
    put.drop(wanted, hits, asked, covered)
    return found


def overlaps(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", name: str = "hits") -> DataFrame:
    """docs with the array of the items that each holds, the best window of each item."""
    found = find(docs, items, text_col, item_id, item_text)
    hits = found.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("item_id", "n_same", "first_word"))).alias("__hits"))
    hits = hits.select(F.struct("a", "b").alias("__t"), "__hits")
    names = [c for c in docs.columns if c != name]
    out = docs.withColumn("__t", F.struct(*_text_key(F.col(text_col).cast("string")))).join(hits, "__t", "left")
    return out.select(*names, F.coalesce("__hits", F.array().cast(HIT)).alias(name))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with their columns as they are."""
    found = find(docs, items, text_col).select(F.struct("a", "b").alias("__t")).distinct()
    return docs.withColumn("__t", F.struct(*_text_key(F.col(text_col).cast("string")))).join(found, "__t", "left_anti").select(docs.columns)
