"""Language identification with bit-sliced Bloom filters of character n-grams.

All languages share one Bloom filter whose cells are bit masks, one bit a language: the AND of an n-gram's cells names
every language that (probably) has it. A text's hits per language, less those that chance explains at the measured
false-positive rate of the language's slice, decide.

The filters are built from a sample of at most MAX_DOCS labelled texts (one a language if there are more languages than
that), the same number of each language, first in the order of a hash of id and text; texts are used whole. Executors
count the n-grams; of each language those reach the driver that are frequent in it, which are 1 / LEAST_SHARE at most.
An n-gram belongs to a language if it is frequent there and not much rarer than anywhere else.

Masks have as many bits as there are languages, whatever their number: 8 bits for up to 8 of them, else words of 64.
A letter is a character of general category L; numerals such as ½ or Ⅷ are none.

Nulls: a null text, or one without a letter, is `und` with score 0; a null label teaches nothing; a null id is never
held out. Repeated rows give repeated results; an empty table gives an empty one; without any labels all is `und`.
Ties go to the language first in alphabetical order. Very long texts are taken in pieces of PIECE characters, cut
between words. Columns named lang_pred and score are replaced, others kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, each

MAX_DOCS, FOLDS, CELLS_LOG2, HASHES, ORDERS, PIECE = 2400, 5, 20, 3, (2, 3, 4), 1 << 20
LEAST_SHARE, LEAST_COUNT, LEAST_RATIO = 2e-5, 3, 0.2
_NO_LETTER = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def letters(text: str) -> str:
    """The lower-cased runs of letters, with a space between them."""
    words = _NO_LETTER.sub(" ", text.lower())
    if not words.isascii() and (numerals := [c for c in set(words) if not c.isalpha() and c != " "]):
        words = words.translate(dict.fromkeys(map(ord, numerals), " "))
        words = " ".join(words.split())
    return words.strip()


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of the letters, with a space at each end of a piece."""
    words, at = letters(text), 0
    while at < len(words):
        end = min(len(words), at + PIECE)
        if end < len(words) and (space := words.rfind(" ", at + 1, end)) > 0:
            end = space
        c = np.frombuffer(f" {words[at:end].strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        at = end
        out, h = [], c
        for n in range(2, max(ORDERS) + 1):
            if len(c) < n:
                break
            h = h[:-1] * _MIX + c[n - 1 :]
            if n in ORDERS:
                x = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append(x ^ (x >> np.uint64(29)))
        yield np.concatenate(out)


def _cells(h: np.ndarray) -> Iterator[np.ndarray]:
    m = np.uint64((1 << CELLS_LOG2) - 1)
    for k in range(HASHES):
        yield ((h >> np.uint64(k * CELLS_LOG2)) & m).astype(np.int64)


@dataclass
class LanguageFilters:
    """cells: by cell and word of the mask; they take 1 MB for up to 8 languages, else 8 MB for each 64 of them."""

    langs: list[str]
    cells: np.ndarray
    chance: np.ndarray

    @classmethod
    def build(cls, counts: dict[str, tuple[np.ndarray, np.ndarray, int]]) -> LanguageFilters:
        """counts: of each language the frequent n-grams, how often each occurs, and the number of all occurrences."""
        langs = sorted(counts)
        kind, bits = (np.uint8, 8) if len(langs) <= 8 else (np.uint64, 64)
        shares = [(g[order := np.argsort(g)], n[order] / max(1, total)) for g, n, total in (counts[name] for name in langs)]
        union = np.unique(np.concatenate([g for g, _ in shares])) if shares else np.empty(0, np.uint64)
        most = np.zeros(len(union))
        for g, s in shares:
            at = np.searchsorted(union, g)
            most[at] = np.maximum(most[at], s)
        cells = np.zeros((1 << CELLS_LOG2, max(1, -(-len(langs) // bits))), kind)
        fill = np.zeros(len(langs))
        for k, (g, s) in enumerate(shares):
            bit = kind(1 << (k % bits))
            for at in _cells(g[s >= LEAST_RATIO * most[np.searchsorted(union, g)]]):
                cells[at, k // bits] |= bit
            fill[k] = np.mean((cells[:, k // bits] & bit) != 0)
        return cls(langs, cells, fill**HASHES)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Of each language, how many of the n-grams its filter holds."""
        at = _cells(grams)
        mask = self.cells[next(at)]
        for a in at:
            mask = mask & self.cells[a]
        if mask.dtype == np.uint8:
            by_mask = np.bincount(mask[:, 0], minlength=256)
            return np.array([by_mask[np.arange(256) >> k & 1 == 1].sum() for k in range(len(self.langs))], float)
        return np.array([np.count_nonzero(mask[:, k // 64] & np.uint64(1 << k % 64)) for k in range(len(self.langs))], float)

    def predict(self, text: str | None) -> tuple[str, float]:
        n, hits = 0, np.zeros(len(self.langs))
        for grams in ngrams(text) if text and self.langs else ():
            n += len(grams)
            hits += self.hits(grams)
        if not n:
            return "und", 0.0
        true = np.maximum(0, (hits - n * self.chance) / np.maximum(1 - self.chance, 1e-9))
        k = int(true.argmax())
        return self.langs[k], float((true[k] + 1 / len(true)) / (true.sum() + 1))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = MAX_DOCS) -> LanguageFilters:
    put = Scratch(df.sparkSession, "langid")
    rows = df.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.where("t is not null and l is not null")
    names = [r.l for r in rows.select("l").distinct().collect()]
    if not names:
        return LanguageFilters.build({})
    first = Window.partitionBy("l").orderBy("h", "t")  # only the first rows of each task reach the window
    chosen = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= max(1, max_docs // len(names))).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                for grams in ngrams(text):
                    g, n = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["l", "g", "n"])

    grams = put.keep(chosen.mapInArrow(count, "l string, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")), "grams")
    totals = {r.l: int(r.n) for r in grams.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*(F.lit(x) for name, n in totals.items() for x in (name, max(LEAST_COUNT, LEAST_SHARE * n) * 1.0))) if totals else F.lit(None)
    often = grams.where(F.col("n") >= least[F.col("l")]).toPandas() if totals else None
    put.drop(grams)
    counts: dict[str, tuple[np.ndarray, np.ndarray, int]] = dict.fromkeys(names, (np.empty(0, np.uint64), np.empty(0, np.int64), 0))
    for name, n in totals.items():
        own = often[often["l"] == name]
        counts[name] = (own["g"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.int64), n)
    return LanguageFilters.build(counts)


def identify(df: DataFrame, model: LanguageFilters, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score; only the text is looked at."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in texts:
            got = [m.predict(t) for t, in each(batch)]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    names = [c for c in df.columns if c not in ("lang_pred", "score")]
    return df.select(*names, predict(F.col(text_col).cast("string")).alias("__p")).select(*names, "__p.lang_pred", "__p.score")
