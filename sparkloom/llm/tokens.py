"""Exact token counts at every prefix of a text, by dynamic programming.

For a BPE vocabulary the last token of a prefix decides the rest: if t is the last token of the encoding of text[:i],
the encoding of text[:i - len(t)] is what stands before it. So count[i] = count[i - len(t)] + 1, where t is the only
suffix of text[:i] that may follow the last token of text[:i - len(t)]; whether two tokens may stand side by side is
read off their merge histories. No piece of the vocabulary holds a word start (U+2581) behind another character or a
newline among others, so words are counted apart from each other (this is verified when the model is loaded).

What is stored of a text is its prefix row: a byte for each character, the (signed) change of the count; its
sum up to a character is the count of that prefix. The row of a text is that of its words one after the other, and the
rows of words are kept by each worker. New words are taken in alphabetical order, so that the work on a common beginning is
done once. Total counts, truncation to a budget and the cuts between pieces of bounded length are read from the rows,
without encoding again.

Where only totals and cuts are wanted, the library counts whole words, whose sums are the counts at their borders, and
rows are made only of the words in which a budget runs out.

Nulls: a null text counts as empty, 0 tokens; a null id is kept. Repeated rows give repeated results, an empty table an
empty one. Memory is bounded: at most CACHE rows or TOTALS counts of words of CACHE_CHARS characters are kept per worker
(counts until its task ends), TOGETHER characters of texts are counted at once. A column with the name of a result is replaced, others are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, for_task

CACHE, TOTALS, CACHE_CHARS, TOGETHER = 800_000, 200_000, 40, 1_000_000
START = "▁"
_SEGMENT = re.compile(f"{START}*[^{START}\n]+|{START}+|\n")


def _together(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about TOGETHER characters."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size < TOGETHER):
            size += len(texts[end] or "")
            end += 1
        yield texts[at:end]
        at = end


class PrefixCounter(dict):
    """Maps words (with their word starts) to their prefix rows."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(model_file, "rb") as f:
            m.ParseFromString(f.read())
        kinds = m.SentencePiece
        if m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.model_type != m.trainer_spec.BPE:
            raise ValueError("only BPE models with the identity normalizer are supported")
        self.dummy = m.normalizer_spec.add_dummy_prefix
        self.rank = {p.piece: -p.score for p in m.pieces if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in m.pieces) or any(START in p.lstrip(START) or "\n" in p for p in self.rank):
            raise ValueError("words of this vocabulary are not independent")
        self.endings = {p[k:] for p in self.rank for k in range(len(p))}
        self.model = m
        self.split: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _merged(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes the piece."""
        if piece not in self.split:
            parts, last = list(piece), None
            while len(parts) > 1:
                ranks = [self.rank.get(a + b, float("inf")) for a, b in zip(parts, parts[1:], strict=False)]
                k = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[k] == float("inf"):
                    last = None
                    break
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.split[piece] = last
        return self.split[piece]

    def _encode(self, s: str) -> list[str]:
        parts = list(s)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, float("inf")) for a, b in zip(parts, parts[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == float("inf"):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _may_follow(self, x: str, y: str) -> bool:
        """Whether y can be the token after x: no merge across their border comes before those that make them."""
        if x not in self.rank or y not in self.rank:
            return True
        if x[-1] == START:  # runs of word starts share one rank
            return self._encode(x + y) == [x, y]
        over_x = over_y = float("inf")
        rank = self.rank
        while True:
            r = rank.get(x + y)
            if r is not None and r < over_x and r <= over_y:
                return False
            a, b = (rank[x] if len(x) > 1 else -1), (rank[y] if len(y) > 1 else -1)
            if a == b == -1:
                return True
            if a > b:
                over_x, s = a, self._merged(x)
                if s is None:
                    return self._encode(x + y) == [x, y]
                x = s[1]
            else:
                over_y, s = b, self._merged(y)
                if s is None:
                    return self._encode(x + y) == [x, y]
                y = s[0]

    def learn(self, words: list[str]) -> None:
        """Adds the rows of words; those of a common beginning are the same."""
        rank, pairs, endings = self.rank, self.pairs, self.endings
        count, last, before = [0], [""], ""
        for w in sorted(words):
            i = 0
            for x, y in zip(before, w):  # noqa: B905
                if x != y:
                    break
                i += 1
            del count[i + 1 :], last[i + 1 :]
            before = w
            for i in range(i + 1, len(w) + 1):
                t, j, k = w[i - 1], i - 1, i - 2
                pieces = []
                while k >= 0 and (c := w[k:i]) in endings:
                    if c in rank:
                        pieces.append((k, c))
                    k -= 1
                for k, c in reversed(pieces):
                    if k:
                        pair = (last[k], c)
                        ok = pairs.get(pair)
                        if ok is None:
                            if len(pairs) > CACHE // 2:
                                pairs.clear()
                            ok = pairs[pair] = self._may_follow(*pair)
                        if not ok:
                            continue
                    t, j = c, k
                    break
                count.append(count[j] + (1 if t in rank else len(t.encode("utf-8", "surrogatepass"))))
                last.append(t)
            self[w] = array("b", [n - m for m, n in zip(count, count[1:])]).tobytes()  # noqa: B905

    def _segments(self, text: str) -> list[str]:
        return _SEGMENT.findall((START if self.dummy else "") + text.replace(" ", START))

    def rows(self, texts: list[str | None]) -> Iterator[bytes]:
        """The prefix row of each text."""
        for some in _together(texts):
            words = [self._segments(t) if t else () for t in some]
            fresh = set(filterfalse(self.__contains__, chain.from_iterable(words)))
            if len(self) + len(fresh) > CACHE:
                self.clear()
                fresh = set(chain.from_iterable(words))
            self.learn(list(fresh))
            for ws in words:
                row = b"".join(map(self.__getitem__, ws))
                yield array("b", [sum(memoryview(row).cast("b")[:2])]).tobytes() + row[2:] if self.dummy and row else row  # the first word start is no character
            for w in fresh:
                if len(w) > CACHE_CHARS:
                    del self[w]

    def prefixes(self, text: str | None) -> list[int]:
        """Token counts of text[:0], text[:1], ..., text."""
        return [0, *counts(next(self.rows([text]))).tolist()]


def counts(row: bytes) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(row, np.int8), dtype=np.int64)


def total(row: bytes) -> int:
    return int(np.frombuffer(row, np.int8).sum(dtype=np.int64))


def cuts(row: bytes, budget: int) -> list[tuple[int, int]]:
    """(characters, tokens) of the pieces of a text: each is the longest that adds no more than the budget to the count.

    A text of no characters is one piece. A budget must be as large as a character's tokens.
    """
    c = counts(row)
    least = np.minimum.accumulate(c[::-1])[::-1]  # the smallest count from here on, as counts may step back
    out, at, done = [], 0, 0
    while at < len(c) or not out:
        end = max(int(np.searchsorted(least, done + budget, "right")), min(at + 1, len(c)))
        now = int(c[end - 1]) if end else 0
        out.append((end - at, now - done))
        at, done = end, now
    return out


class WordCounter(PrefixCounter):
    """Counts whole words with the library; rows only of words that are cut."""

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__(model_file)
        self.model.normalizer_spec.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model.SerializeToString())
        self.totals: dict[str, int] = {}

    def measure(self, texts: list[str | None], budget: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Token count and pieces (characters, tokens) of each text, as total and cuts of its row."""
        totals = self.totals
        for some in _together(texts):
            words = [self._segments(t) if t else () for t in some]
            fresh = set(filterfalse(totals.__contains__, chain.from_iterable(words)))
            if len(totals) + len(fresh) > TOTALS:
                totals.clear()
                fresh = set(chain.from_iterable(words))
            fresh = list(fresh)
            totals.update(zip(fresh, map(len, self.library.encode(fresh, num_threads=1))))  # noqa: B905
            for t, ws in zip(some, words, strict=True):
                n = list(map(totals.__getitem__, ws))
                whole = sum(n)
                yield whole, [(len(t or ""), whole)] if whole <= budget else self._pieces(t, ws, n, budget)
            for w in fresh:
                if len(w) > CACHE_CHARS:
                    del totals[w]

    def _pieces(self, text: str, words: list[str], n: list[int], budget: int) -> list[tuple[int, int]]:
        tokens, chars = np.cumsum([0, *n]), np.cumsum([-1 if self.dummy else 0, *map(len, words)])
        out, at, done = [], 0, 0
        while at < len(text):
            if tokens[-1] - done <= budget:
                end, now = len(text), int(tokens[-1])
            else:
                k = int(np.searchsorted(tokens, done + budget, "right")) - 1  # the word in which the budget runs out
                self.learn([words[k]])
                row = counts(self.pop(words[k]))
                i = int(np.flatnonzero(np.concatenate([[0], row]) <= done + budget - tokens[k])[-1])
                end, now = int(chars[k]) + i, int(tokens[k]) + (int(row[i - 1]) if i else 0)
                if end <= at:  # a character of more tokens than the budget
                    return cuts(next(self.rows([text])), budget)
            out.append((end - at, now - done))
            at, done = end, now
        return out


_loaded: dict[tuple[type, str], PrefixCounter] = {}


def counter(model_file: str, kind: type = PrefixCounter) -> PrefixCounter:
    """One counter of a kind per worker."""
    if (kind, model_file) not in _loaded:
        _loaded[kind, model_file] = kind(model_file)
    return _loaded[kind, model_file]


def prefix_rows(df: DataFrame, model_file: str, text_col: str = "text", name: str = "prefix_row") -> DataFrame:
    """df with the prefix row of the whole text."""

    @F.arrow_udf("binary")
    def rows(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(model_file)
        for batch in texts:
            yield pa.array(c.rows(batch.to_pylist()), pa.binary())

    return df.withColumn(name, rows(F.col(text_col).cast("string")))


_COUNTED = "struct<n_tokens:bigint,pieces:array<struct<begin:bigint,chars:bigint,tokens:bigint>>>"


def _counted(found: list[tuple[int, list[tuple[int, int]]]]) -> pa.Array:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("begin", "chars", "tokens")]))
    rows = [[{"begin": k, "chars": a, "tokens": b} for k, (a, b) in zip(accumulate((a for a, _ in some), initial=0), some)] for _, some in found]  # noqa: B905
    return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(rows, kind)], ["n_tokens", "pieces"])


def _with_counted(df: DataFrame, counted: Column) -> DataFrame:
    names = [c for c in df.columns if c not in ("n_tokens", "pieces")]
    return df.select(*names, counted.alias("__t")).select(*names, "__t.n_tokens", "__t.pieces")


def _pieces_of(rows: list[bytes], budget: int) -> pa.Array:
    return _counted([(n, [(len(x), n)] if n <= budget else cuts(x, budget)) for x in rows for n in (total(x),)])


def read_rows(df: DataFrame, budget: int, row_col: str = "prefix_row") -> DataFrame:
    """df with n_tokens and pieces (begin, chars, tokens), from the prefix rows alone."""

    @F.arrow_udf(_COUNTED)
    def read(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in rows:
            yield _pieces_of(batch.to_pylist(), budget)

    return _with_counted(df, read(row_col))


def measured_rows(df: DataFrame, model_file: str, budget: int, text_col: str = "text", name: str = "prefix_row") -> DataFrame:
    """prefix_rows and read_rows in one pass, a slice of a batch at a time: one worker a task, and no row is read twice."""

    @F.arrow_udf(_COUNTED[:-1] + ",prefix_row:binary>")
    def read(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(model_file)
        for batch in texts:
            for k in range(0, len(batch), SLICE):
                rows = list(c.rows(batch.slice(k, SLICE).to_pylist()))
                n, pieces = _pieces_of(rows, budget).flatten()
                yield pa.StructArray.from_arrays([n, pieces, pa.array(rows, pa.binary())], ["n_tokens", "pieces", "prefix_row"])
            pa.default_memory_pool().release_unused()

    names = [c for c in df.columns if c not in ("n_tokens", "pieces", name)]
    return df.select(*names, read(F.col(text_col).cast("string")).alias("__t")).select(*names, "__t.n_tokens", "__t.pieces", F.col("__t.prefix_row").alias(name))


def measure(df: DataFrame, model_file: str, budget: int, text_col: str = "text") -> DataFrame:
    """The same from the texts, a slice of a batch at a time, for callers that do not want the rows."""

    @F.arrow_udf(_COUNTED)
    def read(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(model_file, WordCounter)
        with for_task(c.totals):
            for batch in texts:
                for k in range(0, len(batch), SLICE):
                    yield _counted(list(c.measure(batch.slice(k, SLICE).to_pylist(), budget)))
                pa.default_memory_pool().release_unused()

    return _with_counted(df, read(F.col(text_col).cast("string")))


def count_tokens(df: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """df with prefix_row and n_tokens of the whole text."""
    return read_rows(prefix_rows(df, model_file, text_col), 2**62).drop("pieces")


def truncate(df: DataFrame, text_col: str = "text", name: str = "truncated") -> DataFrame:
    """df (with pieces) with the first piece of the text: the longest prefix within the budget of read_rows."""
    return df.withColumn(name, F.substr(F.col(text_col), F.lit(1), F.col("pieces")[0]["chars"].cast("int")))
