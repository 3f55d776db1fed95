"""Document quality by co-training of two views.

One logistic classifier sees the text: its words, how much they repeat, its mix of characters. The other sees
what is known of the page without reading it: source, language and length as stored, and pairs of these. In each round both
label all unlabelled documents, and of each class the MAX_GIVEN different texts that a view is most sure of are handed to the
other as (pseudo-)labelled rows. Labelled rows kept apart then calibrate both and weigh them into one probability that a
document is fit for training, i.e. of good quality and not toxic.

Bounds. Training uses at most MAX_LABELLED labelled rows (first in the order of a hash of id and text) and MAX_GIVEN
pseudo-labelled ones a class, view and round, chosen from all documents (ties in the order of the hash). Executors
compute and count features; MOST_WORDS features a view and, of the training rows, the numbers of these reach the driver.
Every document is scored, by its whole text.

Nulls: a null text is empty; a null source, language or length is a value of its own; labels with a null are not used, a
null id is unlabelled. Repeated rows give repeated results and teach once; a document with several labels is good if all say
so. Ties between features go to the first in alphabetical order. An empty table gives an empty one. Without labels of both
kinds every document has probability 0.5 and is accepted. Columns named as the results are replaced, others are kept.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, each

MAX_LABELLED, MAX_GIVEN, ROUNDS, SURE, THRESHOLD = 5000, 200, 2, 0.98, 0.5
LEAST_DOCS, LEAST_Z, MOST_WORDS, STEM = 8, 5.0, 2000, 4
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_KINDS = np.zeros(256, np.int64)  # 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 other ASCII, 7 beyond
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[[9, 11, 12, 13, 32]], _KINDS[10] = 1, 2, 3, 4, 5
_KINDS[(_KINDS == 0) & (np.arange(256) < 128)] = 6
_KINDS[128:] = 7


def _step(x: float) -> int:
    return int(np.ceil(np.log2(1e-3 + x) * 2))


def text_features(text: str) -> set[str]:
    """The lower-cased words and runs of punctuation, the beginnings of words, and in steps how much they repeat and the
    mix of characters."""
    t = _TOKEN.findall(text.lower())
    out = set(t)
    kinds = len(out)
    out.update([f"^{w[:STEM]}" for w in out if len(w) > STEM])
    if len(t) >= 12:
        again = sum(map(operator.eq, t, islice(t, 1, None))) / len(t)
        out |= {f" again={int(np.log2(1e-2 + again))}", f" distinct={int(8 * kinds / len(t))}"}
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.bincount(_KINDS[b], minlength=8)
    size = max(1, len(b))
    out.update(f" {name}={_step(n[k] / size)}" for name, k in (("upper", 2), ("digit", 3), ("other", 6), ("beyond", 7)))
    return out | {f" word={_step(size / (n[4] + n[5] + 1))}", f" line={_step(size / (n[5] + 1) / 100)}"}


def page_features(source: str | None, lang: str | None, n_chars: int | None) -> set[str]:
    """Names of what is known of the page, and of pairs of it."""
    one = [f"source={source}", f"lang={lang}", f"size={n_chars if n_chars is None else int(np.log2(max(0, n_chars) + 1))}"]
    return {*one, f"{one[0]} {one[1]}", f"{one[0]} {one[2]}", f"{one[1]} {one[2]}"}


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 0.05) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        d = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * b)
        b += d
        if np.abs(d).max() < 1e-4:
            break
    return b


@dataclass
class View:
    """vocab: features that speak clearly against a document; the last weight is the constant."""

    vocab: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def numbers(self, features: set[str]) -> list[int]:
        return sorted(self.vocab[f] for f in self.vocab.keys() & features)

    def logit(self, features: set[str]) -> float:
        return float(self.weights[-1] + sum(self.weights[self.vocab[f]] for f in self.vocab.keys() & features))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]


def matrix(rows: list[list[int]], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    return x


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class CoTrained:
    text: View
    page: View
    scale: np.ndarray  # calibration: (a, b) of the text view, then of the page view
    join: np.ndarray  # weights of both calibrated views, and the constant

    def score(self, text: str, source: str | None, lang: str | None, n_chars: int | None) -> tuple[float, float, float]:
        """Probability by both, by the text alone, by the page alone."""
        a = self.scale[0] * self.text.logit(text_features(text)) + self.scale[1]
        b = self.scale[2] * self.page.logit(page_features(source, lang, n_chars)) + self.scale[3]
        return tuple(float(_p(np.array(z))) for z in (self.join[0] * a + self.join[1] * b + self.join[2], a, b))


_META = ("source", "lang", "n_chars")
_VIEWS = ("t", "p")


def _inputs(docs: DataFrame, id_col: str) -> DataFrame:
    """id, x (hash of the text), h (hash of id and text), text, source, lang, n_chars; a missing column counts as null."""
    have = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("string").alias("id"), F.xxhash64(F.lit(3), text).alias("x"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), text.alias("text"),
        have("source", "string").alias("source"), have("lang", "string").alias("lang"), have("n_chars", "bigint").alias("n_chars"),
    )


def _with_features(rows: DataFrame, *names: str) -> DataFrame:
    """Columns of these names, and the features of both views, t and p."""

    @F.arrow_udf("struct<t:array<string>,p:array<string>>")
    def features(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        t = pa.array([sorted(text_features(x)) for x in texts.to_pylist()], kind)
        return pa.StructArray.from_arrays([t, pa.array([sorted(page_features(*x)) for x in zip(sources.to_pylist(), langs.to_pylist(), sizes.to_pylist(), strict=True)], kind)], list(_VIEWS))

    return rows.select(*names, features("text", *_META).alias("__f")).select(*names, "__f.*")


def _learn(rows: DataFrame) -> list[View]:
    """Both views from rows: features t and p, y (1: good), w, h to order by, and who (t, p or both) they teach.

    What merely is common in good documents is left out: a short text lacks it through no fault of its own.
    """
    of = lambda v: F.when(F.contains("who", F.lit(v)), F.concat(F.array(F.lit(v)), F.transform(v, lambda f: F.concat(F.lit(v), f)))).otherwise(F.array().cast("array<string>"))
    # the name of a view without a feature stands for its rows
    counts = rows.select("y", F.explode(F.concat(*(of(v) for v in _VIEWS))).alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    got = {r.f: (r.a, r.b) for r in counts.where((F.col("a") + F.col("b") >= LEAST_DOCS) & (F.col("b") > 0) | (F.length("f") == 1)).collect()}
    views = []
    for v in _VIEWS:
        n1, n0 = (max(1, n) for n in got[v])
        names = [f for f in got if f[0] == v and len(f) > 1]
        a, b = (np.array([got[f][k] for f in names], float) for k in range(2))
        p = (a + b) / (n1 + n0)
        z = np.round((b / n0 - a / n1) / np.sqrt(np.maximum(1e-12, p * (1 - p) * (1 / n1 + 1 / n0))), 9)
        best = sorted(np.flatnonzero(z >= LEAST_Z).tolist(), key=lambda k: (-z[k], names[k]))[:MOST_WORDS]  # noqa: B023
        views.append(View({names[f][1:]: k for k, f in enumerate(best)}))
    got = _numbers(rows, views)
    for v, view in zip(_VIEWS, views, strict=True):
        mine = [r for r in got if v in r.who]
        view.weights = _fit(matrix([r.k[v] for r in mine], len(view.vocab)), np.array([r.y for r in mine], float), np.array([r.w for r in mine], float))
    return views


def _numbers(rows: DataFrame, views: list[View]) -> list:
    """Rows (h, y, w, who, k: the numbers of the features by view) in the order of h."""
    shared = rows.sparkSession.sparkContext.broadcast(views)

    @F.arrow_udf("struct<t:array<int>,p:array<int>>")
    def numbers(t: pa.Array, p: pa.Array) -> pa.Array:
        found = [pa.array([view.numbers(set(f)) for f in c.to_pylist()], pa.list_(pa.int32())) for view, c in zip(shared.value, (t, p), strict=True)]
        return pa.StructArray.from_arrays(found, list(_VIEWS))

    return sorted(rows.select("h", "y", "w", "who", numbers(*_VIEWS).alias("k")).collect(), key=lambda r: (r.h, r.w))


def _logits(inputs: DataFrame, views: list[View]) -> DataFrame:
    """id, x, h and the logits z_t and z_p of all rows."""
    shared = inputs.sparkSession.sparkContext.broadcast(views)

    @F.arrow_udf("struct<z_t:double,z_p:double>")
    def rate(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        t, p = shared.value
        z_t = pa.array([t.logit(text_features(x)) for x, in each(texts)], pa.float64())
        z_p = pa.array([p.logit(page_features(*x)) for x in each(sources, langs, sizes)], pa.float64())
        return pa.StructArray.from_arrays([z_t, z_p], ["z_t", "z_p"])

    return inputs.select("id", "x", "h", rate("text", *_META).alias("z")).select("id", "x", "h", "z.*")


def _surest(rated: DataFrame, z: Column, told: DataFrame | None, most: int) -> DataFrame:
    """h of the rows with the largest z, at least that of SURE; one of each text, and none that was told before."""
    fresh = rated.where(z >= float(np.log(SURE / (1 - SURE)))).groupBy("x").agg(F.max(F.round(z, 9)).alias("z"), F.min("h").alias("h"))
    if told is not None:
        fresh = fresh.join(told.select("x").distinct(), "x", "left_anti")
    return fresh.orderBy(F.desc("z"), "h").limit(most).select("h", "x")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_labelled: int = MAX_LABELLED, max_given: int = MAX_GIVEN, rounds: int = ROUNDS) -> CoTrained | None:
    """docs: id, text, source, lang, n_chars. labels: id, quality, toxic."""
    put = Scratch(docs.sparkSession, "quality")
    inputs = _inputs(docs, id_col)
    known = labels.where("quality is not null and toxic is not null").where(F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("y"))
    chosen = inputs.select("id", "h").join(known, "id").dropDuplicates(["h"]).orderBy("h", "id").limit(max_labelled)
    rows = inputs.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["h"])  # no more rows are broadcast than the bound says
    own = put.keep(_with_features(rows.withColumn("w", F.lit(1.0)).withColumn("who", F.lit("tp")), "h", "x", "y", "w", "who"), "labelled")
    apart = F.pmod("h", F.lit(4)) == 3
    kinds = {(r.apart, r.y) for r in own.select(apart.alias("apart"), "y").distinct().collect()}
    if len({y for _, y in kinds}) < 2:
        put.drop(own)
        return None
    mine, held = (own.where(~apart), own.where(apart)) if len(kinds) == 4 else (own, own)
    told = None
    for r in range(rounds + 1):
        views = _learn(mine if told is None else mine.unionByName(told))
        if r == rounds:
            break
        rated = put.keep(_logits(inputs, views).join(known.select("id"), "id", "left_anti"), "rated")
        parts = []
        for v, other in zip(_VIEWS, reversed(_VIEWS), strict=True):
            before = None if told is None else told.where(F.col("who") == other)
            for z, y in ((-F.col(f"z_{v}"), 0), (F.col(f"z_{v}"), 1)):
                parts.append(_surest(rated, z, before, max_given).select("h", F.lit(y).alias("y"), F.lit(other).alias("who")))
        new = put.keep(reduce(DataFrame.unionAll, parts), "given")  # at most 4 * max_given rows
        found = inputs.join(F.broadcast(new), "h").dropDuplicates(["h", "who", "y"]).withColumn("w", F.lit(0.5))
        more = _with_features(found, "h", "x", "y", "w", "who")
        told = put.keep(more if told is None else told.unionByName(more), "told")
        put.drop(rated)
    got = _numbers(held, views)
    y = np.array([r.y for r in got], float)
    z = [view.logits(matrix([r.k[v] for r in got], len(view.vocab))) for v, view in zip(_VIEWS, views, strict=True)]
    one = np.ones(len(y))
    scale = np.concatenate([_fit(x[:, None], y, one, 1e-2) for x in z])
    join = _fit(np.stack([scale[0] * z[0] + scale[1], scale[2] * z[1] + scale[3]], 1), y, one, 1e-2)
    put.drop(own, told)
    return CoTrained(views[0], views[1], scale, join)


def _meta(docs: DataFrame) -> list[Column]:
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast("bigint" if c == "n_chars" else "string") for c in _META]


def _free(docs: DataFrame) -> str:
    """A name longer than that of any column."""
    return "_" * (1 + max(map(len, docs.columns)))


def accept(docs: DataFrame, model: CoTrained | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a probability of the threshold or more, with their columns as they are, in one pass without a
    shuffle."""
    names = tuple(f"{_free(docs)}{v}" for v in ("good", *_VIEWS))
    return score(docs, model, names).where(F.col(names[0]) >= threshold).select(docs.columns)


def score(docs: DataFrame, model: CoTrained | None, names: tuple[str, str, str] = ("p_good", "p_text", "p_page")) -> DataFrame:
    """docs with the probabilities by both views, by the text, by the page."""
    kept = [c for c in docs.columns if c not in names]
    if model is None:
        return docs.select(*kept, *(F.lit(0.5).alias(c) for c in names))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<a:double,b:double,c:double>")
    def rate(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        m = shared.value
        got = np.array([m.score(t or "", *x) for t, *x in each(texts, sources, langs, sizes)]).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(got[:, k].copy()) for k in range(3)], ["a", "b", "c"])

    p = _free(docs)
    rated = docs.withColumn(p, rate(F.col("text").cast("string"), *_meta(docs)))
    return rated.select(*kept, *(F.col(f"{p}.{c}").alias(n) for c, n in zip("abc", names, strict=True)))
