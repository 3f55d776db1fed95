"""Removal of repeated byte strings, by suffix sorting over a content-defined sample.

This is a substitute for a difference-cover sort of all bytes, whose sample of two positions in three does not fit
the disk (figures in the README); the difference-cover algorithm sorts what the sample leaves open.

A byte is removed if a string of WINDOW bytes that covers it also starts earlier, in a smaller document or before in the
same one. Strings are judged on the input.

Sample. Each window of 100 bytes is given to the 32-byte substring in it with the smallest hash (its anchor). Like the
positions of a difference cover, which any two suffixes reach after the same number of steps, equal windows have
equal anchors at equal offsets; only about 3 % of all positions are anchors. So windows need to be compared only if
their anchors are equal, and all that belongs to an anchor can be sent to one place.

Names. Anchors are sorted by 64-bit hashes of their 32 bytes and of all bytes that their windows touch. All windows of an
anchor whose surroundings came before are repeats, which is right up to collisions of these 128 bits; an anchor seen once, or always with the same surroundings, has no other work.
What is left are the first occurrences of different surroundings of one anchor.

Suffix sorting. Their texts are collected by anchor, whole anchors a block, and suffix-sorted by the difference-cover
algorithm: triples at the positions not divisible by three are sorted and named, the names are sorted in the same way
by recursion (until names cover a window), the remaining suffixes are sorted by their first symbol and the rank that
follows, and both are merged. Neighbours in this order that agree in 100 bytes are repeats. A symbol stands for 25
bytes; symbols are ordered by a hash, which serves as well, as only equal neighbours are looked for.

Frequent anchors. Those repeated with the same surroundings within a batch of input are resolved there, before the
shuffle. An anchor that many texts hold (found in one of HOT_SHARE of them) is dealt to tasks by its surroundings too.
A block holds at most BLOCK bytes; the windows of an anchor with more than that are not sorted, but grouped by 128 bits of
hash with partial aggregation. So no task or worker ever holds all rows of an anchor.

Nulls: a null text is empty; rows with a null id count as later than all others, whatever these are. Repeated rows (equal id and text) are one
document and get equal results; different texts of one id are separate documents, in the order of their hashes. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WINDOW, ANCHOR, CHUNK, BLOCK, SYMBOL, DOCS = 100, 32, (1 << 20) - 4096, 1_800_000, 25, 3000
_PLACE = np.uint64((1 << 20) - 1)
_SPAN = WINDOW - ANCHOR  # an anchor begins at most so many bytes behind the start of its window
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TEXTS = 2**29  # hashes of texts are below; rows without an id come last, from here on
HOT_SHARE, HOT_LEAST = 16, 200  # an anchor with so many names in one of so many texts is dealt by its surroundings


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_power, _inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = max(n, 1 << 16)
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        step = np.full(size, _BASE, np.uint64)
        step[0] = 1
        _power = np.multiply.accumulate(step)
        step[1:] = inv
        _inverse = np.multiply.accumulate(step)
    return _power, _inverse


def _anchors_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ANCHOR-byte substrings; then place, first and last window start of each anchor."""
    h, p, base = _BYTE[b], 1, _BASE
    with np.errstate(over="ignore"):
        while p < ANCHOR:
            h = h[:-p] * base + h[p:]
            base = base * base
            p *= 2
        h = _finish(h)
    # the place in the low bits: of equal hashes the first one counts, in equal windows the same one
    m, w = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
    while w < _SPAN + 1:
        s = min(w, _SPAN + 1 - w)
        m = np.minimum(m[s:], m[:-s])
        w += s
    at = (m & _PLACE).astype(np.int64)
    ends = np.flatnonzero(np.diff(at))
    first = np.concatenate([[0], ends + 1])
    return h, at[first], first.astype(np.int64), np.concatenate([ends, [len(at) - 1]]).astype(np.int64)


def anchors(text: bytes, named: bool = True) -> tuple[np.ndarray, ...]:
    """place, first window start, last window start, and if named: key, hash of the surroundings; by place.

    Long texts are taken in chunks; an anchor at a border has its windows put together again.
    """
    n = len(text)
    none = np.empty(0, np.int64)
    if n < WINDOW:
        return (none,) * (5 if named else 3)
    every = []
    for s in range(0, n - WINDOW + 1, CHUNK):
        b = np.frombuffer(text, np.uint8, min(CHUNK + WINDOW - 1, n - s), s)
        h, at, lo, hi = _anchors_of(b)
        every.append((at + s, lo + s, hi + s, h[at].view(np.int64)))
    at, lo, hi, key = (np.concatenate(x) for x in zip(*every, strict=True))
    if len(every) > 1:
        order = np.lexsort((lo, at))
        at, lo, hi, key = at[order], lo[order], hi[order], key[order]
        new = np.concatenate([[True], at[1:] != at[:-1]])
        starts = np.flatnonzero(new)
        at, key, lo, hi = at[starts], key[starts], lo[starts], np.maximum.reduceat(hi, starts)
    if not named:
        return at, lo, hi
    a, z = np.maximum(at - _SPAN, 0), np.minimum(at + WINDOW, n)
    around = np.empty(len(at), np.uint64)
    step = CHUNK
    with np.errstate(over="ignore"):
        for s in range(0, n, step):  # the surroundings that begin in this chunk
            i = np.flatnonzero((a >= s) & (a < s + step))
            if not len(i):
                continue
            b = np.frombuffer(text, np.uint8, min(step + _SPAN + WINDOW, n - s), s)
            up, down = _powers(len(b) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)])])
            part = (total[z[i] - s] - total[a[i] - s]) * down[a[i] - s]
            around[i] = _finish(part + _finish(((at[i] - a[i]) * 1000 + (z[i] - at[i])).astype(np.uint64)))
    return at, lo, hi, key, around.view(np.int64)


def suffix_ranks(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes of t (symbols from 1, below 2**21) in an order that is right for their first `depth` symbols."""
    n = len(t)
    if n < 3:
        order = sorted(range(n), key=lambda i: t[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(n)
        return out
    x = np.concatenate([t, np.zeros(4, np.int64)])
    k = int(x.max()) + 1
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    code = (x[sample] * k + x[sample + 1]) * k + x[sample + 2]
    names, name = np.unique(code, return_inverse=True)
    if len(names) == len(code) or depth <= 3:
        rank = np.empty(len(code), np.int64)
        rank[np.argsort(name, kind="stable")] = np.arange(len(code))
    else:
        rank = suffix_ranks(name.astype(np.int64) + 1, -(-depth // 3))
    r = np.zeros(n + 5, np.int64)
    r[sample] = rank + 1
    m = len(sample) + 2
    own = x[zero] * m + r[zero + 1]
    order = np.argsort(own, kind="stable")
    zero = zero[order]
    before = np.searchsorted(np.sort(x[one] * m + r[one + 1]), own[order])
    before += np.searchsorted(np.sort((x[two] * k + x[two + 1]) * m + r[two + 2]), (x[zero] * k + x[zero + 1]) * m + r[zero + 2])
    at = np.arange(len(zero)) + np.maximum.accumulate(before)  # suffixes alike in `depth` symbols come in any order
    merged = np.empty(len(zero) + len(sample), np.int64)
    rest = np.ones(len(merged), bool)
    rest[at] = False
    merged[at] = zero
    by_rank = np.empty(len(sample), np.int64)
    by_rank[rank] = sample
    merged[rest] = by_rank
    merged = merged[merged < n]
    out = np.empty(n, np.int64)
    out[merged] = np.arange(n)
    return out


def repeated(texts: list[bytes], starts: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Which of the windows beginning at `starts` of the joined texts have an equal one of a smaller order."""
    buf = np.frombuffer(b"".join(texts) + bytes(SYMBOL + 8), np.uint8)
    n = len(buf) - SYMBOL - 7
    h = {1: _BYTE[buf]}
    base, p = _BASE, 1
    with np.errstate(over="ignore"):
        power = {1: base}
        while 2 * p <= SYMBOL:
            h[2 * p] = h[p][:-p] * power[p] + h[p][p:]
            power[2 * p] = power[p] * power[p]
            p *= 2
        v, done = np.zeros(n, np.uint64), 0
        for p in sorted(h, reverse=True):
            if SYMBOL - done >= p:
                v = v * power[p] + h[p][done : done + n]
                done += p
    _, rank = np.unique(v, return_inverse=True)
    rank = rank.astype(np.int64) + 2
    rows = [np.concatenate([rank[j::SYMBOL], [1]]) for j in range(SYMBOL)]  # every suffix once, as a string of symbols
    base = np.cumsum([0, *map(len, rows)])[:SYMBOL]
    place = suffix_ranks(np.concatenate(rows), WINDOW // SYMBOL)
    order = np.argsort(place[base[starts % SYMBOL] + starts // SYMBOL])
    s = starts[order]
    same = np.ones(max(0, len(s) - 1), bool)
    words = np.lib.stride_tricks.sliding_window_view(buf, 8)
    for j in [*range(0, WINDOW - 8, 8), WINDOW - 8]:  # the bytes themselves
        k = np.flatnonzero(same)
        same[k] = (words[s[1:][k] + j] == words[s[:-1][k] + j]).all(axis=1)
    run = np.concatenate([[0], np.cumsum(~same)]) if len(s) else np.empty(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(s) else np.empty(0, np.int64)
    least = np.minimum.reduceat(orders[order], heads) if len(s) else np.empty(0, np.int64)
    out = np.empty(len(s), bool)
    out[order] = orders[order] > least[run] if len(s) else False
    return out


def _runs(flags: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Maximal (first, last) of flagged consecutive starts; starts ascend."""
    s = starts[flags]
    if len(s):
        cut = np.flatnonzero(np.diff(s) != 1)
        yield from zip(s[np.concatenate([[0], cut + 1])].tolist(), s[np.concatenate([cut, [len(s) - 1]])].tolist(), strict=True)


SEEN, OPEN, HOT = 1, 2, 3  # kinds: surroundings came before; to be sorted; the same for very frequent anchors
#: place: t, at and kind in one number
NAMED = pa.schema([("key", pa.int64()), ("around", pa.int64()), ("id", pa.int64()), ("place", pa.int64())])
_KIND = np.int64(3)


def _first_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of (id, t, text); those whose surroundings came before in the same batch are marked."""
    for batch in batches:
        for k in range(0, batch.num_rows, DOCS):
            cols = []
            for i, t, text in zip(*(batch.column(c).slice(k, DOCS).to_pylist() for c in ("id", "t", "text")), strict=True):
                at, _, _, key, around = anchors(text.encode("utf-8", "surrogatepass") if text else b"")
                cols.append((key, around, np.full(len(at), i), (t << 33) + (at << 2)))
            key, around, ids, place = (np.concatenate(x) for x in zip(*cols, strict=True))
            order = np.lexsort((place, ids, around, key))
            key, around, ids, place = (x[order] for x in (key, around, ids, place))
            seen = _after_first(key, around, ids, place)
            place = place | np.where(seen, SEEN, 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.where(seen, 0, key), np.where(seen, 0, around), ids, place)], schema=NAMED)


def _after_first(key: np.ndarray, around: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of sorted rows are later than the first of equal key and surroundings."""
    if not len(key):
        return np.empty(0, bool)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (around[1:] != around[:-1])])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (ids != ids[head]) | (place != place[head])


def _second_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same over all rows (key, around, id, place, hot) of a partition, which come sorted; keeps what was seen
    before and what is open. Of the rows before only the last one and the first of its key are held."""
    last_head = 0, 0
    last_key = last_around = first = None  # first: the first row of the key while its surroundings are the only ones
    for batch in batches:
        key, around, ids, place, hot = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
        done = (place & _KIND) == SEEN  # these were resolved before the shuffle
        if done.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[done]) for c in (key, around, ids, place)], schema=NAMED)
            key, around, ids, place, hot = (c[~done] for c in (key, around, ids, place, hot))
        if not len(key):
            continue
        new_key = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
        new = new_key | np.concatenate([[last_around is None or around[0] != last_around], around[1:] != around[:-1]])
        heads = np.flatnonzero(new)  # the first rows of their surroundings
        group = np.cumsum(new_key[heads])  # 0: the key of the batch before
        more = np.bincount(group, minlength=int(group.max(initial=0)) + 1) > 1
        open_ = hot[heads] | more[group] | (group == 0)
        of = np.cumsum(new)  # equal rows of one document are no repeats of each other: the first stands for all
        head_id, head_place = (np.concatenate([[before], x[heads]])[of] for before, x in zip(last_head, (ids, place), strict=True))
        kind = np.where((ids != head_id) | (place != head_place), SEEN, 0)
        kind[heads] = np.where(open_, OPEN, 0)
        if first is not None and (group == 0).any():
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in first], schema=NAMED)
        if len(heads) and (group > 0).any():
            first = None
            k = int(heads[-1])
            if new_key[k] and not open_[-1]:  # its key may go on in the next batch
                first = (key[k], around[k], ids[k], place[k] | OPEN)
        elif (group == 0).any():
            first = None
        last_key, last_around, last_head = key[-1], around[-1], (head_id[-1], head_place[-1])
        keep = kind != 0
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, around, ids, place | kind)], schema=NAMED)
    # a first row left over was alone


#: what = run: windows first..last of the document repeat; open: text begins at window `first`; hot: text is the hash of
#: window `first`; doc: the text; done: a result
PART = pa.schema([
    ("what", pa.string()), ("id", pa.int64()), ("t", pa.int32()), ("key", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("text", pa.binary()),
    ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
])


def _result(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans, kept_sha256 when the windows first..last repeat."""
    if not len(first):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(last + WINDOW, len(text)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def _joined_runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in ascending order, adjacent ones as one."""
    if not len(lo):
        return lo, hi
    cut = np.flatnonzero(lo[1:] != hi[:-1] + 1)
    return lo[np.concatenate([[0], cut + 1])], hi[np.concatenate([cut, [len(hi) - 1]])]


def _apply_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, t, text, marks: (place, key)) to parts; those without open anchors are done."""
    for batch in batches:
        marks = batch.column("marks")
        ends = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(marks).to_numpy(zero_copy_only=False)))]).astype(np.int64)
        flat = pc.list_flatten(marks)
        place, key = flat.field("place").to_numpy(zero_copy_only=False), flat.field("key").to_numpy(zero_copy_only=False)
        rows: list[dict] = []
        for k, (i, t, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "t", "text")), strict=True)):
            b = text.encode("utf-8", "surrogatepass") if text else b""
            p, q = place[ends[k] : ends[k + 1]], key[ends[k] : ends[k + 1]]
            at, lo, hi = anchors(b, False) if len(p) else (np.empty(0, np.int64),) * 3
            where = (p >> 2) & 0x7FFFFFFF
            seen = (p & _KIND) == SEEN
            was = np.isin(at, where[seen])
            first, last = _joined_runs(lo[was], hi[was])
            if seen.all():
                n, gone, spans, sha = _result(b, first, last)
                rows.append({"what": "done", "id": i, "t": t, "n_bytes": n, "n_removed": gone, "n_spans": spans, "kept_sha256": sha})
            else:
                rows.append({"what": "doc", "id": i, "t": t, "text": b})
                rows += [{"what": "run", "id": i, "t": t, "first": a, "last": z} for a, z in zip(first.tolist(), last.tolist(), strict=True)]
                of, first_of = np.unique(where[~seen], return_index=True)  # equal rows have equal anchors
                m = np.searchsorted(at, of)
                hot = ((p[~seen][first_of] & _KIND) == HOT).tolist()
                for name, c, a, z, h in zip(q[~seen][first_of].tolist(), of.tolist(), lo[m].tolist(), hi[m].tolist(), hot, strict=True):
                    if h:
                        rows += [{"what": "hot", "id": i, "t": t, "first": x, "text": hashlib.blake2b(b[x : x + WINDOW], digest_size=16).digest()} for x in range(a, z + 1)]
                    else:
                        rows.append({"what": "open", "id": i, "t": t, "key": name, "at": c, "first": a, "last": z, "text": b[a : z + WINDOW]})
                    if len(rows) > 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=PART)
                        rows = []
            if len(rows) > 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=PART)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=PART)


RUN = pa.schema([("id", pa.int64()), ("t", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])


Row = tuple[int, int, int, int, int, bytes]


def _sort_block(rows: list[Row]) -> list[tuple[int, int, int, int]]:
    """Runs of repeated windows of rows (id, t, place of the anchor, first window, last window, text)."""
    ids, ts, _, first, last = (np.array([r[k] for r in rows], np.int64) for k in range(5))
    doc = np.unique(np.stack([ids, ts]), axis=1, return_inverse=True)[1].reshape(-1)
    sizes = np.array([len(r[5]) for r in rows])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    count = last - first + 1
    owner = np.repeat(np.arange(len(rows)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    flags = repeated([r[5] for r in rows], base[owner] + inner, (doc[owner] << 32) + first[owner] + inner)
    out = []
    heads = np.cumsum(count) - count
    for k in range(len(rows)):
        f = flags[heads[k] : heads[k] + count[k]]
        if f.any():
            out += [(int(ids[k]), int(ts[k]), a, z) for a, z in _runs(f, first[k] + np.arange(count[k]))]
    return out


def _sort_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, t, at, first, last, text) sorted by key to runs; a block holds whole keys."""
    rows: list[Row] = []
    size, key, start = 0, None, 0  # start: where the rows of this key begin

    def flush(some: list) -> pa.RecordBatch:
        found = _sort_block(some)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], RUN.types[k]) for k in range(4)], schema=RUN)

    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "t", "at", "first", "last", "text")), strict=True):
            if k != key:
                key, start = k, len(rows)
            rows.append(tuple(row))
            size += len(row[5])
            if size > BLOCK - 200 and start:
                yield flush(rows[:start])
                rows, start = rows[start:], 0
                size = sum(len(r[5]) for r in rows)
    if rows:
        yield flush(rows)


def _finish_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([PART.field(c) for c in ("id", "t", "n_bytes", "n_removed", "n_spans", "kept_sha256")])
    for batch in batches:
        rows = []
        for i, t, text, runs in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "text", "runs")), strict=True):
            first = np.array([r["first"] for r in runs or ()], np.int64)
            last = np.array([r["last"] for r in runs or ()], np.int64)
            n, gone, spans, sha = _result(text, first, last)
            rows.append({"id": i, "t": t, "n_bytes": n, "n_removed": gone, "n_spans": spans, "kept_sha256": sha})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _frequent(put: Scratch, ids: DataFrame) -> DataFrame:
    """Keys that occur often in one of HOT_SHARE texts; this only decides how rows are dealt to tasks."""
    some = ids.where(F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(HOT_SHARE)) == 0).mapInArrow(_first_names, "key bigint, around bigint, id bigint, place bigint")
    return put.keep(some.where("key <> 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_LEAST).select("key", F.lit(True).alias("hot")), "frequent")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    put = Scratch(df.sparkSession, "suffix")
    text, given = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    t = F.pmod(F.xxhash64(text), F.lit(_TEXTS)) + F.when(given.isNull(), _TEXTS).otherwise(0)
    ids = df.select(F.coalesce(given, F.lit(2**63 - 1)).alias("id"), t.cast("int").alias("t"), text.alias("text"))
    named = ids.mapInArrow(_first_names, "key bigint, around bigint, id bigint, place bigint")
    named = named.join(_frequent(put, ids), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    by = F.when(F.col("key") == 0, F.xxhash64("id", "place")).when(F.col("hot"), F.xxhash64("key", "around")).otherwise(F.col("key"))
    dealt = named.select("key", "around", "id", "place", "hot").repartition(by).sortWithinPartitions("key", "around", "id", "place")
    marks = put.keep(dealt.mapInArrow(_second_names, "key bigint, around bigint, id bigint, place bigint").select("id", "place", "key"), "names")
    # anchors with more than a block of texts: their windows are grouped one by one instead of sorted together
    is_open = F.col("place").bitwiseAND(F.lit(3)) == OPEN
    full = put.keep(marks.where(is_open).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * (WINDOW + _SPAN) > BLOCK).select("key", F.lit(True).alias("full")), "full")
    split = marks.join(full, "key", "left").withColumn("place", F.when(is_open & F.col("full"), F.col("place").bitwiseOR(F.lit(HOT))).otherwise(F.col("place")))
    by_doc = split.groupBy("id", F.shiftright("place", 33).cast("int").alias("t")).agg(F.collect_list(F.struct("place", "key")).alias("marks"))
    docs = ids.join(by_doc, ["id", "t"], "left").select("id", "t", "text", "marks")
    parts = put.keep(docs.mapInArrow(_apply_names, "what string, id bigint, t int, key bigint, at int, first int, last int, text binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"), "parts")
    put.drop(marks)
    todo = parts.where("what = 'open'").select("key", "id", "t", "at", "first", "last", "text").distinct().repartition("key").sortWithinPartitions("key")
    runs = put.keep(todo.mapInArrow(_sort_open, "id bigint, t int, first int, last int"), "runs")
    every = runs.unionAll(parts.where("what = 'run'").select("id", "t", "first", "last"))
    if not full.isEmpty():
        windows = parts.where("what = 'hot'").select(F.col("text").alias("h"), F.struct("id", "t", "first").alias("w"))
        again = windows.join(windows.groupBy("h").agg(F.min("w").alias("least")), "h").where("w > least")
        every = every.unionAll(again.select("w.id", "w.t", "w.first", F.col("w.first").alias("last")))
    by_doc = every.groupBy("id", "t").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    rest = parts.where("what = 'doc'").select("id", "t", "text").join(by_doc, ["id", "t"], "left").select("id", "t", "text", "runs")
    rest = rest.mapInArrow(_finish_docs, "id bigint, t int, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    out = parts.where("what = 'done'").select(rest.columns).unionAll(rest)
    return out.select(F.when(F.col("t") < _TEXTS, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
