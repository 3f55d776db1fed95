"""Each operator against a plain version on small inputs with nulls, ties, repeated rows, long and empty texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontam, hamming, langid, linededup, neardup, packing, quality, queries, sharding, suffix, tokens

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make(spark, texts, **cols):
    """Rows of documents with an extra column whose name clashes with inner ones."""
    rows = [(i, t, "en", f"s{(i or 0) % 3}", None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("k")).withColumn("n", F.lit(1)).withColumn("size", F.lit(2))


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    base = [prose(r, 60) for _ in range(12)]
    out = list(enumerate(base)) + [(20 + i, base[i % 4]) for i in range(8)]
    for i in range(6):  # near copies
        w = base[i].split(" ")
        w[10], w[40] = "changed", "other"
        out.append((40 + i, " ".join(w)))
    out += [(60, None), (61, ""), (62, " \n"), (63, "word"), (64, "word"), (65, prose(r, 30_000)), (66, "a" * 700), (67, "a" * 350), (None, base[0]), (None, None), (3, base[3]), (3, base[3])]
    return out


# 10


def test_sharding(spark, texts):
    rows = sharding.shard_documents(make(spark, texts), 5).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for some in by.values():
        assert sorted(r.slot for r in some) == list(range(len(some)))
    want = sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert len({(r.text_crc32, r["size"], r.shard) for r in rows}) == len({(r.text_crc32, r["size"]) for r in rows})


def plain_minimax(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, load = (lo + hi) // 2, 1, 0
        for s in sizes:
            if load + s > mid:
                n, load = n + 1, 0
            load += s
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("seed", range(4))
def test_minimax(spark, seed):
    r = random.Random(seed)
    texts = [(i, "x" * r.choice((1, 5, 50, 400))) for i in range(30)] + [(i, prose(r, r.randrange(1, 80))) for i in range(30, 90)] + [(i, "same") for i in range(100, 140)]
    groups = {}
    for _, t in texts:
        groups[t] = groups.get(t, 0) + len(t.encode()) + 8
    order = sorted(groups, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    rows = sharding.shard_documents(make(spark, texts), 7).collect()
    load = {}
    for x in rows:
        load[x.shard] = load.get(x.shard, 0) + x["size"]
    assert max(load.values()) == plain_minimax([groups[t] for t in order], 7)


def test_even_cuts():
    at = [0, *np.cumsum([10] * 20).tolist()]
    assert [at[j] for j in sharding._even_cuts(at, 50, 4)] == [50, 100, 150]
    at = [0, *np.cumsum([100, *[10] * 20]).tolist()]
    assert [at[j] for j in sharding._even_cuts(at, 100, 5)] == [100, 150, 200, 250]


def test_sharding_empty(spark):
    assert sharding.shard_documents(make(spark, []), 3).count() == 0


# 8


def plain_lines(texts, sites, least):
    seen = {}
    for (_, t), s in zip(texts, sites, strict=True):
        for x in (t or "").split("\n"):
            if x.strip(" "):
                seen.setdefault(x.strip(" "), set()).add(s)
    bad = {x for x, s in seen.items() if len(s) >= least}
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        gone = [x for x in lines if x.strip(" ") in bad]
        if t is None or not gone:
            out.append((i, t, 0))
        else:
            out.append((i, "\n".join(x for x in lines if x.strip(" ") not in bad), len(gone)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    r = random.Random(2)
    texts, sites = [], []
    common = [f"common line {k}" for k in range(8)]
    for i in range(160):
        lines = [prose(r, r.randrange(1, 12)) for _ in range(r.randrange(0, 5))] + [c + r.choice(("", " ")) for k, c in enumerate(common) if r.random() < 0.08 * (k + 1)] + [""]
        r.shuffle(lines)
        texts.append((i, "\n".join(lines)))
        sites.append(r.choice([None, *(f"site{k}" for k in range(14))]))
    texts += [(500, None), (501, ""), (502, common[7]), (503, common[7]), (7, texts[7][1])]
    sites += ["x", "y", "z", "z", sites[7]]
    df = spark.createDataFrame([(i, t, s, "extra", 5) for (i, t), s in zip(texts, sites, strict=True)], "doc_id bigint, text string, source string, h string, n_lines bigint")
    for least in (4, 10, 13):
        got = sorted(((x.doc_id, x.text, x.n_removed) for x in linededup.dedup_lines(df, min_sites=least).collect()), key=repr)
        assert got == plain_lines(texts, sites, least)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_exempts_no_document(spark, tmp_path):
    """The query and the stage take shared lines out of documents that hold little or nothing else."""
    import corpus_pipeline
    from sparkloom.llm import queries

    shared = "a long line that stands on every one of the sites"
    texts = [(i, f"{shared}\nown {i}") for i in range(10)] + [(10, shared), (11, f" {shared}\n{shared}"), (12, f"{shared}\n\n"), (13, None), (14, "own")]
    sites = [f"s{i}" for i in range(10)] + ["s0"] * 5
    df = spark.createDataFrame([(i, t, "en", s, None) for (i, t), s in zip(texts, sites, strict=True)], DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_lines(texts, sites, 10)
    got = queries.op8_line_dedup(spark, str(tmp_path)).collect()
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    assert sorted(((r.doc_id, r.kept_md5, r.n_removed) for r in got), key=repr) == sorted(((i, md5(t), n) for i, t, n in want), key=repr)
    assert sum(r.n_removed for r in got) == 14
    after = corpus_pipeline.line_stage(spark, df, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in after), key=repr) == [(i, t) for i, t, _ in want]


# 5


def plain_components(texts, size, percent):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                comp[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(texts):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, len(s), least.get(find(a), i)) for a, ((i, _), s) in enumerate(zip(texts, sets, strict=True))), key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, texts, size):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.components(make(spark, texts), size).collect()), key=repr)
    assert got == plain_components(texts, size, 80)


def test_bands_mix_permutations(monkeypatch):
    """Smallest and largest value of each permutation go into different bands."""
    s = neardup.shingles(" ".join(f"w{i}" for i in range(50)), 2)
    before = neardup.keys(s)
    for p in range(neardup.PERMS):
        xor = neardup._XOR.copy()
        xor[p] ^= np.uint64(0x123456789ABCDEF)
        monkeypatch.setattr(neardup, "_XOR", xor)
        after = neardup.keys(s)
        monkeypatch.undo()
        assert (before != after).sum() == 2, p


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """A family in which most links are not with the first document; buckets dealt to several tasks."""
    monkeypatch.setattr(neardup, "DEAL", 4)
    monkeypatch.setattr(neardup, "SMALL", 3)
    r = random.Random(4)
    words = prose(r, 120).split(" ")
    texts = []
    for i in range(60):
        w = list(words)
        for _ in range(r.randrange(0, 22)):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        texts.append((i, " ".join(w)))
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in neardup.components(make(spark, texts), 2).collect()), key=repr)
    assert got == plain_components(texts, 2, 80)
    assert len({c for _, _, c in got}) > 1


def test_near_duplicates_chain(spark):
    """a - b - c are linked in a chain only; components still are whole."""
    w = [f"w{i}" for i in range(100)]
    texts = [(i, " ".join(w[4 * i :] + [f"n{k}" for k in range(4 * i)])) for i in range(12)]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in neardup.components(make(spark, texts), 2).collect()), key=repr)
    assert got == plain_components(texts, 2, 80)


@pytest.mark.parametrize("small", [0, 100])
def test_contract(spark, monkeypatch, small):
    from sparkloom.llm.common import Scratch

    monkeypatch.setattr(neardup, "SMALL_GRAPH", small)
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (7, 9), (30, 2), (30, 7), (50, 51), (51, 51)], "a bigint, b bigint")
    want = dict.fromkeys((2, 3, 4, 5, 7, 8, 9, 30), 2) | {50: 50, 51: 50}
    assert {r.v: r.comp for r in neardup.contract(Scratch(spark, "t"), edges).collect()} == want
    assert neardup.contract(Scratch(spark, "t"), edges.limit(0)) is None


@pytest.mark.parametrize("shuffled", [False, True])
def test_contract_long_chain(spark, monkeypatch, shuffled):
    """A chain of 5,000 in logarithmically many rounds, also without the last step in one task."""
    from sparkloom.llm.common import Scratch

    monkeypatch.setattr(neardup, "SMALL_GRAPH", 0)
    names = list(range(5000))
    if shuffled:
        random.Random(1).shuffle(names)
    put = Scratch(spark, "t")
    made: list[str] = []
    keep = put.keep
    monkeypatch.setattr(put, "keep", lambda df, name="t": (made.append(name), keep(df, name))[1])
    found = neardup.contract(put, spark.createDataFrame(list(zip(names, names[1:])), "a bigint, b bigint"))
    assert {r.comp for r in found.collect()} == {0} and found.count() == 5000
    assert made.count("edges") <= 15 and made.count("parents") <= 15 * 3


def test_rarest_shingles_are_shared(spark):
    """Any two linked sets share one of their rarest shingles."""
    from sparkloom.llm.common import Scratch

    r = np.random.default_rng(1)
    base = r.integers(1, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(1, 60), False), r.integers(1, 2**63, r.integers(0, 8)).astype(np.uint64)])) for _ in range(150)]
    frame = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "id bigint, set binary")
    rare = {}
    for x in neardup._rare(Scratch(spark, "t"), frame, 80).collect():
        rare.setdefault(x.id, set()).add(x.token)
    linked = [(i, j) for i in range(150) for j in range(i) if neardup._linked(sets[i], sets[j], 80)]
    assert len(linked) > 20
    for i, j in linked:
        both = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and rare[i] & rare[j]


def test_rarest_shingles_by_place(spark):
    """Sets with many rare shingles of their own are paired with no set of the same template; no linked pair goes."""
    from sparkloom.llm.common import Scratch

    r = np.random.default_rng(2)
    base = r.integers(1, 2**63, 200).astype(np.uint64)
    own = [8] * 40 + [30] * 40  # 30 of 200: what is left in common is too little for a link
    sets = [np.unique(np.concatenate([r.choice(base, 200 - n, False), r.integers(1, 2**63, n).astype(np.uint64)])) for n in own]
    linked = {(i, j) for j in range(80) for i in range(j) if neardup._linked(sets[i], sets[j], 80)}
    assert len(linked) > 300
    frame = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "id bigint, set binary")
    rare = neardup._rare(Scratch(spark, "t"), frame, 80).withColumnRenamed("token", "key").withColumn("m", F.lit(9)).withColumn("comp", F.col("id"))
    found = {(x.a, x.b) for x in neardup._pairs(rare, 80).collect()}
    assert linked <= found and all(j < 40 for _, j in found)
    assert any(j >= 40 for _, j in ((x.a, x.b) for x in neardup._pairs(rare.drop("at"), 80).collect()))


@pytest.mark.parametrize("deal", [4, 1000])
def test_frequent_keys_are_dealt(spark, monkeypatch, deal):
    """Each row is found once, and learns its salt from a table of fixed size, with frequent keys or without."""
    monkeypatch.setattr(neardup, "DEAL", deal)
    monkeypatch.setattr(neardup, "DEALT", 3)
    rows = [(key, 100 * key + k) for key in range(-6, 6) for k in range(1 + 5 * (key % 4))]
    size = Counter(key for key, _ in rows)
    frame = spark.createDataFrame([(key, n, 100 * key) for key, n in size.items() if n > 1], "key bigint, m bigint, pivot bigint")
    got = neardup._with_counts(spark.createDataFrame(rows, "key bigint, id bigint"), frame).select("key", "id", "m", "pivot")
    assert "LeftOuter" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((key, i, size[key], 100 * key) for key, i in rows if size[key] > 1)


def test_word_caches_go_when_a_task_ends(spark, texts):
    """A worker lives on for other stages, idle or not."""
    docs = make(spark, texts)
    neardup.sketch(docs, 2, "doc_id", "text").collect()
    decontam.overlaps(docs, docs.where("doc_id < 3").select(F.col("doc_id").alias("item_id"), "text")).collect()

    def held(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [len(neardup._words) + len(decontam._words)]}) for _ in batches)

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n bigint").collect()} == {0}


def test_near_duplicates_empty(spark):
    assert neardup.components(make(spark, []), 5).count() == 0
    assert {r.component_id for r in neardup.components(make(spark, [(1, None), (2, "")]), 5).collect()} == {1, 2}


# 3


def plain_repeats(texts):
    seen, out = {}, {}
    for i, t in sorted({(i if i is not None else 10**20, t or "") for i, t in texts}):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen[b[k : k + 100]] = 1
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *out[i if i is not None else 10**20]) for i, _ in texts), key=repr)


def suffix_texts():
    r = random.Random(1)
    base = "".join(r.choice("abcdefgh é") for _ in range(4000))
    return [
        (0, base), (1, base[:150] + "X" + base[150:400]), (2, "a" * 500), (3, None), (4, ""), (5, base[99:198]), (6, base[99:199]), (7, "a" * 99), (8, "a" * 100), (9, "ab" * 300),
        (10, base[1000:1300] + base[1000:1300]), (11, base[0:120] + "zz" + base[3000:3250] + "é" * 60), (12, base), (0, base), (None, base[500:800]), (2**63 - 1, base[600:900]), *((100 + i, prose(r, 20) + base[2000:2130] + prose(r, 20)) for i in range(40)),
    ]


def test_repeats(spark):
    texts = suffix_texts()
    got = sorted((tuple(r) for r in suffix.remove_repeats(make(spark, texts)).collect()), key=repr)
    assert got == plain_repeats(texts)


@pytest.mark.parametrize("share", [1, 1000])
def test_repeats_small_blocks(spark, monkeypatch, share):
    """Texts in many chunks, blocks of few anchors, anchors larger than a block, and all anchors taken as frequent."""
    for name, value in (("CHUNK", 300), ("BLOCK", 900), ("DOCS", 5), ("HOT_SHARE", share), ("HOT_LEAST", 3)):
        monkeypatch.setattr(suffix, name, value)
    texts = suffix_texts()
    got = sorted((tuple(r) for r in suffix.remove_repeats(make(spark, texts)).collect()), key=repr)
    assert got == plain_repeats(texts)


def test_names_in_batches():
    """Names come out the same however the sorted rows are cut into batches."""
    import pyarrow as pa

    r = random.Random(3)
    rows = sorted({(r.randrange(1, 9), r.randrange(4), r.randrange(50), r.randrange(50) << 2) for _ in range(120)} | {(20, 1, 1, 4), (21, 1, 1, 4), (22, 5, 1, 4), (22, 6, 1, 8)})
    want = []
    for key, around, i, place in rows:
        arounds = [x for x in rows if x[0] == key]
        kind = suffix.SEEN if (key, around, i, place) != min(x for x in arounds if x[1] == around) else suffix.OPEN if len({x[1] for x in arounds}) > 1 else 0
        want += [(key, around, i, place | kind)] if kind else []
    for size in (1, 2, 3, 7, 200):
        batches = [pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in rows[p : p + size]], pa.int64()) for k in range(4)), pa.array([False] * len(rows[p : p + size]))], names=["key", "around", "id", "place", "hot"]) for p in range(0, len(rows), size)]
        got = [tuple(x.values()) for b in suffix._second_names(iter(batches)) for x in b.to_pylist()]
        assert sorted(got) == want, size


def test_suffix_ranks():
    r = np.random.default_rng(3)
    for n in (*range(1, 40), 500):
        for k in (1, 2, 5):
            t = r.integers(1, k + 1, n)
            got = np.argsort(suffix.suffix_ranks(t, n + 1)).tolist()
            assert got == sorted(range(n), key=lambda i, t=t: t[i:].tolist())


def test_repeats_empty(spark):
    assert suffix.remove_repeats(make(spark, [])).count() == 0


# 2


def test_top_k(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 64))
    v[200:240] = v[7]  # one very common vector
    v[240:260] = v[0] + r.normal(size=(20, 64)) * 0.2
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (None, v[1].tolist()), (7, v[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("bound", F.lit("clash"))
    df = df.select("*", hamming.sign_code("embedding").alias("code"))
    for every, k in ((50, 10), (7, 3)):
        got = sorted(map(tuple, hamming.top_k(df, F.col("vec_id") % every == 0, k).collect()))
        bits = v > 0
        want = []
        for q in range(0, 300, every):
            d = (bits != bits[q]).sum(axis=1)
            near = sorted((int(d[j]), j) for j in range(300) if j != q)[:k]
            want += [(q, n + 1, j, x) for n, (x, j) in enumerate(near)]
        assert got == want


def test_top_k_few(spark):
    df = spark.createDataFrame([(0, 5), (1, 7), (50, 5)], "vec_id bigint, code bigint")
    assert sorted(map(tuple, hamming.top_k(df, F.col("vec_id") % 50 == 0, 10).collect())) == [(0, 1, 50, 0), (0, 2, 1, 1), (50, 1, 0, 0), (50, 2, 1, 1)]
    assert hamming.top_k(df.limit(0), F.lit(True), 3).count() == 0


# 7


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


TRICKY = [
    "", " ", "  a   b", "▁a ▁", "<s> hi </s> <unk> <0x0A>", "日本語テキスト 漢字", "\x00\x01 a", "a" * 40, "a\n\n  \n b", "1234567890 12 3", "😀 x", " " * 40 + "x", "    def f(x):\n        return x\n" * 3,
    "the " * 50, "==========----------====", "İıẞ", "internationalization antidisestablishmentarianism",
]


def test_prefix_counts(model, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    c = tokens.PrefixCounter(model)
    r = random.Random(3)
    texts = TRICKY + ["".join(r.choice("abcdefghi ▁ 01.,\n\téü") for _ in range(60)) for _ in range(60)] + ["".join(r.choice("aab ") for _ in range(50)) for _ in range(40)]
    for t in texts:
        assert c.prefixes(t) == [len(sp.encode(t[:i])) for i in range(len(t) + 1)], t
    want = [len(sp.encode(t)) for t in texts] + [0]
    assert [tokens.total(x) for x in c.rows([*texts, None])] == want == [tokens.total(x) for x in tokens.PrefixCounter(model).rows([*texts, None])]
    for name, value in (("CACHE", 5), ("TOTALS", 5), ("CACHE_CHARS", 3), ("TOGETHER", 50)):
        monkeypatch.setattr(tokens, name, value)
    small = tokens.PrefixCounter(model)
    assert [tokens.total(x) for x in small.rows([*texts, None])] == want and len(small) <= 60
    some = tokens.WordCounter(model)
    assert [n for n, _ in some.measure([*texts, None], 10**6)] == want and len(some.totals) <= 60


def plain_cuts(counts, budget):
    out, at = [], 0
    while at < len(counts) - 1 or not out:
        end = max((i for i in range(at + 1, len(counts)) if counts[i] - counts[at] <= budget), default=min(at + 1, len(counts) - 1))
        out.append((end - at, counts[end] - counts[at]))
        at = end
    return out


def test_cuts(model):
    c, library = tokens.PrefixCounter(model), tokens.WordCounter(model)
    assert [n for n, _ in library.measure([*TRICKY, None], 3)] == [c.prefixes(t)[-1] for t in TRICKY] + [0]
    r = random.Random(5)
    for t in TRICKY + ["".join(r.choice("abcdefghi  .,\néü日") for _ in range(80)) for _ in range(60)]:
        row = next(c.rows([t]))
        for budget in (3, 6, 7, 10, 30):
            got = tokens.cuts(row, budget)
            assert got == plain_cuts(c.prefixes(t), budget), (t, budget)
            assert next(library.measure([t], budget)) == (tokens.total(row), got)
            assert sum(n for n, _ in got) == len(t) and sum(n for _, n in got) == tokens.total(row) and (budget < 6 or max(n for _, n in got) <= budget)


def test_token_frames(spark, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    df = make(spark, [*enumerate(TRICKY), (99, None), (98, "word " * 30_000), (98, "word " * 30_000), (None, "a b")]).withColumn("n_tokens", F.lit("clash"))
    rows = tokens.count_tokens(df, model).collect()
    assert len(rows) == len(TRICKY) + 4
    assert all(r.n_tokens == len(sp.encode(r.text or "")) and len(r.prefix_row) == len(r.text or "") for r in rows)
    for r in tokens.truncate(tokens.read_rows(tokens.prefix_rows(df.where("doc_id < 90"), model), 4)).collect():
        n = [len(sp.encode(r.text[:i])) for i in range(len(r.text) + 1)]
        assert r.truncated == max((r.text[:i] for i in range(len(r.text) + 1) if n[i] <= 4), key=len)
    assert tokens.count_tokens(df.limit(0), model).count() == 0


def test_tokens_in_one_pass(spark, sf, model):
    """Rows, counts and pieces come from one worker a task, also where a batch holds more texts than a slice."""
    r = random.Random(3)
    some = make(spark, [(i, prose(r, i % 50)) for i in range(600)] + [(None, None), (-1, "")]).repartition(1)
    made = tokens.measured_rows(some, model, 20)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    both = tokens.read_rows(tokens.prefix_rows(some, model), 20).select(made.columns)
    assert sorted(map(repr, made.collect())) == sorted(map(repr, both.collect()))
    assert queries.op7_token_counts(spark, sf)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_token_query(spark, sf, model):
    """Every document's count against the library."""
    import sentencepiece

    from sparkloom.llm import queries

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    larger = sf.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op7_token_counts(spark, larger).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)
        assert r.chars_within == len(t) if not r.over_limit else len(sp.encode(t[: r.chars_within])) <= 4096 < len(sp.encode(t[: r.chars_within + 40]))


# 9


def plain_padding(lengths, cuts):
    return sum(min(c for c in cuts if c >= x) - x for x in lengths)


def test_best_lengths():
    import itertools

    r = random.Random(1)
    for _ in range(40):
        x = sorted({r.randrange(0, 60) for _ in range(r.randrange(1, 9))})
        n = [r.randrange(1, 9) for _ in x]
        lengths = [a for a, k in zip(x, n, strict=True) for _ in range(k)]
        for k in (1, 2, 3, 5):
            got = packing.best_lengths(np.array(x), np.array(n), k)
            best = min(plain_padding(lengths, [*c, x[-1]]) for m in range(min(k, len(x))) for c in itertools.combinations(x[:-1], m))
            assert len(got) <= k and got[-1] == x[-1] and plain_padding(lengths, got) == best


def plain_pack(rows, max_len, buckets, budget):
    """(bucket_len, sequences), and sequences by bucket, of (id, n) rows."""
    import itertools

    seqs = [(i, k, min(max_len, n - k * max_len)) for i, n in rows for k in range(max(1, -(-n // max_len)))]
    x = sorted({n for _, _, n in seqs})
    lengths = [n for _, _, n in seqs]
    padding = min(plain_padding(lengths, [*c, x[-1]]) for m in range(min(buckets, len(x))) for c in itertools.combinations(x[:-1], m))
    return seqs, padding


def test_pack(spark):
    r = random.Random(1)
    rows = [(i, r.choice((0, 1, 7, 30, 64, 65, 200, 1000))) for i in range(300)] + [(None, 5), (None, 5), (8, None), (9, 30), (9, 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("batch", F.lit("x")).withColumn("u", F.lit("x"))
    out = packing.pack(df, max_len=64, buckets=3, budget=256).collect()
    seqs, padding = plain_pack([(i, n or 0) for i, n in rows], 64, 3, 256)
    assert sorted(((x.doc_id, x.piece, x.n_tokens) for x in out), key=repr) == sorted(seqs, key=repr)
    assert sum(x.padding for x in out) == padding
    batches, sizes = {}, sorted({x.bucket_len for x in out})
    for x in out:
        assert x.bucket_len == min(b for b in sizes if b >= x.n_tokens) and x.padding == x.bucket_len - x.n_tokens
        batches.setdefault((x.bucket_len, x.batch), []).append(x)
    for size in sizes:  # full batches, but for the last one
        some = [batches[size, k] for k in range(sum(b == size for b, _ in batches))]
        fits = max(1, 256 // max(1, size))
        assert [len(b) for b in some[:-1]] == [fits] * (len(some) - 1) and len(some[-1]) <= fits
        assert all(sorted(x.slot for x in b) == list(range(len(b))) for b in some)
    assert packing.pack(df.limit(0)).count() == 0


def test_pack_by_prefix_counts(spark, model):
    """Pieces cover the texts, and hold as many tokens as the prefix counts say."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [(1, "the cat sat on the mat " * 40), (2, "日本語テキスト " * 30), (3, ""), (4, None), (5, "a" * 300), (None, "some words here"), (None, "some words here")]
    counted = tokens.measure(make(spark, texts), model, 32)
    assert sorted(map(str, counted.select("text", "n_tokens", "pieces").collect())) == sorted(map(str, tokens.read_rows(tokens.prefix_rows(make(spark, texts), model), 32).select("text", "n_tokens", "pieces").collect()))
    out = packing.pack(counted, max_len=32, pieces_col="pieces", budget=128).collect()
    for i, t in texts[:5]:
        mine = sorted((x for x in out if x.doc_id == i), key=lambda x: x.piece)
        assert [x.piece for x in mine] == list(range(len(mine))) and sum(x.n_tokens for x in mine) == len(sp.encode(t or ""))
        at = 0
        for x in mine:
            assert x.first_char == at and x.n_tokens <= 32
            at += x.n_chars
            assert len(sp.encode((t or "")[:at])) == sum(y.n_tokens for y in mine[: x.piece + 1])
        assert at == len(t or "")
    assert sum(x.doc_id is None for x in out) == 2


# 4


def patterns(n, wrong):
    import itertools

    return (sum(1 << i for i in range(n) if i not in c) for c in itertools.combinations(range(n), wrong))


def test_masks_hit_every_overlap():
    """Also of overlaps that an end of the document cuts off, and of unbroken runs."""
    masks = [(int(m[::-1], 2), len(m)) for m in decontam.MASKS]
    hit = lambda p, n: any(p >> k & m == m for m, size in masks for k in range(n - size + 1))
    for n in range(decontam.LEAST_SPACED, decontam.WINDOW + 1):
        for inside in range(decontam.least_same(n), n + 1):
            for p in patterns(inside, inside - decontam.least_same(n)):
                assert hit(p, inside), (n, inside, bin(p))
    assert hit((1 << decontam.RUN) - 1, decontam.RUN)


def test_short_masks_hit_every_overlap():
    for n in range(1, decontam.LEAST_SPACED):
        masks = [int(m[::-1], 2) for m in decontam.short_masks(n)]
        assert n - decontam.least_same(n) == (0 if n < decontam.LEAST_TOLERANT else 1 if n < 10 else 2)
        assert max(map(len, (*decontam.MASKS, *decontam.short_masks(n)))) < len(decontam._GAP)
        for p in patterns(n, n - decontam.least_same(n)):
            assert any(p & m == m for m in masks), (n, bin(p))


WORD = r"[^\W\u4e00-\u9fff\u3040-\u30ff\u0e00-\u0e7f]+|(?=\w)[\u4e00-\u9fff\u3040-\u30ff\u0e00-\u0e7f]"


def plain_overlaps(docs, items):
    out = {}
    for i, t in docs:
        w = re.findall(WORD, (t or "").lower())
        for j, s in items:
            v = re.findall(WORD, (s or "").lower())
            n, best = min(20, len(v)), 0
            for shift in range(-len(v), len(w) + 1) if w and v else ():
                same = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(v)]
                if sum(same) >= min(13, -(-8 * n // 10)):
                    most = max(sum(same[k : k + n]) for k in range(len(v) - n + 1))
                    if most >= -(-8 * n // 10) or "1" * 13 in "".join("01"[x] for x in same):
                        best = max(best, most)
            if best:
                out.setdefault(i, {})[j] = best
    return out


def hits_of(docs, bench):
    return {x.doc_id: {h.item_id: h.n_same for h in x.hits} for x in decontam.overlaps(docs, bench).collect() if x.hits}


def test_decontamination(spark):
    r = random.Random(9)
    items = [(k, prose(r, n)) for k, n in enumerate((3, 8, 12, 13, 19, 25, 40, 5, 10, 11))] + [(17, None), (18, ""), (19, "!!")]
    docs = []
    for i in range(160):
        w = prose(r, r.randrange(0, 50)).split(" ") if i % 5 else []
        v = items[r.randrange(10)][1].split(" ")
        a = r.randrange(max(1, len(v) - 12)) if i % 3 else 0
        v = v[a : a + r.choice((13, 16, 20, 40))]
        for _ in range(r.choice((0, 1, 1, 2, 3, 5))):
            v[r.randrange(len(v))] = "changed"
        if i % 7 == 0:
            v = v[1:] if i % 2 else v[:-2]
        at = r.choice((0, len(w), r.randrange(len(w) + 1)))
        docs.append((i, " ".join(w[:at] + v + w[at:]).upper() if i % 2 else ", ".join(w[:at] + v + w[at:])))
    docs += [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1]), (203, prose(r, 20_000) + " " + items[6][1])]
    bench = spark.createDataFrame(items + items[:1], "item_id bigint, text string")
    got = hits_of(make(spark, docs).withColumn("hits", F.lit("clash")), bench)
    want = plain_overlaps(docs, items)
    assert got == want and len(want) > 60
    assert decontam.overlaps(make(spark, docs), bench).count() == len(docs)
    assert hits_of(make(spark, docs), bench.limit(0)) == {} == hits_of(make(spark, []), bench)
    kept = decontam.clean(make(spark, docs).withColumn("hits", F.lit("clash")), bench)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, _ in docs if i not in want) and kept.columns[-1] == "hits"


def test_decontamination_tolerates_substitutions_in_short_items(spark):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, 13)]
    docs = []
    for n, t in items:
        for k in range(n):
            for m in range(k, n):
                w = t.split()
                w[k] = w[m] = "changed"
                docs.append((len(docs), " ".join(["before", *w, "after"])))
    got = hits_of(make(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert got == plain_overlaps(docs, items)
    assert {next(iter(h)) for h in got.values()} == set(range(5, 13))


def test_decontamination_without_spaces(spark):
    r = random.Random(5)
    han = ["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(n)) for n in (30, 9, 40)]
    thai = "".join(chr(r.randrange(0x0E01, 0x0E2E)) for _ in range(30))
    changed = han[0][:12] + "X" + han[0][13:]
    items = [(1, han[0]), (2, han[1]), (3, thai)]
    docs = [(1, f"見よ{han[0]}。終"), (2, f"見{changed}終"), (3, f"「{han[1]}」"), (4, han[2]), (5, "x " + thai + thai), (6, f"{han[0][5:20]}")]
    got = hits_of(make(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert got == plain_overlaps(docs, items)
    assert {i: set(h) for i, h in got.items()} == {1: {1}, 2: {1}, 3: {2}, 5: {3}, 6: {1}}


def test_decontamination_with_a_full_filter(spark, monkeypatch):
    """A filter too small for the benchmark lets everything through; the result is the same."""
    monkeypatch.setattr(decontam, "FILTER_LOG2", 7)
    r = random.Random(9)
    items = [(k, prose(r, 15)) for k in range(60)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = make(spark, [(k, f"a b {t} c") for k, t in items])
    assert {i: list(h) for i, h in hits_of(docs, bench).items()} == {k: [k] for k in range(60)}


def test_decontamination_with_a_template(spark):
    """A prompt that all items share makes a text that has it a hit for each of them."""
    r = random.Random(9)
    template = prose(r, 14)
    items = [(k, f"{template} {prose(r, 12)}") for k in range(300)]
    docs = [(k, f"{prose(r, 30)} {template} {prose(r, 30)}") for k in range(30)] + [(99, prose(r, 60))]
    got = hits_of(make(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {i: len(h) for i, h in got.items()} == dict.fromkeys(range(30), 300)


# 1


def test_languages(spark):
    r = random.Random(1)
    syllables = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ein", "ung", "ber"], "zz": ["éa", "oux", "çe", "ti"]}
    word = lambda lang: "".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(r.choice((3, 20, 80)))), lang if i % 11 else None, lang) for i in range(600) for lang in [r.choice("xyz") * 2]]
    extra = [(9001, None, "xx", ""), (9002, "", "xx", ""), (9003, "123 !! ٣", "yy", ""), (None, "kaloka mitu", "xx", "xx"), (5, rows[5][1], None, rows[5][3])]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string, lang string, truth string").withColumn("score", F.lit("clash"))
    model = langid.train(df.where(~langid.held_out("doc_id")))
    out = langid.identify(df.withColumn("held_out", langid.held_out("doc_id")), model).collect()
    assert len(out) == len(rows) + len(extra)
    for x in out:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1
    assert {x.lang_pred for x in out if x.doc_id in (9001, 9002, 9003)} == {"und"}
    held = [x for x in out if x.held_out and x.truth]
    assert len(held) > 80 and np.mean([x.lang_pred == x.truth for x in held]) > 0.97
    assert {x.lang_pred for x in langid.identify(df, langid.train(df.limit(0))).collect()} == {"und"}


def counted(texts):
    out = {}
    for name, t in texts.items():
        g, n = np.unique(np.concatenate(list(langid.ngrams(t))), return_counts=True)
        out[name] = g, n, int(n.sum())
    return out


def test_filters_name_all_languages():
    f = langid.LanguageFilters.build(counted({"a": "kalo mitu " * 50, "b": "kalo sching " * 50}))
    h = np.concatenate(list(langid.ngrams("kalo mitu sching")))
    mask = np.bitwise_and.reduce([f.cells[c] for c in langid._cells(h)])
    assert {int(m) for m in mask[:, 0]} >= {1, 2, 3} and (f.chance < 0.01).all()


def test_many_languages():
    r = random.Random(2)
    texts = {f"l{k:03d}": " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)) for k in range(150)}
    f = langid.LanguageFilters.build(counted({k: t + " " for k, t in texts.items()}))
    assert f.cells.shape[1] == 3
    assert np.mean([f.predict(t)[0] == k for k, t in texts.items()]) > 0.95


def test_letters():
    """A letter is a character of general category L."""
    import unicodedata

    f = langid.LanguageFilters.build(counted({"a": "kalo mitu " * 50}))
    for t in ("½ ²", "①②③", "Ⅷ", "٣ ৪", "_ ! 5", "〇", " \n", "\u0301"):
        assert f.predict(t) == ("und", 0.0), t
    for t in ("ª", "ʰ", "ǅ", "漢", "½ x", "Ⅷa"):
        assert f.predict(t)[0] == "a", t
    r = random.Random(6)
    for _ in range(300):
        t = "".join(chr(r.choice((r.randrange(32, 0x2FF), r.randrange(0x300, 0xD800), r.randrange(0xE000, 0x20000)))) for _ in range(r.randrange(1, 4)))
        assert bool(langid.letters(t)) == any(unicodedata.category(c)[0] == "L" for c in t.lower()), t


def test_ngrams_in_pieces(monkeypatch):
    t = " ".join("abc defg hij klmno".split() * 50)
    whole = sum(len(g) for g in langid.ngrams(t))
    monkeypatch.setattr(langid, "PIECE", 64)
    parts = list(langid.ngrams(t))
    assert len(parts) > 10 and set(np.concatenate(parts)) <= {int(h) for h in np.concatenate(list(langid.ngrams(f"{t} ")))}
    assert 0.8 * whole < sum(map(len, parts)) <= whole + 6 * len(parts)
    assert len(list(langid.ngrams("a" * 200))) == 4


def test_language_sample(spark):
    """The sample is bounded, and the same in any order of the rows."""
    r = random.Random(8)
    rows = [(None if i % 2 else i, f"{prose(r, 5)} {i}", "xx" if i % 3 else "yy") for i in range(200)]
    ddl = "doc_id bigint, text string, lang string"
    a = langid.train(spark.createDataFrame(rows, ddl), max_docs=40)
    b = langid.train(spark.createDataFrame(rows[::-1], ddl).repartition(7), max_docs=40)
    assert a.langs == b.langs == ["xx", "yy"] and (a.cells == b.cells).all()
    c = langid.train(spark.createDataFrame(rows, ddl), max_docs=400)
    assert (a.cells != c.cells).any()


# 6


def quality_rows(r, n):
    rows, labels = [], []
    for i in range(n):
        kind = r.choice(("good", "good", "good", "caps", "toxic"))
        w = prose(r, r.randrange(10, 90)).split(" ")
        if kind == "toxic":
            w[r.randrange(len(w))] = r.choice(("vile", "nasty"))
        text = " ".join(w) if kind != "caps" else "!! ".join(w).upper()
        rows.append((i, text, "en", r.choice(("a", "b")) if kind != "caps" else r.choice(("a", "junk")), len(text)))
        labels.append((i, int(kind != "caps"), int(kind == "toxic")))
    return rows, labels


def test_quality(spark):
    r = random.Random(3)
    rows, labels = quality_rows(r, 1200)
    docs = spark.createDataFrame([*rows, (5000, None, None, None, None), (5001, "", "en", "a", 0), (None, "word", None, None, 1), rows[0]], DOCS).withColumn("p_text", F.lit("clash"))
    known = spark.createDataFrame([*labels[:800], (5000, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, known)
    out = {x.doc_id: x.p_good for x in quality.score(docs, model).collect()}
    assert quality.score(docs, model).count() == 1204
    right = np.mean([(out[i] >= 0.5) == (q == 1 and not t) for i, q, t in labels[800:]])
    clean = np.mean([out[i] >= 0.5 for i, q, t in labels[800:] if q and not t])
    assert right > 0.95 and clean > 0.99
    none = quality.score(docs, quality.train(docs, known.limit(0)))
    assert {x.p_good for x in none.collect()} == {0.5}


def plain_co_training(docs, labels, max_labelled, max_given, rounds, hash_of):
    """The method as its docstring has it, over lists; hash_of gives the engine's hashes by id and text."""
    known = {}
    for i, q, t in labels:
        if None not in (i, q, t):
            known[i] = min(known.get(i, 1), int(q == 1 and t == 0))
    own = sorted({(hash_of[i, t or ""], i, t or "", s, x, n) for i, t, x, s, n in docs if i in known})[:max_labelled]
    feats = {d: (quality.text_features(d[2]), quality.page_features(d[3], d[4], d[5])) for d in own}
    mine, held = [d for d in own if d[0] % 4 != 3], [d for d in own if d[0] % 4 == 3]
    told = [{}, {}]
    for r in range(rounds + 1):
        views = []
        for v in range(2):
            rows = sorted([(d[0], 1.0, d, known[d[1]]) for d in mine] + [(d[0], 0.5, d, y) for d, y in told[v].items()], key=lambda x: x[:2])
            n1, n0 = sum(y for *_, y in rows), sum(1 - y for *_, y in rows)
            counts = {}
            for _, _, d, y in rows:
                for f in feats[d][v]:
                    counts.setdefault(f, [0, 0])[y] += 1
            z = {}
            for f, (b, a) in counts.items():
                if a + b >= quality.LEAST_DOCS:
                    p = (a + b) / (n1 + n0)
                    z[f] = round((b / n0 - a / n1) / max(1e-12, p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5, 9)
            vocab = {f: k for k, f in enumerate(sorted((f for f in z if z[f] >= quality.LEAST_Z), key=lambda f: (-z[f], f))[: quality.MOST_WORDS])}
            x = np.array([[float(f in feats[d][v]) for f in vocab] for _, _, d, _ in rows]).reshape(len(rows), len(vocab))
            views.append((vocab, quality._fit(x, np.array([y for *_, y in rows], float), np.array([w for _, w, *_ in rows]))))
        logit = lambda d, v: views[v][1][-1] + sum(views[v][1][k] for f, k in views[v][0].items() if f in feats[d][v])  # noqa: E731, B023
        if r == rounds:
            break
        free = {(hash_of[i, t or ""], i, t or "", s, x, n) for i, t, x, s, n in docs if i not in known}
        feats |= {d: (quality.text_features(d[2]), quality.page_features(d[3], d[4], d[5])) for d in free}
        for v in range(2):
            new = {}
            for sign, y in ((-1, 0), (1, 1)):
                by_text = {}
                for d in free:
                    if sign * logit(d, v) >= np.log(quality.SURE / (1 - quality.SURE)) and d[2] not in {e[2] for e in told[1 - v]}:
                        by_text.setdefault(d[2], []).append(d)
                ranked = sorted((-max(round(sign * logit(d, v), 9) for d in ds), min(ds)) for ds in by_text.values())
                new |= {d: y for _, d in ranked[:max_given]}
            told[1 - v] |= new
    y = np.array([known[d[1]] for d in held], float)
    zs = [np.array([logit(d, v) for d in held]) for v in range(2)]
    one = np.ones(len(held))
    scale = np.concatenate([quality._fit(z[:, None], y, one, 1e-2) for z in zs])
    join = quality._fit(np.stack([scale[0] * zs[0] + scale[1], scale[2] * zs[1] + scale[3]], 1), y, one, 1e-2)
    out = {}
    for i, t, x, s, n in docs:
        fs = quality.text_features(t or ""), quality.page_features(s, x, n)
        a, b = (scale[2 * v] * (views[v][1][-1] + sum(views[v][1][k] for f, k in views[v][0].items() if f in fs[v])) + scale[2 * v + 1] for v in range(2))
        out[i, t] = float(quality._p(join[0] * a + join[1] * b + join[2]))
    return out, [len(t) for t in told], [set(v[0]) for v in views]


def test_co_training(spark):
    """Against a plain version, with ties, repeated rows, nulls and labels that contradict each other."""
    r = random.Random(4)
    rows, labels = quality_rows(r, 500)
    rows += [rows[0], rows[3], (9001, rows[450][1], "en", "junk", 7), (9002, None, None, None, None), (None, rows[2][1], "en", "a", 3)]
    labels = labels[:300] + [(5, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    hash_of = {(x.doc_id, x.text): x.h for x in quality._inputs(docs, "doc_id").select(F.col("id").cast("long").alias("doc_id"), "text", "h").collect()}
    want, told, vocab = plain_co_training(rows, labels, 200, 15, 2, hash_of)
    model = quality.train(docs, known, max_labelled=200, max_given=15, rounds=2)
    assert [set(model.text.vocab), set(model.page.vocab)] == vocab and "!!" in vocab[0] and "source=junk" in vocab[1] and min(told) >= 15 and max(told) > 15
    for x in quality.score(docs, model).collect():
        assert abs(x.p_good - want[x.doc_id, x.text]) < 1e-6
    alone = quality.train(docs, known, max_labelled=200, rounds=0)
    assert alone.page.vocab != model.page.vocab or not np.allclose(alone.page.weights, model.page.weights)
