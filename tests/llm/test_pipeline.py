"""The stages of the pipeline, each held against a plain version, and the registered queries on the smallest tables."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from sparkloom.llm import queries  # noqa: E402

from test_operators import plain_components, plain_lines, plain_overlaps  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf):
    """name -> (input rows, output DataFrame), as the pipeline runs them."""
    from sparkloom.llm.common import Scratch

    put, docs, out = Scratch(spark, "test"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = put.keep(stage(spark, docs, sf))
        out[name] = (docs, made)
        docs = made
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_quality_stage(spark, sf, stages):
    before, after = stages["quality classifier"]
    kept = set(ids(after))
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and kept <= set(ids(before))


def test_quality_stage_rejects(spark, sf):
    larger = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    kept = set(ids(corpus_pipeline.quality_stage(spark, docs, larger)))
    labels = spark.read.parquet(f"{larger}/labels.parquet").collect()
    share = lambda some: sum(r.doc_id in kept for r in some) / len(some)
    assert share([r for r in labels if r.quality == 0]) < 0.5
    assert share([r for r in labels if r.quality == 1 and not r.toxic]) > 0.97


def test_line_stage(stages):
    before, after = stages["line dedup"]
    rows = before.collect()
    want = plain_lines([(r.doc_id, r.text) for r in rows], [r.source for r in rows], 10)
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=repr) == [(i, t) for i, t, _ in want]


def test_near_stage(stages):
    before, after = stages["MinHash near-dedup"]
    want = plain_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert ids(after) == sorted(i for i, _, c in want if i == c)


def test_near_stage_odd_ids(spark, sf):
    """One row of each group stays, whether ids are null, repeated or both."""
    w = [f"w{i}" for i in range(60)]
    text, near, other, lone = " ".join(w), " ".join(w[:-1]), " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(None, text), (5, text), (None, near), (7, near), (7, other), (7, other), (None, other), (8, None), (8, None), (None, None), (9, ""), (9, lone), (None, f"z {lone}")]
    rows += [(None, " ".join(f"{c}{i}" for i in range(30 + k))) for c in "ab" for k in (0, 1)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    after = corpus_pipeline.near_stage(spark, docs, sf)
    assert after.columns == docs.columns
    got = [(r.doc_id, r.text) for r in after.collect()]
    named = [x for x in got if x[0] is not None]
    assert sorted(named, key=repr) == sorted([(5, text), (7, other), (8, None), (9, ""), (9, lone)], key=repr)
    assert sorted((t or "-")[0] for i, t in got if i is None) == ["-", "a", "b"]


def test_benchmark_stage(spark, sf, stages):
    before, after = stages["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = plain_overlaps([(r.doc_id, r.text) for r in before.collect()], items)
    assert set(ids(after)) == set(ids(before)) - set(hits)


def test_packing_stage(spark, stages):
    """Every document's tokens, in full pieces and full batches, with the least padding."""
    import numpy as np
    import sentencepiece

    public_tokenizers = pytest.importorskip("public_tokenizers")
    from sparkloom.llm import packing

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before, after = stages["packing"]
    out = after.collect()
    tokens, chars = {}, {}
    for x in out:
        tokens[x.doc_id], chars[x.doc_id] = tokens.get(x.doc_id, 0) + x.n_tokens, chars.get(x.doc_id, 0) + x.n_chars
        assert 0 <= x.n_tokens <= 4096
    rows = before.collect()
    assert tokens == {r.doc_id: len(sp.encode(r.text or "")) for r in rows} and chars == {r.doc_id: len(r.text or "") for r in rows}
    lengths, counts = np.unique([x.n_tokens for x in out], return_counts=True)
    sizes = packing.best_lengths(lengths, counts, packing.BUCKETS)
    assert all(x.bucket_len == min(b for b in sizes if b >= x.n_tokens) and x.padding == x.bucket_len - x.n_tokens for x in out)
    batches = {}
    for x in out:
        batches.setdefault((x.bucket_len, x.batch), []).append(x.slot)
    for (size, k), slots in batches.items():
        fits = max(1, packing.BUDGET // max(1, size))
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= fits and (len(slots) == fits or (size, k + 1) not in batches)


def test_stages_with_odd_rows(spark, sf):
    """Nulls in any column, repeated rows, empty and long texts, an empty table and extra columns with inner names."""
    clash = ["hits", "p_good", "p_text", "p_page", "n_lines", "n_removed", "a", "b", "key", "u", "id", "h", "n_tokens", "pieces", "prefix_row", "component_id"]
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    lone = " ".join(f"w{i}" for i in range(300))
    rows = [(1, lone, "en", "s", 5), (1, lone, "en", "s", 5), (None, None, None, None, None), (None, None, None, None, None), (2, "", None, "s", 0), (3, None, "en", None, 3), (4, "x " * 40_000, "en", "s", None), (5, passage, "en", "s", 9)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = plain.select("*", *(F.lit(c).alias(c) for c in clash))
    key = lambda df: sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=repr)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert all(r[c] == c for r in out.collect() for c in clash), name
        kept[name] = key(out)
        assert kept[name] == key(stage(spark, plain, sf)), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert kept["line dedup"] == sorted(rows, key=repr)
    assert kept["MinHash near-dedup"] == sorted(set(rows), key=repr)
    assert kept["benchmark decontamination"] == sorted(rows[:-1], key=repr)
    assert set(kept["quality classifier"]) >= {rows[0]}
    packed = corpus_pipeline.packing_stage(spark, docs, sf).collect()
    assert len([r for r in packed if r.doc_id is None]) == 2 and len([r for r in packed if r.doc_id == 1]) == 2
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), sf).count() == 0
    short = plain.drop("n_chars")
    assert corpus_pipeline.line_stage(spark, short, sf).columns == short.columns


def test_quality_stage_against_plain_version(spark, sf, stages):
    """The documents kept are those that plain co-training over the same rows accepts."""
    from sparkloom.llm import quality
    from test_operators import plain_co_training

    before, after = stages["quality classifier"]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in before.collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    hash_of = {(int(x.id), x.text): x.h for x in quality._inputs(before, "doc_id").select("id", "text", "h").collect()}
    want, _, _ = plain_co_training(rows, labels, quality.MAX_LABELLED, quality.MAX_GIVEN, quality.ROUNDS, hash_of)
    assert ids(after) == sorted(i for (i, _), p in want.items() if p >= quality.THRESHOLD)


def test_one_worker_a_task(spark, sf, monkeypatch):
    """Steps of Python in one task have a worker each; these live on, idle or not, and hold memory in all later stages."""
    from sparkloom.llm.common import Scratch

    keep, steps = Scratch.keep, {}

    def watched(self, df, name="t"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        steps[name] = max(steps.get(name, 0), plan.count("ArrowEvalPython") + plan.count("MapInArrow"))
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", watched)
    corpus_pipeline.run(spark, sf)
    assert steps["found"] == 1 and max(steps.values()) == 1, steps


def test_scratch_tables_go(spark, sf):
    from sparkloom.llm.common import Scratch, release

    before = list(Scratch.live)
    out = corpus_pipeline.run(spark, sf)
    assert [p for p in Scratch.live if p not in before] == [out._scratch_path]
    release(spark, [out._scratch_path])
    assert Scratch.live == before


def test_run(spark, sf, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, stages["packing"][1].collect()))


def test_queries_against_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist())), name


def test_queries_cover_all_documents(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_language_id", "op3_suffix_dedup", "op5_minhash", "op6_quality", "op7_token_counts", "op8_line_dedup", "op10_sharding"):
        assert queries.QUERIES[name](spark, sf).count() == n, name
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
