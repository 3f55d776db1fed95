"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hamming, langid, linededup, neardup, packing, quality, sharding, suffix, tokens
from .common import table


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = linededup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


OP8_SQL = """
with d as (select doc_id, text, source, string_split(text, chr(10)) as ls from documents),
l as (select coalesce('s' || source, 'n') as site, trim(x) as line from (select source, unnest(ls) as x from d) t),
bad as (select line from l where line <> '' group by line having count(distinct site) >= 10),
f as (select d.doc_id, d.text, d.ls, list_filter(d.ls, lambda x: trim(x) <> '' and list_contains(b.lines, trim(x))) as gone
  from d, (select coalesce(list(line), []) as lines from bad) b)
select doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed,
  md5(case when len(gone) > 0 then array_to_string(list_filter(ls, lambda x: not list_contains(gone, x)), chr(10)) else text end) as kept_md5
from f
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out("doc_id")))
    out = langid.identify(docs.select("doc_id", "text", langid.held_out("doc_id").alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "p_good", "p_text", "p_page", (F.col("p_good") >= quality.THRESHOLD).alias("accepted"))


LIMIT = 4096


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the prefix row of each text, and how many of its characters stay within the limit."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = tokens.measured_rows(docs, public_tokenizers.path("piece_bpe_32k.model"), LIMIT)
    return rows.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.size("pieces") > 1).alias("over_limit"),
        F.col("pieces")[0]["chars"].alias("chars_within"), "prefix_row",
    )


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code("embedding").alias("code"))
    return hamming.top_k(rows, F.col("vec_id") % 50 == 0, 10)


OP2_SQL = """
with c as (select vec_id, list_sum(list_transform(range(1, 65), lambda i: case when embedding[i] > 0 then 1::hugeint << (64 - i)::int else 0::hugeint end))::hugeint as code from embeddings),
p as (select q.vec_id as query_id, e.vec_id as neighbor_id, bit_count(xor(q.code, e.code))::int as distance
  from c q, c e where q.vec_id % 50 = 0 and e.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by distance, neighbor_id)::int as rank from p)
select query_id, rank, neighbor_id, distance from r where rank <= 10
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, unnest(range(greatest(len(h) // 2 - 99, 0))) as p, h from d),
x as (select doc_id, p, substr(h, 2 * p + 1, 200) as s from w),
f as (select s, min(doc_id * 4294967296::hugeint + p) as first from x group by s having count(*) > 1),
g as (select x.doc_id, x.p from x join f using (s) where x.doc_id * 4294967296::hugeint + x.p > f.first),
o as (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 100 then 1 else 0 end as new from g),
q as (select doc_id, p, sum(new) over (partition by doc_id order by p) as k from o),
r as (select doc_id, min(p) as a, max(p) + 100 as z from q group by doc_id, k),
t as (select r.doc_id, a, z, substr(h, 2 * coalesce(lag(z) over (partition by r.doc_id order by a), 0) + 1, 2 * (a - coalesce(lag(z) over (partition by r.doc_id order by a), 0))) as before from r join d on d.doc_id = r.doc_id),
u as (select doc_id, sum(z - a) as gone, count(*) as spans, string_agg(before, '' order by a) as kept, max(z) as z from t group by doc_id)
select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(case when gone is null then h else kept || substr(h, 2 * u.z + 1) end)) as kept_sha256
from d left join u on u.doc_id = d.doc_id
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, a row for each item that one holds: agreeing words of the best window, and where it begins."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("hits")).select("doc_id", "item_id", "n_same", "first_word")


OP4_SQL = r"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+') as ws from documents),
b as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+') as ws from benchmark),
dw as (select doc_id, len(ws) as dn, unnest(range(len(ws))) as dp, unnest(ws) as w from d),
bw as (select item_id, len(ws) as n, least(20, len(ws)) as size, ceil(0.8 * least(20, len(ws))) as need, unnest(range(len(ws))) as bp, unnest(ws) as w from b),
m as (select doc_id, item_id, dn, n, size, need, dp - bp as shift, bp from dw join bw using (w)),
c as (select doc_id, item_id, dn, n, size, need, shift, list_sort(list(bp)) as hits from m group by all having count(*) >= least(need, 13)),
u as (select doc_id, item_id, shift, unnest(hits) as p, unnest(range(len(hits))) as i from c),
v as (select doc_id, item_id, shift, count(*) as run from u group by doc_id, item_id, shift, p - i having count(*) >= 13),
s as (select *, unnest(range(n - size + 1)) as a from c),
k as (select doc_id, item_id, shift, need, greatest(a + shift, 0) as first_word, len(list_filter(hits, lambda p: p >= a and p < a + size)) as n_same from s),
q as (select k.*, row_number() over (partition by doc_id, item_id order by n_same desc, first_word) as i from k left join (select distinct doc_id, item_id, shift from v) v using (doc_id, item_id, shift) where n_same >= need or v.shift is not null)
select doc_id, item_id, n_same::int as n_same, first_word::int as first_word from q where i = 1
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.measure(docs, public_tokenizers.path("piece_bpe_32k.model"), packing.MAX_LEN)
    return packing.pack(counted, pieces_col="pieces")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


OP5_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, case when len(ws) = 1 then ws[1] else ws[i] || ' ' || ws[i + 1] end as sh
  from (select doc_id, ws, unnest(range(1, greatest(len(ws), 2))) as i from w where len(ws) > 0) t),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by all),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
b as (select a, b from e union all select b, a from e),
r as (select doc_id as v, doc_id as t from n union select r.v, b.b from r join b on b.a = r.t),
c as (select v, min(t) as comp from r group by v)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.comp, w.doc_id) as component_id, coalesce(c.comp, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join c on c.v = w.doc_id
"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_hamming_topk": op2_hamming_topk,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_minhash": op5_minhash,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
}
ORACLE_SQL = {
    "op2_hamming_topk": OP2_SQL,
    "op3_suffix_dedup": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_minhash": OP5_SQL,
    "op8_line_dedup": OP8_SQL,
}
