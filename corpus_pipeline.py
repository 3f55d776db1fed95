"""From raw documents to packed training batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and
read again. All but the last return the columns of documents. A stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontam, linededup, neardup, packing, quality, tokens
from sparkloom.llm.common import Scratch, release, row_key, table

#: A model cannot be trained in SQL; the tests hold each stage against a plain version instead.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely than not of low quality or toxic.

    Null texts are empty, null metadata a value of its own, rows without an id unlabelled; repeated rows share their fate.
    Without labels of both kinds nothing goes. Any extra columns stay, whatever their names.
    """
    return quality.accept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; no document goes, one that holds nothing else is left empty.

    n_chars, if there is such a column, follows the text where it changes. A null text stays null, a null source is a site;
    repeated rows get equal texts. Any extra columns stay, whatever their names.
    """
    out = linededup.dedup_lines(docs, names=("__lines", "__removed"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id.

    Ids may be null (these come last) or repeated: a row is known by the hash of its id and text, and of rows equal in
    both one stays, the first in the order of the other columns. Null and wordless texts are no near-duplicates of
    anything. Any extra columns stay, whatever their names. Rows are told apart by 64 bits of hash.
    """
    put = Scratch(spark, "near-stage")
    rows = docs.withColumn("__v", row_key("doc_id", "text")["a"])
    found = neardup.components(rows.select("__v", "text"), size=5, percent=80, id_col="__v").select("__v", "component_id").distinct()
    known = rows.groupBy("__v").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")).join(found, "__v")
    rank = F.struct(F.col("id").isNull().alias("z"), "id", "__v")
    first = known.groupBy("component_id").agg(F.min(rank).alias("first"), F.sum("n").alias("m")).where("m > 1")
    fate = put.keep(known.join(first, "component_id").select("__v", "n", (F.col("__v") == F.col("first.__v")).alias("kept")).where("n > 1 or not kept"), "fate")
    out = rows.join(fate.select("__v"), "__v", "left_anti").select(docs.columns)
    again = fate.where("kept").select("__v")
    if again.isEmpty():
        return out
    one = rows.join(again, "__v", "left_semi").groupBy("__v").agg(F.min(F.struct(*docs.columns)).alias("r"))
    return out.unionAll(one.select("r.*"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item.

    Null and empty texts stay, as do all texts if the benchmark is empty; repeated rows share their fate. Any extra columns
    stay, whatever their names.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns all of every document to batches, in pieces cut by the prefix counts of its tokens.

    A null or empty text is one piece of no tokens; null ids stay; repeated rows are packed separately. Only id and text are
    used.
    """
    import public_tokenizers

    counted = tokens.measure(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), packing.MAX_LEN)
    return packing.pack(counted, pieces_col="pieces")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = set(Scratch.live)
        done, docs = docs, put.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # what the stage wrote on its way, and what it read, are needed no more
        release(spark, [p for p in Scratch.live if p not in before and p != docs._scratch_path] + [p for p in before if p == getattr(done, "_scratch_path", None)])
    return docs
