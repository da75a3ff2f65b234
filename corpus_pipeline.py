"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again for the next one. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalith.llm.common import materialize, table
from causalith.llm.decontamination import contaminated
from causalith.llm.near_dedup import near_duplicates
from causalith.llm.packing import pack
from causalith.llm.quality import CUT, rank_quality, train
from causalith.llm.repeats import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at the cut or above."""
    docs = docs.select(COLUMNS)
    return rank_quality(docs, train(docs, table(spark, sf_dir, "labels"))).filter(F.col("score") >= CUT).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least doc_id; rows without doc_id stay.

    Rows that share a doc_id are one document and stay together; of rows equal in all columns one stays.
    """
    docs = docs.select(COLUMNS)
    kept = near_duplicates(docs, width=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.join(kept.hint("merge"), "doc_id").dropDuplicates(COLUMNS)
    return one.select(COLUMNS).unionByName(docs.filter("doc_id is null"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that occur elsewhere too; texts of which nothing stays go.

    Where 400 bytes hold fewer words, strings of 400 bytes count as such passages too.
    """
    out = remove_repeats(docs.select(COLUMNS), words=51).filter((F.length("kept") > 0) | (F.size("spans") == 0))
    text = F.col("kept").cast("string")
    return out.select("doc_id", text.alias("text"), "rest.lang", "rest.source", F.length(text).cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a test item."""
    docs = docs.select(COLUMNS)
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, keep_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: The ranker, the language-dependent tokenizer and the packing order have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
