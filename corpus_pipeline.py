"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; what it returns is
written as Parquet and read again as the next stage's docs.  All stages but the
last return the columns of documents.

1. toxicity: documents that the classifier calls toxic go.
2. near_dedup: of each group of near-duplicates the one of least id stays.
3. substring_dedup: words in passages that occur again go; documents of which
   nothing is left go too, and texts without such passages stay as they are.
4. mixing: documents are repeated by a Poisson count with their source's rate.
5. packing: the pieces of all documents get a place in a sequence.

Every stage takes any table with at least the columns of documents; all other
columns, whatever their names, end with the first one.

Nulls: documents without text are not toxic, have no duplicates and pack as one
end token; documents without an id are compared, repeated and packed like any
others; a null source is a source of its own.  Repeated rows, and rows that tie
in all a stage looks at: toxicity and substring_dedup treat them alike,
near_dedup leaves one row of equal texts (of tied rows the one whose other
columns are least), mixing gives them the same count, packing packs each.  Rows
of one id with different texts are different documents.  An empty table gives an
empty table.  A very long text is one row of every stage, held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm import mixing, neardup, packing, substring, toxicity
from tremorframe.llm.shared import remainder, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL cannot express these stages; tests/llm compares them with plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    weights = toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.representatives(docs, COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(docs.select(*COLUMNS), keep=COLUMNS, text=True)
    rows = rows.where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
