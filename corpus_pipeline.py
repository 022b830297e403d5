"""A corpus pipeline of five stages, each over all rows that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents:

1. language_id: documents whose language is undetermined (no text or no letter) go.
   No floor is set to the score: clean texts of a word score as low as junk does.
2. ngram_join: of each class of similar documents the least doc_id stays.
3. decontamination: documents with a passage of the benchmark go.
4. pii: entities are removed and disclosing terms generalised in the text.
5. packing: what is left becomes sequences of 1024 tokens.

Rows with a null doc_id take part in all stages; only the n-gram join links them
with nothing.  Stages 1 and 3 judge a row by its id and its text, so of rows with
equal ids one can go and another stay; for stage 2 equal ids are one document, and
of its rows with equal texts one stays.  Ties go as the operators state.  Empty
tables give empty results; extra columns are carried on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, langid, ngramjoin, packing, pii
from quarry.llm._base import bounded_batches, read, release, scope, table
from quarry.llm.queries import vocabulary
from quarry.sources.ship import ship

#: Packing, language models and corpus co-occurrence have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


#: Working tables of a stage; its result is written before the next stage starts, which then deletes them.
WORK = "pipeline"


def _stage(function):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        bounded_batches(spark)
        release(spark, WORK)
        with scope(WORK):
            return function(spark, docs, sf_dir)

    return stage


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _rows(docs: DataFrame) -> DataFrame:
    """row (doc_id and a hash of the text, by which stages judge) and text."""
    return docs.select(F.struct("doc_id", _text_key().alias("key")).alias("row"), "text")


def _without(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """docs without ``rows``.  These are written first, so their true size decides how they are joined."""
    gone = table(rows.select(F.col("row.doc_id").alias("_id"), F.col("row.key").alias("_key")).distinct(), name)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (_text_key() == F.col("_key")), "left_anti")


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(_rows(docs), langid.train(docs), id_col="row")
    return _without(docs, found.where(F.col("lang_pred") == langid.UNDETERMINED), "undetermined")


@_stage
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngramjoin.join(docs)
    copies = table(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct(), "copies")
    kept = docs.join(copies, F.col("doc_id") == F.col("_id"), "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1)
    if not repeated:
        return kept
    unnamed = kept.where("doc_id is null")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(unnamed)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.find(_rows(docs), read(spark, sf_dir, "benchmark"), id_col="row")
    return _without(docs, found.where("n_hit > 0"), "contaminated")


@_stage
def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs, pii.find(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("pii", pii_sanitisation),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, name)  # outside the stages' scope
    return docs
