"""The corpus pipeline: language ID, near duplicates, decontamination, PII surrogates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents. Rows with the same doc_id and text are one document; a null or empty text has no letter
and goes in the first stage. Other nulls are kept. Equal texts under several ids are near duplicates: the smallest
id stays, and a null id only where all are null. Texts of any length are handled whole. Columns of any other name
are kept as they are, also where an operator has one of that name; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import common, decontam, language, ngram_join, packing, pii
from saltmarsh.llm.tokens import vocabulary_path

#: A document stays if its largest language has at least this share.
LEAST_SHARE = 0.34
#: Columns of its own; documents may have any others.
KEY, KEPT = "__saltmarsh_key", "__saltmarsh_kept"


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a leading language."""
    labelled = docs.filter(common.remainder("doc_id", 5) != 0).select("text", "lang")
    # the other columns are kept as one, so that none of them clashes with what identification adds
    others = [c for c in docs.columns if c != "text"]
    out = language.identify(docs.select("text", F.struct(*(F.col(c) for c in others)).alias(KEPT)), labelled)
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("text", f"{KEPT}.*").select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id stays."""
    found = ngram_join.near_duplicates(docs)
    stays = found.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("row_key").alias(KEY), F.col("doc_id").alias(KEPT)).distinct()
    keyed = docs.withColumn(KEY, common.row_key())
    out = keyed.join(stays, KEY).filter(F.col(KEPT).eqNullSafe(F.col("doc_id").cast("long")))
    return out.dropDuplicates([KEY, "doc_id"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    found = decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("row_key").alias(KEY)).distinct()
    keyed = docs.withColumn(KEY, common.row_key())
    return keyed.join(bad, KEY, "left_anti").select(docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates; n_chars follows the new text."""
    out = pii.pseudonymise(docs, pii.QUERY_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("language_id", keep_identified),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stash(docs, name)
    return docs
