"""Training-corpus pipeline: quality, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. A stage sees only what the stage
before it kept, written as Parquet and read again. Documents are told apart by
doc_id, null being an id like any other; null texts count as empty, and an
empty table passes through every stage. Columns beside those of ``documents``
don't pass the first stage, whatever their names. A very long text is one row
of every stage, and several pieces of the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronostore.llm import decontam, jaccard, line_dedup, packing, quality
from chronostore.llm.common import documents, new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _of(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is (left_semi) or isn't (left_anti) among ``ids``; texts stay on the streamed side."""
    ids = ids.select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_other")), how).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier gives less than even odds of quality 1.

    The classifier is fitted on this stage's own documents that have labels.
    A null or empty text scores as the model's bias; rows that repeat stay or
    go together; without labels every score is even odds and all stay.
    """
    model = quality.fit(spark, docs, sf_dir)
    settings = quality.Settings(threshold=0.5)
    return quality.keep(docs, model, settings).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that repeat; every document stays, with what is left of its text.

    The copy in the smallest doc_id stays, null being the smallest; null texts become empty.
    """
    return line_dedup.dedup_lines(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep, of each group of near-duplicates, the document with the smallest id.

    Links are pairs whose sets of five-word shingles have a Jaccard similarity
    of 0.8 or more; candidates come from the SimHash trie join and from MinHash
    bands. Rows that repeat a doc_id stay or go together. Blank and null texts
    are one group. A group of null doc_ids alone stays.
    """
    groups = jaccard.similar_groups(docs.select("doc_id", "text"))
    return _of(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that leak an item of ``benchmark``; all rows that share such a document's doc_id, or a null one, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _of(docs, decontam.overlaps(docs, benchmark), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens; an empty text is one piece, of the end id alone."""
    import public_tokenizers

    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL cannot express the classifier, the sketches or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
