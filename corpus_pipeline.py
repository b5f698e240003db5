"""The corpus pipeline: five stages from raw documents to packed bins.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``
for the rows they keep. A stage called by itself deletes nothing that its result reads; ``run`` writes each result
and then deletes what that stage has staged on the way, and the result itself once the next one is written.

In every stage a null text is an empty one, columns besides those of ``documents`` are left out whatever their names, and an
empty table gives no rows. Repeated rows are judged alike in the first two stages; of the rest each stage says what becomes of
nulls, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import delete, listing, staged
from tessera.llm.jaccard_join import near_components
from tessera.llm.packing import pack
from tessera.llm.quality_classifier import classify
from tessera.llm.quality_rules import quality_rules
from tessera.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of the shortest passage that may not repeat.
PASSAGE = 51


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stay near their language's reference. A null language is one of its own."""
    return quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither toxic nor of low quality. A null source or language is a site of its own; without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group, at five words and similarity 0.8.

    A row without id, or one of several rows with the smallest id, stays.
    """
    groups = near_components(docs, size=5, threshold=80)
    gone = staged(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 400 bytes and passages of over 50 words that occur twice; a text of which nothing is left goes.

    Repeated rows repeat each other, so both go if they are that long. A character cut in two goes whole; ``n_chars`` counts the new text.
    """
    cut = remove_repeats(docs.select(*COLUMNS), carry=("lang", "source", "n_chars"), words=PASSAGE)
    cut = cut.where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every text with its bin. A null source never conflicts; repeated rows go to separate bins."""
    return pack(docs)


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the classifier, the exact byte removal or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each but the last written to the shared folder and read again.

    Only tables of this run are deleted, so several may run in one session.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, function in STAGES[:-1]:
        folders: list[str] = []
        with listing(folders):
            docs = staged(function(spark, docs, sf_dir), "stage")
        delete(spark, [*before, *folders[:-1]])
        before = folders[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
