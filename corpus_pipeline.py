"""A pipeline over ``documents``: quality rules, near duplicates, personal data, mixing, token ids.

Each stage takes the documents that the stage before it kept, written as Parquet in between; a table is removed once
the next one is complete. The first four return the columns of ``documents``; the last returns them with the ids of the
text and their number.

Defined cases, for all stages: an empty table gives an empty result; texts of any length are taken whole; extra columns
pass through, whatever their names, but for those that the last stage adds, which replace columns of the same name. What
becomes of nulls, empty texts, ties and repeated rows stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash, mixing, pii, quality, wfst
from tessera.llm.common import materialize, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the weak supervision finds bad go.

    Null, empty and blank texts fail; equal rows share a verdict, so repeated rows all stay or all go.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays.

    Null and empty texts are copies of nothing. A null doc_id is larger than all others; of rows that repeat id and
    text one stays, rows that repeat the id with other texts are documents of their own.
    """
    return minhash.deduplicate(docs, percent=80, width=5, bands=32, rows=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kinds; n_chars follows the text. Null text stays null, with null n_chars; equal texts change alike."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for. Null and empty texts weigh nothing and may be taken any number of times up to 2; a null source is one of its own; rows of equal or no id share a draw."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and how many they are. Null and empty texts have none; equal texts have equal ids."""
    return wfst.encode(docs).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]
#: No SQL expresses the personal data and token stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what the last one wrote."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as work:
            docs = work.keep(materialize(stage(spark, before, sf_dir), f"pipeline-{name}"))
            if name != STAGES[0][0]:
                work.adopt(before)
        before = docs
    return docs
