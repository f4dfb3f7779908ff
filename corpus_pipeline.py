"""The corpus pipeline: quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; ``run`` writes
its result as Parquet and reads it again as the next one's documents.

In all stages a null text counts as empty, a row that occurs twice is two rows, columns besides doc_id and
text may be null and of any name, and an empty table gives an empty one.  Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clanmark.llm.base import table
from clanmark.llm.grace import drop_copies
from clanmark.llm.packing import pack_documents
from clanmark.llm.probminhash import drop_near_copies
from clanmark.llm.voting import keep_good
from clanmark.sources.workspace import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled ones call good: a score of 0.7 or more.

    Rows of equal texts share their fate.  A text without words has the share of good labels as its score; without
    any label every score is 0.5 and all documents go.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for blanks.

    The one of most code points stays, ties go to the smaller doc_id; all empty texts are one group.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest doc_id.

    Classes are what links of a similarity of 0.8 connect.  Texts under five words have one shingle, texts without
    words are alike.
    """
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of every document in sequences of 2048 tokens.

    An empty text is its end token alone; a text of more tokens than a sequence is cut into pieces.
    """
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL can't express the stages that learn or hash signatures; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
