"""The corpus pipeline: five stages over documents, each written as Parquet and read again for the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. A null or repeated row is handled as its
operator says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorewise.llm.common import delete_folder, forget_settled, settled_so_far, shared_folder, table
from shorewise.llm.decontaminate import decontaminate
from shorewise.llm.language_id import keep_identified
from shorewise.llm.mixing import mixed_corpus
from shorewise.llm.near_dedup import one_of_each
from shorewise.llm.sharding import SHARDS, shard_records

#: Percent of shared shingles from which two documents are near duplicates here; op4's own query has 85.
SIMILAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; text without letters or like no language goes."""
    return keep_identified(docs, F.lit(True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of SIMILAR percent or more."""
    return one_of_each(docs, percent=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is drawn, a cut one whole if at least half of it is drawn."""
    return mixed_corpus(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their number in it."""
    return shard_records(docs, "doc_id", [1.0] * SHARDS, grow_by=None, tie=["n_chars"]).drop("grown_shard")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Language profiles, MinHash candidates and the mix's splitting tree aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows in the shared folder before the next begins; what only earlier ones needed is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, mark = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}", settled_so_far()
        stage(spark, docs, sf_dir).write.parquet(path)
        forget_settled(spark, mark)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
