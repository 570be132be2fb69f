"""What several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Folders that `settled` has written and `forget_settled` may delete.
_settled: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay. lower() is the faster of the two, and right on ASCII."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local one is set only where the session has none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file:///tmp/shorewise-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: what follows doesn't compute it anew, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what is written needs the shuffle files of this job no more
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _settled.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_so_far() -> int:
    return len(_settled)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget_settled(spark: SparkSession, since: int) -> None:
    """Deletes what `settled` has written since settled_so_far() was `since`; for callers that have written their own result of it."""
    while len(_settled) > since:
        delete_folder(spark, _settled.pop())


def carried(docs: DataFrame, *columns: Column) -> DataFrame:
    """docs as one column `row`, beside columns of our own that its columns then can't clash with; `row.*` gives docs back."""
    return docs.select(F.struct("*").alias("row"), *columns)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank, from 0 in the order given: numbers within ranges, and the ranges' offsets."""
    ranges = settled(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = ranges.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranges.withColumn("__within", within).join(offsets, "__range").withColumn("rank", F.col("__offset") + F.col("__within")).drop("__range", "__within", "__offset")


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with ids as long, and (__id, rank), what the numbers stand for: None if ids are whole numbers.

    Ids of another type are numbered in their own order, and docs are written anew with doc_id and text; null ids stay null.
    """
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return docs.withColumn("doc_id", F.col("doc_id").cast("long")), None
    docs = docs.select(F.col("doc_id").alias("__id"), "text")
    names = settled(ranked(docs.select("__id").where("__id IS NOT NULL").distinct(), F.col("__id")))
    return settled(docs.join(names, "__id", "left").select(F.col("rank").cast("long").alias("doc_id"), "text")), names


def named(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    """rows with the ids that `numbered` has put numbers for."""
    if names is None:
        return rows
    found = rows.join(names, rows["doc_id"] == names["rank"], "left")
    return found.select(*[F.col("__id").alias("doc_id") if c == "doc_id" else c for c in rows.columns])


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


BLOCK_BYTES = 24_000_000


def with_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text and block: a number that deals the rows evenly to blocks of about block_bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-size // block_bytes) or 1)).cast("int")
    return docs.select("doc_id", "text").withColumn("block", block)


def shared_by_blocks(listed: DataFrame, key: str) -> DataFrame:
    """The rows of (block, key) of which another block has the key too; a key has few rows per block, so no partition of the window is large."""
    of_key = Window.partitionBy(key)
    return listed.withColumn("__shared", F.min("block").over(of_key) < F.max("block").over(of_key)).where("__shared").drop("__shared")
