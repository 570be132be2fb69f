import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shorewise.llm import registry


def test_names():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def rows_of(df, names):
    """Sorted rows as text; a whole number is the same beside nulls."""
    text = lambda v: "null" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(map(text, r)) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), con.sql(registry.ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows_of(got, names) == rows_of(want, names)


def test_pipeline_against_its_parts(spark, sf_dir, real):
    """Each stage keeps what its own operator says of its own input."""
    from shorewise.llm import decontaminate, language_id, near_dedup

    docs, seen = real, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        seen[name] = (before, docs)
        assert set(real.columns) <= set(docs.columns)
        assert name == "sharding" or docs.columns == real.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["language_id"]
    found = language_id.identify(before, language_id.learn(before, F.lit(True)))
    assert ids(after) == ids(found.where(f"lang_pred <> 'und' AND far < {language_id.FAR}"))
    before, after = seen["near_dedup"]
    assert ids(after) == ids(near_dedup.near_duplicates(before, percent=corpus_pipeline.SIMILAR).where("kept"))
    before, after = seen["decontamination"]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert ids(after) == ids(decontaminate.scan(before, bench).where("NOT contaminated"))
    before, after = seen["mixing"]
    assert ids(after) <= ids(before) and after.groupBy("doc_id").count().where("count > 2").count() == 0
    slots = seen["sharding"][1].groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d"))
    assert seen["sharding"][1].count() == after.count() and slots.where("a <> 0 OR b <> n - 1 OR d <> n").count() == 0
