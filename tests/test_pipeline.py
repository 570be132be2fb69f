import math

import pytest
from pyspark.sql import functions as F

from shorewise.config import DataConfiguration, FeatureGeneration, flatten, shifted_name
from shorewise.functions import geometry as G
from shorewise.operators import features, model, observations, rows

ROWS = [(r, t, float(d)) for r, ds in {1: {1: 110, 2: 80, 3: 50}, 2: {1: 60, 2: 40, 3: 20}, 3: {1: 5, 2: 5}, 4: {1: 0, 2: 10, 3: 20}, 5: {2: 12, 4: 47}}.items() for t, d in ds.items()]
NAMES = "location_id int, ahn_version int, distance_to_erosion_border double"


@pytest.fixture
def data(spark):
    return spark.createDataFrame(ROWS, NAMES)


def test_config():
    DataConfiguration()
    for bad in ({"feature_creation_config": {}}, {"no_of_points_for_distance_calculation": 0}, {"number_of_lags": 0}, {"number_of_futures": -1}):
        with pytest.raises(ValueError):
            DataConfiguration(**bad)
    c = DataConfiguration()
    with pytest.raises(ValueError):
        c.number_of_lags = 0
    assert c.number_of_lags == 1
    with pytest.raises(TypeError):
        FeatureGeneration(unheard_of=True)
    with pytest.raises(ValueError):
        FeatureGeneration(majority_class="kind")
    assert FeatureGeneration(count=False, area_fraction=True).active() == ["area_fraction"]


def test_flatten_and_names():
    assert flatten({"a": 1, "b": {"c": 2, "d": {"e": 3}}}) == {"a": 1, "b_c": 2, "b_d_e": 3}
    assert flatten({"b": {"d": {"e": 3}}}, "-") == {"b-d_e": 3}
    with pytest.raises(NotImplementedError):
        flatten({"a": [1]})
    assert shifted_name("x", 2) == "past_x_2" and shifted_name("x", 1, past=False) == "future_x_1"


def test_speeds(data):
    assert {r.location_id: r.erosion_speed for r in model.mean_step_speed(data).collect()} == {1: -30, 2: -20, 3: 0, 4: 10, 5: 17.5}


def test_speed_of_one_row_and_null_step(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 1.0), (2, 2, None), (2, 3, 4.0)], NAMES)
    assert {r.location_id: r.erosion_speed for r in model.mean_step_speed(df).collect()} == {1: None, 2: None}


def test_model(spark, data, tmp_path):
    m = model.MeanSpeedModel(data, steps=3)
    now = spark.createDataFrame([(1, 4, 50.0), (4, 4, 0.0)], NAMES)
    assert m.predict(now).count() == 0 and len(m.predict(now).columns) == 5
    m.train()
    first = m.speeds
    assert m.train().speeds is first and m.train(retrain=True).speeds is not first
    got = {r.location_id: tuple(r)[2:] for r in m.predict(now).collect()}
    assert got == {1: (20, -10, -40), 4: (10, 20, 30)}
    odd = now.union(spark.createDataFrame([(42, 4, 1.0)], NAMES))
    assert m.predict(odd).count() == 0 and m.predict(odd, strict=False).count() == 2
    m.save(str(tmp_path / "m"), keep_training_data=True)
    again = model.MeanSpeedModel.load(spark, str(tmp_path / "m"), with_training_data=True, steps=3)
    assert {r.location_id: tuple(r)[2:] for r in again.predict(now).collect()} == got
    assert again.data.count() == len(ROWS) and m.data is data
    long = model.unpivot_prediction(m.predict(now))
    assert long.count() == 6 and {t.timestamp.year for t in long.collect()} == {2025, 2026, 2027}


def test_feature_table(spark, data):
    df = observations.time_since_last(data)
    for differ, dropped in ((True, 2), (False, 1)):
        config = DataConfiguration(use_differences_in_features=differ)
        out, names = features.feature_table(df, config)
        assert len(names["numerical"]) == 4 and len(out.columns) == 6
        per = {r.location_id: r["count"] for r in out.groupBy("location_id").count().collect()}
        assert per == {k: n - dropped for k, n in {1: 3, 2: 3, 3: 2, 4: 3, 5: 2}.items() if n > dropped}
        assert features.feature_table(df, config, keep_incomplete=True)[0].count() == len(ROWS)
    assert names["numerical"][0] == "past_timesteps_since_last_measurement_float_0"
    with pytest.raises(ValueError, match="a, b"):
        features.feature_table(df, DataConfiguration(known_numerical_columns=["a", "b"]))
    with pytest.raises(KeyError):
        features.feature_table(df, DataConfiguration(known_categorical_columns=["location_id"]))


def test_categories(spark):
    df = spark.createDataFrame([("a",), ("q",), (None,)], "c string")
    assert [r[0] for r in df.select(features.encode_category(F.col("c"), {"a": 2})).collect()] == [2, -1, -1]
    assert [r[0] for r in features.unknown_categories(df, "c", {"a": 2}).collect()] == ["q"]


def test_observations(spark):
    regions = spark.createDataFrame([(1,), (2,)], "location_id int")
    points = spark.createDataFrame([(1, 1, "OK", 1.0), (1, 1, "OK", -5.0), (1, 1, "OK", 7.0), (1, 1, "OK", 9.0), (1, 1, "BAD", -99.0), (1, 3, "OK", 2.0), (2, 1, "OK", math.nan), (3, 1, "OK", 1.0), (None, 1, "OK", 1.0), (1, 1, None, 0.0)], "location_id int, ahn_version int, status string, d double")
    out = {(r.location_id, r.ahn_version): tuple(r)[2:] for r in observations.process_observations(points, regions, DataConfiguration(), value="d").collect()}
    assert out == {(1, 1): (1.0, 1.0), (1, 3): (2.0, 2.0), (2, 1): (None, 1.0)}
    both = observations.process_observations(points, regions, DataConfiguration(use_only_certain_river_bank_points=False), value="d").where("location_id = 1 AND ahn_version = 1").first()
    assert both.distance_to_erosion_border == pytest.approx(-104 / 3)


def test_signed_distance(spark):
    lines = spark.createDataFrame([(0, [(0.0, 0.0), (10.0, 0.0)])], f"line_ord int, line {G.LINE}")
    points = spark.createDataFrame([(5.0, 3.0), (5.0, 12.0), (5.0, 10.0)], "x double, y double")
    got = observations.signed_distance(points, G.line([(0, 10), (10, 10)]), lines, name="d")
    assert [r.d for r in got.collect()] == [7.0, -2.0, 0.0]


def test_everything_filtered_away(spark):
    points = spark.createDataFrame([], "location_id int, ahn_version int, status string, d double")
    regions = spark.createDataFrame([(1,)], "location_id int")
    assert observations.process_observations(points, regions, DataConfiguration(), value="d").count() == 0


def test_table_and_counts_in_one_pass(spark, data, tmp_path):
    """The pass that writes the table also counts what it drops."""
    df, config = observations.time_since_last(data), DataConfiguration()
    complete, names = features.feature_table(df, config, keep_incomplete=True)
    want = features.dropped_rows(complete, names["numerical"]).first()
    spark.sparkContext.setJobGroup("features", "write")
    got = features.write_features(df, str(tmp_path / "t"), config)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("features"))
    spark.sparkContext.setJobGroup("alone", "write")
    complete.write.parquet(str(tmp_path / "alone"))
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("alone"))
    assert got == want.asDict() and 0 < got["n_dropped"] < got["n_rows"]
    assert spark.read.parquet(str(tmp_path / "t")).count() == got["n_rows"] - got["n_dropped"]


def test_rows(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", -1.0), (2, "b", -2.0), (None, "b", None)], "k int, c string, d double")
    assert [tuple(r) for r in rows.value_counts(df, "c").collect()] == [("a", 1), ("b", 3)]
    assert [tuple(r) for r in rows.value_counts(df, "c", of="d").collect()] == [("a", 1), ("b", 2)]
    assert {r.k: tuple(r)[1:] for r in rows.reductions(df, "k", "d", "c").collect()} == {1: (True, False, -1, 5, 2), 2: (True, True, -2, -2, 1), None: (None, None, None, None, 1)}
    assert {r.k: (r["first"], r["last"]) for r in rows.ends(df, "k", "d", ["c"]).collect()}[1] == (5, -1)
    assert rows.appended(df, df.select("k"), df.select("c")).count() == 12 and rows.head(df, 2, "d").count() == 2
    part = rows.sampled(spark.range(4000), "id", 0.25)
    assert 850 < part.count() < 1150 and part.exceptAll(rows.sampled(spark.range(4000), "id", 0.25)).isEmpty()
    assert rows.sampled(df, "k", 1.0).count() == 4 and rows.sampled(df, "k", 0.0).count() == 0
