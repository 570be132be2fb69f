"""All queries of the engine and their SQL."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shorewise.config import DataConfiguration, FeatureGeneration
from shorewise.functions import crs, curves
from shorewise.functions import geometry as G
from shorewise.functions.text import epsg_from_urn
from shorewise.operators import bank as banks
from shorewise.operators import features, model, observations, regions, rows
from shorewise.plans import views as V
from shorewise.sources import geojson, wkt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CODES = {"view": 0, "click": 1, "purchase": 2}
KEYS = ["location_id", "ahn_version"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _r(c: Column | str, name: str) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.process_observations(V.bank(spark, sf_dir), V.known_regions(spark, sf_dir), DataConfiguration(), value="d")


def _border() -> Column:
    return G.line(V.BORDER)


@query(f"WITH {V.BANK_SQL} SELECT event_id, location_id FROM bank b WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = b.location_id AND c_acctbal >= 0)")
def semi_join_regions(spark, sf_dir):
    return observations.in_known_regions(V.bank(spark, sf_dir), V.solvent_regions(spark, sf_dir)).select("event_id", "location_id")


@query(f"WITH {V.BANK_SQL} SELECT event_id, status FROM bank WHERE status = 'OK'")
def ok_filter(spark, sf_dir):
    return observations.certain_points(V.bank(spark, sf_dir)).select("event_id", "status")


@query(f"WITH {V.BANK_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY location_id, ahn_version ORDER BY d) AS rn FROM bank) SELECT location_id, ahn_version, round(avg(d), 6) + 0.0 AS distance FROM r WHERE rn <= 3 GROUP BY ALL")
def bottom_n_mean(spark, sf_dir):
    return observations.bottom_n_mean(V.bank(spark, sf_dir), KEYS, "d", name="distance").select(*KEYS, _r("distance", "distance"))


@query(f"WITH {V.PROCESSED_SQL} SELECT location_id, ahn_version, timesteps_since_last_measurement FROM processed")
def time_since_last(spark, sf_dir):
    return _processed(spark, sf_dir).select(*KEYS, "timesteps_since_last_measurement")


@query(f"WITH {V.PROCESSED_SQL} SELECT location_id, ahn_version, round(distance_to_erosion_border, 6) + 0.0 AS distance_to_erosion_border, timesteps_since_last_measurement FROM processed")
def processed_table(spark, sf_dir):
    return _processed(spark, sf_dir).select(*KEYS, _r("distance_to_erosion_border", "distance_to_erosion_border"), "timesteps_since_last_measurement")


@query(f"WITH {V.PROCESSED_SQL} SELECT location_id, ahn_version, round(distance_to_erosion_border - lag(distance_to_erosion_border) OVER (PARTITION BY location_id ORDER BY ahn_version), 6) + 0.0 AS diff FROM processed")
def diff_feature(spark, sf_dir):
    return _processed(spark, sf_dir).select(*KEYS, _r(features.difference("distance_to_erosion_border", *KEYS), "diff"))


def _shift(spark, sf_dir, past: bool) -> DataFrame:
    shifts = range(0 if past else 1, 3)
    return _processed(spark, sf_dir).select(*KEYS, *[_r(features.shift("distance_to_erosion_border", k if past else -k, *KEYS), f"{'past' if past else 'future'}_{k}") for k in shifts])


_SHIFT_SQL = "SELECT location_id, ahn_version, {} FROM processed WINDOW w AS (PARTITION BY location_id ORDER BY ahn_version)"


@query(f"WITH {V.PROCESSED_SQL} " + _SHIFT_SQL.format(", ".join(f"round(lag(distance_to_erosion_border, {k}) OVER w, 6) + 0.0 AS past_{k}" for k in range(3))))
def past_shift(spark, sf_dir):
    return _shift(spark, sf_dir, True)


@query(f"WITH {V.PROCESSED_SQL} " + _SHIFT_SQL.format(", ".join(f"round(lead(distance_to_erosion_border, {k}) OVER w, 6) + 0.0 AS future_{k}" for k in (1, 2))))
def future_shift(spark, sf_dir):
    return _shift(spark, sf_dir, False)


_CLASSED_SQL = f"""{V.PROCESSED_SQL}, classes AS (SELECT location_id, ahn_version, min(event_type) AS event_class FROM bank GROUP BY ALL),
coded AS (SELECT location_id, ahn_version, timesteps_since_last_measurement AS t, distance_to_erosion_border - lag(distance_to_erosion_border) OVER w AS d,
  CASE event_class WHEN 'view' THEN 0.0 WHEN 'click' THEN 1.0 WHEN 'purchase' THEN 2.0 ELSE -1.0 END AS c FROM processed LEFT JOIN classes USING (location_id, ahn_version) WINDOW w AS (PARTITION BY location_id ORDER BY ahn_version)),
shifted AS (SELECT location_id, ahn_version,
  t AS past_timesteps_since_last_measurement_float_0, lag(t) OVER w AS past_timesteps_since_last_measurement_float_1, lead(t) OVER w AS future_timesteps_since_last_measurement_float_1,
  round(d, 6) + 0.0 AS past_diff_distance_to_erosion_border_float_0, round(lag(d) OVER w, 6) + 0.0 AS past_diff_distance_to_erosion_border_float_1, round(lead(d) OVER w, 6) + 0.0 AS future_diff_distance_to_erosion_border_float_1,
  c AS past_event_class_as_number_0, lag(c) OVER w AS past_event_class_as_number_1, lead(c) OVER w AS future_event_class_as_number_1
  FROM coded WINDOW w AS (PARTITION BY location_id ORDER BY ahn_version))"""


@query(f"""WITH {_CLASSED_SQL} SELECT * FROM shifted WHERE past_timesteps_since_last_measurement_float_1 IS NOT NULL AND future_timesteps_since_last_measurement_float_1 IS NOT NULL
AND past_diff_distance_to_erosion_border_float_0 IS NOT NULL AND past_diff_distance_to_erosion_border_float_1 IS NOT NULL AND future_diff_distance_to_erosion_border_float_1 IS NOT NULL""")
def feature_table(spark, sf_dir):
    classes = V.bank(spark, sf_dir).groupBy(*KEYS).agg(F.min("event_type").alias("event_class"))
    config = DataConfiguration(number_of_lags=2, unknown_categorical_columns=["event_class"])
    out, names = features.feature_table(_processed(spark, sf_dir).join(classes, KEYS, "left"), config, {"event_class": CODES})
    return out.select(*KEYS, *[_r(f"`{n}`", n) for n in names["numerical"] + names["categorical"]])


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS code FROM events")
def category_encode(spark, sf_dir):
    return V.bank(spark, sf_dir).select("event_id", features.encode_category(F.col("event_type"), CODES).alias("code"))


@query("SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL EXCEPT (VALUES ('view'), ('click'), ('purchase'))")
def unknown_categories(spark, sf_dir):
    return features.unknown_categories(V.bank(spark, sf_dir), "event_type", CODES)


@query(f"WITH {V.PROCESSED_SQL}, f AS (SELECT p_partkey AS location_id, p_retailprice AS price FROM part WHERE p_size > 25) SELECT location_id, ahn_version, price FROM processed LEFT JOIN f USING (location_id)")
def left_join_features(spark, sf_dir):
    found = V.read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("location_id"), F.col("p_retailprice").alias("price"))
    return regions.attach(_processed(spark, sf_dir), found).select(*KEYS, "price")


@query(f"WITH {V.PROCESSED_SQL}, {V.MODEL_SQL} SELECT location_id, round(erosion_speed, 6) + 0.0 AS erosion_speed FROM model")
def mean_step_speed(spark, sf_dir):
    return model.mean_step_speed(_processed(spark, sf_dir)).select("location_id", _r("erosion_speed", "erosion_speed"))


_WIDE_SQL = "SELECT location_id, ahn_version, " + ", ".join(f"round(distance_to_erosion_border + {k} * erosion_speed, 6) + 0.0 AS future_distance_to_erosion_border_{k}" for k in (1, 2, 3)) + " FROM processed JOIN model USING (location_id)"


def _predicted(spark, sf_dir) -> DataFrame:
    df = _processed(spark, sf_dir)
    return model.predict(df, model.mean_step_speed(df), 3)


@query(f"WITH {V.PROCESSED_SQL}, {V.MODEL_SQL} {_WIDE_SQL}")
def predict_wide(spark, sf_dir):
    return _predicted(spark, sf_dir).select(*KEYS, *[_r(f"{model.PREDICTION}_{k}", f"{model.PREDICTION}_{k}") for k in (1, 2, 3)])


@query(f"WITH {V.PROCESSED_SQL}, {V.MODEL_SQL}, wide AS ({_WIDE_SQL}) " + " UNION ALL ".join(f"SELECT location_id, ahn_version, future_distance_to_erosion_border_{k} AS distance_to_erosion, TIMESTAMP '{2024 + k}-01-01' AS timestamp FROM wide" for k in (1, 2, 3)))
def predict_long(spark, sf_dir):
    return model.unpivot_prediction(_predicted(spark, sf_dir)).select(*KEYS, _r("distance_to_erosion", "distance_to_erosion"), "timestamp")


@query(f"WITH {V.PROCESSED_SQL}, {V.MODEL_SQL}, wide AS ({_WIDE_SQL}) SELECT * FROM wide WHERE ahn_version = (SELECT max(ahn_version) FROM processed)")
def saved_model(spark, sf_dir):
    """A model trained and saved with its data, and loaded again to predict from the latest rows of that data."""
    path = V.written_folder(spark)
    model.MeanSpeedModel(_processed(spark, sf_dir), steps=3).save(path, keep_training_data=True)
    again = model.MeanSpeedModel.load(spark, path, with_training_data=True, steps=3)
    return again.predict(model.latest(again.data)).select(*KEYS, *[_r(f"{model.PREDICTION}_{k}", f"{model.PREDICTION}_{k}") for k in (1, 2, 3)])


_STEP_SQL = "location_id, ahn_version, round(distance_to_erosion_border + erosion_speed, 6) + 0.0 AS future_distance_to_erosion_border_1 FROM processed JOIN"


@query(f"""WITH {V.PROCESSED_SQL}, {V.MODEL_SQL}, known AS (SELECT * FROM model WHERE location_id % 10 <> 1)
SELECT 'every region known' AS told, {_STEP_SQL} model USING (location_id) WHERE NOT EXISTS (SELECT 1 FROM processed p WHERE p.location_id NOT IN (SELECT location_id FROM model))
UNION ALL SELECT 'unknown left out', {_STEP_SQL} known USING (location_id)
UNION ALL SELECT 'unknown stop all', {_STEP_SQL} known USING (location_id) WHERE NOT EXISTS (SELECT 1 FROM processed p WHERE p.location_id NOT IN (SELECT location_id FROM known))""")
def unknown_region_guard(spark, sf_dir):
    """A model that lacks some regions predicts nothing if strict, and the others if not; one that knows all predicts all."""
    df = _processed(spark, sf_dir)
    whole = model.mean_step_speed(df)
    some = whole.where("location_id % 10 <> 1")
    cases = [("every region known", whole, True), ("unknown left out", some, False), ("unknown stop all", some, True)]
    parts = [model.predict(df, m, 1, strict=strict).select(F.lit(told).alias("told"), *KEYS, _r(f"{model.PREDICTION}_1", f"{model.PREDICTION}_1")) for told, m, strict in cases]
    return rows.appended(*parts)


@query(f"WITH {V.PROCESSED_SQL} SELECT location_id, ahn_version FROM processed WHERE ahn_version = (SELECT max(ahn_version) FROM processed)")
def latest_filter(spark, sf_dir):
    return model.latest(_processed(spark, sf_dir)).select(*KEYS)


@query("""WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda v : v::DOUBLE) AS u, list_transform(b.embedding, lambda v : v::DOUBLE) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_inner_product(u, v) / nullif(sqrt(list_inner_product(u, u)) * sqrt(list_inner_product(v, v)), 0), 6) + 0.0 AS cosine FROM p""")
def cosine_similarity(spark, sf_dir):
    e = V.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", _r(G.cosine_similarity(F.col("embedding"), F.col("other")), "cosine"))


_B = V.segments_sql("bs", {0: V.BORDER})
_L = V.segments_sql("ls", V.LINES)
_ON_BORDER = f"{V.BANK_SQL}, {_B}, pts AS (SELECT event_id, x, y FROM bank), {V.feet_sql('bf', 'pts', 'event_id', 'bs')}"
_ON_BOTH = f"{_ON_BORDER}, {_L}, {V.feet_sql('lf', 'pts', 'event_id', 'ls')}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, line_ord) AS k FROM lf) WHERE k = 1)"
_DOT = "(near.fx - bf.x) * (bf.fx - bf.x) + (near.fy - bf.y) * (bf.fy - bf.y) < 0"


@query(f"WITH {_ON_BORDER} SELECT event_id, round(dist, 6) + 0.0 AS distance FROM bf")
def point_line_distance(spark, sf_dir):
    return V.bank(spark, sf_dir).select("event_id", _r(G.distance(_border(), F.col("x"), F.col("y")), "distance"))


@query(f"WITH {_ON_BORDER} SELECT event_id, round(pos, 6) + 0.0 AS pos FROM bf")
def line_project(spark, sf_dir):
    return V.bank(spark, sf_dir).select("event_id", _r(G.project(_border(), F.col("x"), F.col("y")), "pos"))


_AT = "(event_id % 500) * 5.0::DOUBLE - 1200.0"


@query(f"WITH {_B}, s AS (SELECT DISTINCT {_AT} AS a FROM events), p AS (SELECT a, {V.place_sql('bs', 'a', 'x')} AS px, {V.place_sql('bs', 'a', 'y')} AS py FROM s) SELECT event_id, round(px, 6) + 0.0 AS px, round(py, 6) + 0.0 AS py FROM events JOIN p ON a = {_AT}")
def line_interpolate(spark, sf_dir):
    p = G.interpolate(_border(), (F.col("event_id") % 500) * 5.0 - 1200.0)
    return V.bank(spark, sf_dir).select("event_id", p.alias("p")).select("event_id", _r("p.x", "px"), _r("p.y", "py"))


_SHARE = "(event_id % 500) / 200.0::DOUBLE - 1.2"
_WHOLE = "(SELECT sum(len) FROM bs)"


@query(f"WITH {_B}, s AS (SELECT DISTINCT {_SHARE} AS a FROM events), p AS (SELECT a, {V.place_sql('bs', f'a * {_WHOLE}', 'x')} AS px, {V.place_sql('bs', f'a * {_WHOLE}', 'y')} AS py FROM s) SELECT event_id, round(px, 6) + 0.0 AS px, round(py, 6) + 0.0 AS py FROM events JOIN p ON a = {_SHARE}")
def line_interpolate_share(spark, sf_dir):
    """The place at a share of the border's length; negative shares from its end, those beyond the line at its ends."""
    p = G.interpolate(_border(), (F.col("event_id") % 500) / 200.0 - 1.2, normalized=True)
    return V.bank(spark, sf_dir).select("event_id", p.alias("p")).select("event_id", _r("p.x", "px"), _r("p.y", "py"))


@query(f"WITH {_ON_BOTH} SELECT event_id, CAST(line_ord AS BIGINT) AS line_ord, round(dist, 6) + 0.0 AS distance FROM near")
def nearest_line(spark, sf_dir):
    found = observations.nearest_line(V.bank(spark, sf_dir).select("event_id", "x", "y"), V.lines(spark))
    return found.select("event_id", F.col("nearest_line").alias("line_ord"), _r("nearest_distance", "distance"))


@query(f"WITH {_ON_BOTH} SELECT event_id, {_DOT} AS is_between FROM bf JOIN near USING (event_id)")
def between_lines(spark, sf_dir):
    found = observations.nearest_line(V.bank(spark, sf_dir).select("event_id", "x", "y"), V.lines(spark))
    x, y = F.col("x"), F.col("y")
    return found.select("event_id", G.between(x, y, G.point(F.col("nearest_x"), F.col("nearest_y")), G.nearest_point(_border(), x, y)).alias("is_between"))


@query(f"WITH {_ON_BOTH} SELECT event_id, round(bf.dist * CASE WHEN {_DOT} THEN 1 ELSE -1 END, 6) + 0.0 AS distance FROM bf JOIN near USING (event_id)")
def signed_distance(spark, sf_dir):
    found = observations.signed_distance(V.bank(spark, sf_dir).select("event_id", "x", "y"), _border(), V.lines(spark), name="distance")
    return found.select("event_id", _r("distance", "distance"))


@query(f"WITH {V.OBJS_SQL} SELECT object_id, round(w * h, 6) AS area FROM objs")
def polygon_area(spark, sf_dir):
    return V.objs(spark, sf_dir).select("object_id", _r(G.area(F.col("shape")), "area"))


@query(f"WITH {V.OBJS_SQL} SELECT object_id, round(xmin + w / 2, 6) AS cx, round(ymin + h / 2, 6) AS cy FROM objs")
def polygon_centroid(spark, sf_dir):
    return V.objs(spark, sf_dir).select("object_id", G.centroid(F.col("shape")).alias("c")).select("object_id", _r("c.x", "cx"), _r("c.y", "cy"))


@query(f"WITH {V.RECTS_SQL}, {V.OBJS_SQL} SELECT location_id, round(count(object_id) / 5500.0::DOUBLE, 9) AS density FROM rects r LEFT JOIN objs o ON o.xmin > r.xmin AND o.xmin < r.xmax AND o.ymin > r.ymin AND o.ymin < r.ymax GROUP BY ALL")
def density_within(spark, sf_dir):
    points = V.objs(spark, sf_dir).select("object_id", G.point(F.col("xmin"), F.col("ymin")).alias("shape"))
    return regions.numerical_density(V.rects(spark, sf_dir), points).select("location_id", F.round("numerical_density", 9).alias("density"))


@query(f"WITH {V.PAIRS_SQL} SELECT r.location_id, count(object_id) AS n FROM rects r LEFT JOIN pairs USING (location_id) GROUP BY ALL")
def count_intersects(spark, sf_dir):
    return regions.intersecting(V.rects(spark, sf_dir), V.objs(spark, sf_dir)).select("location_id", F.col("count").cast("long").alias("n"))


@query(f"WITH {V.PAIRS_SQL} SELECT r.location_id, round(coalesce(sum(w * h), 0.0), 6) AS total_area FROM rects r LEFT JOIN pairs USING (location_id) GROUP BY ALL")
def total_area(spark, sf_dir):
    return regions.intersecting(V.rects(spark, sf_dir), V.objs(spark, sf_dir)).select("location_id", _r("total_area", "total_area"))


@query(f"""WITH {V.PAIRS_SQL},
clip AS (SELECT location_id, greatest(rx0, xmin) AS x0, least(rx1, xmax) AS x1, greatest(ry0, ymin) AS y0, least(ry1, ymax) AS y1 FROM pairs),
xs AS (SELECT location_id, x0 AS a FROM clip UNION SELECT location_id, x1 FROM clip),
slabs AS (SELECT location_id, a, lead(a) OVER (PARTITION BY location_id ORDER BY a) AS b FROM xs),
parts AS (SELECT s.location_id, a, b, y0, y1, max(y1) OVER (PARTITION BY s.location_id, a ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM slabs s JOIN clip c ON c.location_id = s.location_id AND c.x0 <= a AND c.x1 >= b WHERE b > a),
sums AS (SELECT location_id, sum((b - a) * greatest(0.0, y1 - greatest(y0, coalesce(before, y0)))) AS covered FROM parts GROUP BY ALL)
SELECT location_id, round(coalesce(covered, 0.0) / 5500.0::DOUBLE, 6) + 0.0 AS fraction FROM rects LEFT JOIN sums USING (location_id)""")
def area_fraction(spark, sf_dir):
    return regions.area_fraction(V.rects(spark, sf_dir), V.objs(spark, sf_dir)).select("location_id", _r("area_fraction", "fraction"))


def _mode_sql(column: str) -> str:
    return f"(SELECT location_id, {column} FROM (SELECT location_id, {column}, row_number() OVER (PARTITION BY location_id ORDER BY count(*) DESC, {column}) AS k FROM pairs GROUP BY location_id, {column}) WHERE k = 1)"


@query(f"WITH {V.PAIRS_SQL} SELECT location_id, b.p_brand AS majority_class_p_brand, t.p_type AS majority_class_p_type FROM rects LEFT JOIN {_mode_sql('p_brand')} b USING (location_id) LEFT JOIN {_mode_sql('p_type')} t USING (location_id)")
def majority_class(spark, sf_dir):
    return regions.intersecting(V.rects(spark, sf_dir), V.objs(spark, sf_dir), ["p_brand", "p_type"]).drop("count", "total_area")


#: Objects of two parts: the box, and the same box 3 to the right of it.
_TWO_SQL = V.PAIRS_SQL.replace(V.OBJS_SQL, f"{V.OBJS_SQL}, two AS (SELECT * FROM objs UNION ALL SELECT * REPLACE (xmin + w + 3 AS xmin, xmax + w + 3 AS xmax) FROM objs)").replace("JOIN objs o", "JOIN two o")


def _two_parts(spark, sf_dir) -> DataFrame:
    right = F.col("xmin") + F.col("w") + 3
    second = G.rectangle(right, F.col("ymin"), right + F.col("w"), F.col("ymin") + F.col("h"))
    return V.objs(spark, sf_dir).withColumn("shape", F.array("shape", second))


@query(f"""WITH {_TWO_SQL}, whole AS (SELECT DISTINCT location_id, object_id, p_brand, w, h FROM pairs),
tops AS (SELECT location_id, p_brand, row_number() OVER (PARTITION BY location_id ORDER BY count(*) DESC, p_brand) AS k FROM whole GROUP BY location_id, p_brand),
sums AS (SELECT location_id, count(*) AS n, sum(2 * w * h) AS a FROM whole GROUP BY 1)
SELECT location_id, coalesce(n, 0) AS n, round(coalesce(a, 0.0), 6) AS total_area, p_brand AS majority_class_p_brand FROM rects LEFT JOIN sums USING (location_id) LEFT JOIN (SELECT * FROM tops WHERE k = 1) USING (location_id)""")
def multipart_objects(spark, sf_dir):
    """An object of several parts counts once, with the area of all."""
    found = regions.intersecting(V.rects(spark, sf_dir), _two_parts(spark, sf_dir), ["p_brand"])
    return found.select("location_id", F.col("count").cast("long").alias("n"), _r("total_area", "total_area"), "majority_class_p_brand")


@query(f"""WITH {V.PAIRS_SQL}, met AS (SELECT * FROM pairs WHERE CASE object_id % 3 WHEN 0 THEN (xmin BETWEEN rx0 AND rx1 AND ymin BETWEEN ry0 AND ry1) OR (xmax BETWEEN rx0 AND rx1 AND ymax BETWEEN ry0 AND ry1)
  WHEN 1 THEN ymin BETWEEN ry0 AND ry1 OR ymax BETWEEN ry0 AND ry1 ELSE TRUE END),
tops AS (SELECT location_id, p_brand, row_number() OVER (PARTITION BY location_id ORDER BY count(*) DESC, p_brand) AS k FROM met GROUP BY location_id, p_brand),
sums AS (SELECT location_id, count(*) AS n, sum(CASE WHEN object_id % 3 = 2 THEN w * h ELSE 0 END) AS a FROM met GROUP BY 1)
SELECT location_id, coalesce(n, 0) AS n, round(coalesce(a, 0.0), 6) AS total_area, p_brand AS majority_class_p_brand FROM rects LEFT JOIN sums USING (location_id) LEFT JOIN (SELECT * FROM tops WHERE k = 1) USING (location_id)""")
def mixed_geometries(spark, sf_dir):
    """A layer of several types: two corners of a box, its lower and upper side, or the box."""
    x0, y0, x1, y1 = F.col("xmin"), F.col("ymin"), F.col("xmin") + F.col("w"), F.col("ymin") + F.col("h")
    corners, sides = F.array(G.point(x0, y0), G.point(x1, y1)), F.array(F.array(G.point(x0, y0), G.point(x1, y0)), F.array(G.point(x0, y1), G.point(x1, y1)))
    of = lambda k, shape: F.when(F.col("object_id") % 3 == k, shape)
    objects = V.objs(spark, sf_dir).withColumn("shape", G.any_shape(of(0, corners), of(1, sides), of(2, F.array("shape"))))
    found = regions.intersecting(V.rects(spark, sf_dir), objects, ["p_brand"], kind="any")
    return found.select("location_id", F.col("count").cast("long").alias("n"), _r("total_area", "total_area"), "majority_class_p_brand")


@query(ORACLES["area_fraction"].replace(V.PAIRS_SQL, _TWO_SQL))
def multipart_fraction(spark, sf_dir):
    return regions.area_fraction(V.rects(spark, sf_dir), _two_parts(spark, sf_dir)).select("location_id", _r("area_fraction", "fraction"))


@query(f"WITH {V.PAIRS_SQL.replace('FROM supplier)', 'FROM supplier WHERE s_acctbal < 0)')} SELECT DISTINCT object_id, p_brand FROM pairs")
def clip_layer(spark, sf_dir):
    """A local layer's objects that meet any of the source's polygons, each once."""
    source = V.rects(spark, sf_dir).join(V.read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("location_id")), "location_id", "left_semi")
    return regions.clip_layer(V.objs(spark, sf_dir), source).select("object_id", "p_brand")


@query(f"WITH {V.PAIRS_SQL} SELECT location_id, object_id FROM pairs WHERE xmin >= rx0 AND ymin >= ry0 AND xmax <= rx1 AND ymax <= ry1")
def polygon_within(spark, sf_dir):
    return regions.pairs_within(V.rects(spark, sf_dir), V.objs(spark, sf_dir)).select("location_id", "object_id")


#: Area of a quarter circle of radius 1 whose arc is QUARTER chords.
_ARC = f"({curves.QUARTER / 2} * sin(pi() / {2 * curves.QUARTER}))"


@query(f"WITH {V.RECTS_SQL} SELECT location_id, xmin - 10 AS xmin, ymin - 10 AS ymin, xmax + 10 AS xmax, ymax + 10 AS ymax, round(5500 + 320 * 10 + 4 * {_ARC} * 100, 6) AS area, TRUE AS holds FROM rects")
def buffered_regions(spark, sf_dir):
    """Bounds and area of the regions widened by 10, and whether each region lies in its widened shape."""
    found = V.rects(spark, sf_dir).select("location_id", "polygon", curves.buffered(F.col("polygon"), F.lit(10.0)).alias("wide"))
    box = found.select("location_id", G.bounds(F.col("wide")).alias("b"), _r(G.area(F.col("wide")), "area"), G.polygon_within(F.col("polygon"), F.col("wide")).alias("holds"))
    return box.select("location_id", *[_r(f"b.{c}", c) for c in ("xmin", "ymin", "xmax", "ymax")], "area", "holds")


# in a region of 50 x 110: an L with arms 40 high and 20 wide, a frame around a hole of 30 x 90, a line along two sides, a corner; `arc` is a quarter circle's area
_BUFFERS = {"bent": "3400 + 320 * r + (5 * arc - 1) * r * r", "frame": "5500 + 320 * r + 4 * arc * r * r - (30 - 2 * r) * (90 - 2 * r)", "line": "2 * 160 * r + (5 * arc - 1) * r * r", "point": "4 * arc * r * r"}
_BUFFER_SQL = ", ".join(f"round({f.replace('arc', _ARC)}, 6) AS {n}_area" for n, f in _BUFFERS.items())
_NEAR_SQL = ", ".join(f"abs(({f.replace('arc', _ARC)}) / ({f.replace('arc', '(pi() / 4)')}) - 1) < 0.001 AS {n}_near" for n, f in _BUFFERS.items() if n != "point")


@query(f"WITH {V.RECTS_SQL}, s AS (SELECT *, (1 + location_id % 7)::DOUBLE AS r FROM rects) SELECT location_id, {_BUFFER_SQL}, {_NEAR_SQL}, xmin - r AS bent_xmin, ymax + r AS bent_ymax, xmax + r AS line_xmax, ymin - r AS point_ymin FROM s")
def buffered_shapes(spark, sf_dir):
    """Buffers of shapes that aren't convex, of one with a hole, of lines and of points, by a radius of the region's own."""
    at = lambda *points: F.array(*[G.point(F.col("xmin") + x, F.col("ymin") + y) for x, y in points])
    shapes = {
        "bent": ("polygon", F.array(at((0, 0), (50, 0), (50, 40), (20, 40), (20, 110), (0, 110), (0, 0)))),
        "frame": ("polygon", F.array(at((0, 0), (50, 0), (50, 110), (0, 110), (0, 0)), at((10, 10), (40, 10), (40, 100), (10, 100), (10, 10)))),
        "line": ("line", at((0, 0), (50, 0), (50, 110))),
        "point": ("point", G.point(F.col("xmin"), F.col("ymin"))),
    }
    r = (1 + F.col("location_id") % 7).cast("double")
    found = V.rects(spark, sf_dir).select("location_id", r.alias("r"), *[curves.buffered(shape, r, kind).alias(n) for n, (kind, shape) in shapes.items()])
    near = lambda n: F.abs(G.area(F.col(n)) / F.expr(_BUFFERS[n].replace("arc", "(pi() / 4)")) - 1) < 0.001
    ends = [_r(G.bounds(F.col(n))[c], f"{n}_{c}") for n, c in (("bent", "xmin"), ("bent", "ymax"), ("line", "xmax"), ("point", "ymin"))]
    return found.select("location_id", *[_r(G.area(F.col(n)), f"{n}_area") for n in shapes], *[near(n).alias(f"{n}_near") for n in shapes if n != "point"], *ends)


@query(f"WITH {V.OBJS_SQL} SELECT p_brand, round(sum(w * h) / 10000, 6) AS hectares FROM objs GROUP BY 1")
def area_hectares(spark, sf_dir):
    return rows.area_by(V.objs(spark, sf_dir), "p_brand", F.col("shape"), name="hectares").select("p_brand", _r("hectares", "hectares"))


@query(f"WITH {V.OBJS_SQL} SELECT object_id, p_brand, 'Polygon' AS gtype, round(w * h, 6) AS area, xmin, ymin, xmax, ymax FROM objs")
def geojson_features(spark, sf_dir):
    """Objects written as GeoJSON features and read again."""
    written = geojson.features(V.objs(spark, sf_dir), "Polygon", "shape", ["object_id", "p_brand"])
    back = geojson.with_geometry(geojson.parsed(F.col("value"), written))
    box = back.select(F.col("properties")["object_id"].cast("long").alias("object_id"), F.col("properties")["p_brand"].alias("p_brand"), "gtype", _r(G.area(F.col("polygon")), "area"), G.bounds(F.col("polygon")).alias("b"))
    return box.select("object_id", "p_brand", "gtype", "area", *[F.col(f"b.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(f"WITH {V.RECTS_SQL} SELECT 'Polygon' AS gtype, location_id, 4.0::DOUBLE AS corners, round((xmax - xmin) * (ymax - ymin), 6) AS size FROM rects UNION ALL SELECT 'LineString', location_id, 2.0, round(sqrt(pow(xmax - xmin, 2) + pow(ymax - ymin, 2)), 6) FROM rects UNION ALL SELECT 'Point', location_id, 1.0, 0.0 FROM rects")
def geojson_files(spark, sf_dir):
    """Regions, their diagonals and their first corners, written as GeoJSON files and read as one layer."""
    path, found = V.written_folder(spark), V.rects(spark, sf_dir)
    low, high = G.point(F.col("xmin"), F.col("ymin")), G.point(F.col("xmin") + 50, F.col("ymin") + 110)
    for gtype, shape in (("Polygon", F.col("polygon")), ("LineString", F.array(low, high)), ("Point", low)):
        geojson.write_geojson(found.select("location_id", shape.alias("shape")), f"{path}/{gtype}", gtype, "shape", ["location_id"])
    back = rows.appended(*[geojson.read_geojson_lines(spark, f"{path}/{gtype}") for gtype in ("Polygon", "LineString", "Point")])
    corners = F.coalesce(F.size(F.element_at("polygon", 1)) - 1, F.size("line"), F.lit(1)).cast("double")
    size = F.coalesce(G.area(F.col("polygon")), G.length(F.col("line")), F.lit(0.0))
    return back.select("gtype", F.col("properties")["location_id"].cast("long").alias("location_id"), corners.alias("corners"), _r(size, "size"))


@query(f"WITH {V.OBJS_SQL} SELECT object_id, xmin AS px, ymin AS py, round(w + h, 6) AS length, round(w * h / 2, 6) AS area FROM objs")
def wkt_shapes(spark, sf_dir):
    """A point, a line and a triangle of each object, by their text."""
    x0, y0, x1, y1 = (c.cast("string") for c in (F.col("xmin"), F.col("ymin"), F.col("xmin") + F.col("w"), F.col("ymin") + F.col("h")))
    at = lambda x, y: F.concat(x, F.lit(" "), y)
    text = lambda kind, *points: F.concat(F.lit(f"{kind} ("), F.concat_ws(", ", *points), F.lit(")" * (2 if kind.endswith("(") else 1)))
    texts = V.objs(spark, sf_dir).select(
        "object_id", text("POINT", at(x0, y0)).alias("p"), text("LINESTRING", at(x0, y0), at(x1, y0), at(x1, y1)).alias("l"), text("POLYGON (", at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y0)).alias("t"),
    )
    shapes = texts.select("object_id", wkt.parse_point(F.col("p")).alias("p"), wkt.parse_line(F.col("l")).alias("l"), wkt.parse_polygon(F.col("t")).alias("t"))
    return shapes.select("object_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), _r(G.length(F.col("l")), "length"), _r(G.area(F.col("t")), "area"))


@query("""SELECT event_id, CASE WHEN value - 50 > 0 THEN 'green' ELSE 'red' END AS color, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time, round(value + 2, 6) AS x, round((event_id % 1000) + 1.5, 6) AS y FROM events""")
def timestamped_features(spark, sf_dir):
    """The middle of a line at each event as a GeoJSON feature with its time, green or red by the sign of its distance."""
    bank = V.bank(spark, sf_dir).join(V.read(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    line = F.array(G.point(F.col("x"), F.col("y")), G.point(F.col("x") + 4, F.col("y") + 3))
    made = geojson.timestamped_features(bank, line, "d", "ts", keep=["event_id"])
    at = lambda path: F.get_json_object("value", path)
    return made.select(at("$.properties.event_id").cast("long").alias("event_id"), at("$.properties.style.color").alias("color"), at("$.properties.times[0]").alias("time"), *[_r(at(f"$.geometry.coordinates[{i}]").cast("double"), c) for i, c in enumerate("xy")])


@query(f"""WITH {V.PAIRS_SQL}, sums AS (SELECT location_id, count(*) AS n, sum(w * h) AS a FROM pairs GROUP BY 1)
SELECT location_id, coalesce(n, 0) AS parts_count, round(coalesce(a, 0.0), 6) + 0.0 AS parts_total_area, b.p_brand AS parts_majority_class_p_brand FROM rects LEFT JOIN sums USING (location_id) LEFT JOIN {_mode_sql('p_brand')} b USING (location_id)""")
def region_features(spark, sf_dir):
    """A layer's configured aggregations, glued to the regions by key under the layer's name."""
    config = FeatureGeneration(count=True, total_area=True, majority_class={"columns": ["p_brand"]}, area_fraction=False)
    found = regions.region_features(V.rects(spark, sf_dir), "parts", V.objs(spark, sf_dir), config)
    return found.select("location_id", F.col("parts_count").cast("long").alias("parts_count"), _r("parts_total_area", "parts_total_area"), "parts_majority_class_p_brand")


@query(f"WITH {V.BANK_SQL} SELECT event_id, d FROM bank ORDER BY d, event_id LIMIT 5")
def head_rows(spark, sf_dir):
    return rows.head(V.bank(spark, sf_dir), 5, "d", "event_id").select("event_id", "d")


@query("SELECT event_id, event_type FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT < 1073741824")
def sample_rows(spark, sf_dir):
    """A quarter of the events."""
    return rows.sampled(V.bank(spark, sf_dir), "event_id", 0.25).select("event_id", "event_type")


@query(f"WITH {V.BANK_SQL} SELECT location_id, arg_min(event_id, (ahn_version, event_id)) AS first_event, arg_max(event_id, (ahn_version, event_id)) AS last_event FROM bank GROUP BY 1")
def positional_pick(spark, sf_dir):
    """The first and the last row of each region in order of time."""
    found = rows.ends(V.bank(spark, sf_dir), "location_id", "event_id", ["ahn_version", "event_id"])
    return found.select("location_id", F.col("first").alias("first_event"), F.col("last").alias("last_event"))


_COVER = "CASE WHEN p_size % 3 = 0 THEN 'Grasland' WHEN p_size % 3 = 1 THEN 'Gras en Akker' WHEN p_size % 5 <> 0 THEN p_brand END"


@query(f"SELECT p_partkey, CASE {_COVER} WHEN 'Grasland' THEN 0 ELSE -1 END AS crop, CASE {_COVER} WHEN 'Gras en Akker' THEN 0 ELSE -1 END AS vegetation FROM part")
def category_codes(spark, sf_dir):
    """A column of classes by the default codes of two columns."""
    crop, vegetation = features.category_codes().values()
    parts = V.read(spark, sf_dir, "part").select("p_partkey", F.expr(_COVER).alias("cover"))
    return parts.select("p_partkey", features.encode_category(F.col("cover"), crop).alias("crop"), features.encode_category(F.col("cover"), vegetation).alias("vegetation"))


@query(f"""WITH {V.PROCESSED_SQL}, shifted AS (SELECT timesteps_since_last_measurement AS t, lead(timesteps_since_last_measurement) OVER w AS f,
  distance_to_erosion_border - lag(distance_to_erosion_border) OVER w AS d, lead(distance_to_erosion_border) OVER w - distance_to_erosion_border AS fd FROM processed WINDOW w AS (PARTITION BY location_id ORDER BY ahn_version))
SELECT count(*) AS n_rows, count(*) FILTER (t IS NULL OR f IS NULL OR d IS NULL OR fd IS NULL) AS n_dropped, round(100.0 * n_dropped / n_rows, 6) AS percent_dropped FROM shifted""")
def dropped_rows(spark, sf_dir):
    """How many rows of the feature table miss a value and are dropped."""
    complete, names = features.feature_table(_processed(spark, sf_dir), DataConfiguration(number_of_lags=1, number_of_futures=1), keep_incomplete=True)
    return features.dropped_rows(complete, names["numerical"]).select("n_rows", "n_dropped", _r("percent_dropped", "percent_dropped"))


_RECT_ON_BORDER = f"{V.RECTS_SQL}, {_B}, pts AS (SELECT location_id, xmin + 25 AS x, ymin + 55 AS y FROM rects), {V.feet_sql('bf', 'pts', 'location_id', 'bs')}"


@query(f"""WITH {_RECT_ON_BORDER},
near AS (SELECT location_id, x - fx AS cx, y - fy AS cy, pos, fx, fy FROM bf),
ends AS (SELECT *, {V.place_sql('bs', 'pos - 100.0', 'x')} - fx AS ux, {V.place_sql('bs', 'pos - 100.0', 'y')} - fy AS uy, {V.place_sql('bs', 'pos + 100.0', 'x')} - fx AS vx, {V.place_sql('bs', 'pos + 100.0', 'y')} - fy AS vy FROM near)
SELECT location_id, round(0.5 * ((cx * ux + cy * uy) / nullif(sqrt(cx * cx + cy * cy) * sqrt(ux * ux + uy * uy), 0) + (cx * vx + cy * vy) / nullif(sqrt(cx * cx + cy * cy) * sqrt(vx * vx + vy * vy), 0)), 6) + 0.0 AS shape FROM ends""")
def line_shape(spark, sf_dir):
    border = spark.createDataFrame([(0, [(float(x), float(y)) for x, y in V.BORDER])], f"line_ord int, line {G.LINE}")
    return regions.centerline_shape(V.rects(spark, sf_dir), border, 100.0).select("location_id", _r("centerline_shape", "shape"))


_SCOPE_SQL = f"""{V.RECTS_SQL}, {_B}, pts AS (SELECT location_id, i, CASE WHEN i < 2 THEN xmin ELSE xmax END AS x, CASE WHEN i % 2 = 0 THEN ymin ELSE ymax END AS y FROM rects, range(4) c(i)),
{V.feet_sql('bf', 'pts', 'location_id, i', 'bs')},
scope AS (SELECT location_id, arg_min(fx, pos) AS ax, arg_min(fy, pos) AS ay, arg_max(fx, pos) AS bx, arg_max(fy, pos) AS by_ FROM bf GROUP BY ALL)"""


@query(f"WITH {_SCOPE_SQL} SELECT location_id, round(ax, 6) + 0.0 AS ax, round(ay, 6) + 0.0 AS ay, round(bx, 6) + 0.0 AS bx, round(by_, 6) + 0.0 AS by FROM scope")
def project_scope(spark, sf_dir):
    scope = V.rects(spark, sf_dir).select("location_id", G.project_polygon(F.col("polygon"), _border()).alias("s"))
    return scope.select("location_id", *[_r(F.col("s")[i][c], f"{n}{c}") for i, n in enumerate("ab") for c in "xy"])


@query(f"""WITH {_SCOPE_SQL}, n AS (SELECT *, bx - ax AS dx, by_ - ay AS dy, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS len FROM scope)
SELECT location_id, round(ax - dy * 10 / nullif(len, 0), 6) + 0.0 AS ax, round(ay + dx * 10 / nullif(len, 0), 6) + 0.0 AS ay, round(bx - dy * 10 / nullif(len, 0), 6) + 0.0 AS bx, round(by_ + dx * 10 / nullif(len, 0), 6) + 0.0 AS by FROM n""")
def offset_bank(spark, sf_dir):
    moved = V.rects(spark, sf_dir).select("location_id", G.offset(G.project_polygon(F.col("polygon"), _border()), F.lit(10.0)).alias("s"))
    return moved.select("location_id", *[_r(F.col("s")[i][c], f"{n}{c}") for i, n in enumerate("ab") for c in "xy"])


@query(f"""WITH {V.RECTS_SQL}, {_B}, unit AS (SELECT seg, ax, ay, bx, by_, -(by_ - ay) / len AS nx, (bx - ax) / len AS ny FROM bs),
corners AS (SELECT seg + 1 AS i, a.bx AS x, a.by_ AS y, (a.nx + coalesce(b.nx, a.nx)) / (1 + a.nx * coalesce(b.nx, a.nx) + a.ny * coalesce(b.ny, a.ny)) AS mx, (a.ny + coalesce(b.ny, a.ny)) / (1 + a.nx * coalesce(b.nx, a.nx) + a.ny * coalesce(b.ny, a.ny)) AS my
  FROM unit a LEFT JOIN (SELECT seg - 1 AS seg, nx, ny FROM unit) b USING (seg) UNION ALL SELECT 0, ax, ay, nx, ny FROM unit WHERE seg = 0),
moved AS (SELECT location_id, xmin, (5 + location_id % 11) * CASE WHEN location_id % 2 = 0 THEN 1 ELSE -1 END AS d FROM rects)
SELECT location_id, CAST(i AS INT) AS i, round(xmin + x + d * mx, 6) + 0.0 AS x, round(y + d * my, 6) + 0.0 AS y FROM moved, corners""")
def offset_border(spark, sf_dir):
    """The border, moved to each region, and from there to its left or right by a distance of the region's own, with mitred bends."""
    d = (5 + F.col("location_id") % 11) * F.when(F.col("location_id") % 2 == 0, 1).otherwise(-1)
    own = F.transform(_border(), lambda p: G.point(p["x"] + F.col("xmin"), p["y"]))
    found = V.rects(spark, sf_dir).select("location_id", F.explode(curves.offset_curve(own, d)).alias("line"))
    return found.select("location_id", F.posexplode("line").alias("i", "p")).select("location_id", "i", _r("p.x", "x"), _r("p.y", "y"))


def _gap_sql(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Squared distance of a point from a segment."""
    t = f"greatest(0.0, least(1.0, coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}), 0), 0.0)))"
    return f"(pow({ax} + {t} * ({bx} - {ax}) - {px}, 2) + pow({ay} + {t} * ({by} - {ay}) - {py}, 2))"


def _turn_sql(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    return f"sign(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def _segments_gap_sql(s: tuple[str, ...], t: tuple[str, ...]) -> str:
    """Squared distance of two segments; 0 if they meet."""
    ends = [_gap_sql(*s[:2], *t), _gap_sql(*s[2:], *t), _gap_sql(*t[:2], *s), _gap_sql(*t[2:], *s)]
    apart = [f"greatest({s[k]}, {s[k + 2]}) < least({t[k]}, {t[k + 2]})" for k in (0, 1)] + [f"greatest({t[k]}, {t[k + 2]}) < least({s[k]}, {s[k + 2]})" for k in (0, 1)]
    apart += [f"{_turn_sql(*s, *t[:2])} * {_turn_sql(*s, *t[2:])} > 0", f"{_turn_sql(*t, *s[:2])} * {_turn_sql(*t, *s[2:])} > 0"]
    return f"CASE WHEN {' OR '.join(apart)} THEN least({', '.join(ends)}) ELSE 0.0 END"


@query(f"""WITH {V.OBJS_SQL}, {_B}, o AS (SELECT object_id, xmin AS oax, ymin AS oay, xmax AS obx, ymin AS oby FROM objs UNION ALL SELECT object_id, xmax, ymin, xmax, ymax FROM objs)
SELECT object_id, round(sqrt(min({_segments_gap_sql(("oax", "oay", "obx", "oby"), ("bs.ax", "bs.ay", "bs.bx", "bs.by_"))})), 6) + 0.0 AS gap FROM o, bs GROUP BY 1""")
def line_gap(spark, sf_dir):
    """Distance of each object's lower and right side, as one line, from the border."""
    x0, y0, x1, y1 = F.col("xmin"), F.col("ymin"), F.col("xmin") + F.col("w"), F.col("ymin") + F.col("h")
    sides = F.array(G.point(x0, y0), G.point(x1, y0), G.point(x1, y1))
    return V.objs(spark, sf_dir).select("object_id", _r(G.line_distance(sides, _border()), "gap"))


def _box_gap_sql() -> str:
    """Squared distance of a rectangle and a segment of `ls`; 0 if they meet."""
    spans = []
    for k, low, high in (("x", "xmin", "xmax"), ("y", "ymin", "ymax")):
        a, d = f"a{k}", f"({'bx' if k == 'x' else 'by_'} - a{k})"
        flat = f"{a} BETWEEN {low} AND {high}"
        one, other = f"({low} - {a}) / {d}", f"({high} - {a}) / {d}"
        spans.append((f"CASE WHEN {d} = 0 THEN CASE WHEN {flat} THEN 0.0 ELSE 2.0 END ELSE least({one}, {other}) END", f"CASE WHEN {d} = 0 THEN CASE WHEN {flat} THEN 1.0 ELSE -1.0 END ELSE greatest({one}, {other}) END"))
    meet = f"greatest(0.0, {spans[0][0]}, {spans[1][0]}) <= least(1.0, {spans[0][1]}, {spans[1][1]})"
    corners = [_gap_sql(x, y, "ax", "ay", "bx", "by_") for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    ends = [f"(pow(greatest(0.0, xmin - {x}, {x} - xmax), 2) + pow(greatest(0.0, ymin - {y}, {y} - ymax), 2))" for x, y in (("ax", "ay"), ("bx", "by_"))]
    return f"CASE WHEN {meet} THEN 0.0 ELSE least({', '.join(corners + ends)}) END"


_M, _M1, _T = ("m.ax", "m.ay", "m.bx", "m.by_"), ("m.ox", "m.oy", "m.px", "m.py"), ("ls.ax", "ls.ay", "ls.bx", "ls.by_")
_BANK_SQL = f"""{_SCOPE_SQL}, {_L},
gaps AS (SELECT location_id, line_ord, min({_box_gap_sql()}) AS gap FROM rects, ls GROUP BY ALL),
nearest AS (SELECT location_id, arg_min(line_ord, (gap, line_ord)) AS line_ord FROM gaps GROUP BY 1),
m AS (SELECT location_id, ax, ay, bx, by_, nullif(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0) AS len, ax - (by_ - ay) / len AS ox, ay + (bx - ax) / len AS oy, bx - (by_ - ay) / len AS px, by_ + (bx - ax) / len AS py FROM scope),
sides AS (SELECT m.location_id, ls.line_ord, CASE WHEN min({_segments_gap_sql(_M1, _T)}) < min({_segments_gap_sql(_M, _T)}) THEN 1 ELSE -1 END AS side FROM m JOIN nearest USING (location_id) JOIN ls USING (line_ord) GROUP BY ALL)"""


@query(f"""WITH {V.PROCESSED_SQL}, {V.MODEL_SQL}, {_BANK_SQL},
long AS ({" UNION ALL ".join(f"SELECT location_id, ahn_version, distance_to_erosion_border + {k} * erosion_speed AS d, TIMESTAMP '{2024 + k}-01-01' AS timestamp FROM processed JOIN model USING (location_id)" for k in (1, 2, 3))})
SELECT location_id, ahn_version, timestamp, line_ord, round(ax - (by_ - ay) * d * side / len, 6) + 0.0 AS ax, round(ay + (bx - ax) * d * side / len, 6) + 0.0 AS ay,
  round(bx - (by_ - ay) * d * side / len, 6) + 0.0 AS bx, round(by_ + (bx - ax) * d * side / len, 6) + 0.0 AS by FROM long JOIN m USING (location_id) JOIN sides USING (location_id)""")
def predicted_bank(spark, sf_dir):
    """The predicted bank of every region and step."""
    long = model.unpivot_prediction(_predicted(spark, sf_dir))
    found = banks.predicted_bank(long, V.rects(spark, sf_dir), _border(), V.lines(spark))
    ends = [_r(F.col("bank")[i][c], f"{n}{c}") for i, n in enumerate("ab") for c in "xy"]
    return found.select(*KEYS, "timestamp", "line_ord", *ends)


@query("SELECT event_id, nullif(regexp_extract('urn:ogc:def:crs:EPSG::' || CASE WHEN event_id % 3 = 0 THEN 'x' ELSE (10000 + event_id % 50000)::VARCHAR END, 'EPSG::([0-9]{4,5})', 1), '') AS epsg FROM events")
def urn_codes(spark, sf_dir):
    urn = F.concat(F.lit("urn:ogc:def:crs:EPSG::"), F.when(F.col("event_id") % 3 == 0, "x").otherwise((10000 + F.col("event_id") % 50000).cast("string")))
    return V.bank(spark, sf_dir).select("event_id", epsg_from_urn(urn).alias("epsg"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 1")
def value_counts(spark, sf_dir):
    return rows.value_counts(V.bank(spark, sf_dir), "event_type")


@query(f"WITH {V.BANK_SQL} SELECT event_type, ahn_version, status, count(x) AS n FROM bank GROUP BY ALL")
def three_key_count(spark, sf_dir):
    return rows.value_counts(V.bank(spark, sf_dir), "event_type", "ahn_version", "status", of="x")


@query(f"WITH {V.BANK_SQL} SELECT event_id, status, NULL::DOUBLE AS d FROM bank WHERE status = 'OK' UNION ALL SELECT event_id, NULL, d FROM bank WHERE d < 0")
def union_rows(spark, sf_dir):
    bank = V.bank(spark, sf_dir)
    return rows.appended(bank.where("status = 'OK'").select("event_id", "status"), bank.where("d < 0").select("event_id", "d"))


@query(f"WITH {V.PROCESSED_SQL} SELECT location_id, bool_or(distance_to_erosion_border < 0) AS eroded, bool_and(distance_to_erosion_border < 0) AS always_eroded, round(min(distance_to_erosion_border), 6) + 0.0 AS lowest, round(max(distance_to_erosion_border), 6) + 0.0 AS highest, count(DISTINCT ahn_version) AS times FROM processed GROUP BY 1")
def region_reductions(spark, sf_dir):
    found = rows.reductions(_processed(spark, sf_dir), "location_id", "distance_to_erosion_border", "ahn_version")
    return found.select("location_id", F.col("any_negative").alias("eroded"), F.col("all_negative").alias("always_eroded"), _r("lowest", "lowest"), _r("highest", "highest"), "times")


def _nested_sql(relation: str, steps: list[tuple[str, str]]) -> str:
    """A relation with columns that build on one another."""
    for name, expression in steps:
        relation = f"(SELECT *, {expression} AS {name} FROM {relation})"
    return relation


def _latitude_sql(ellipsoid: tuple[float, float], name: str) -> list[tuple[str, str]]:
    """From x, y, z named {name}x ... to {name}phi and {name}lam."""
    e2 = 2 / ellipsoid[1] - 1 / ellipsoid[1] ** 2
    n = name
    steps = [(f"{n}p", f"sqrt({n}x * {n}x + {n}y * {n}y)"), (f"{n}lam", f"atan2({n}y, {n}x)"), (f"{n}phi0", f"atan2({n}z, {n}p * (1 - {e2!r}))")]
    steps += [(f"{n}phi{k + 1}", f"atan2({n}z + {e2 * ellipsoid[0]!r} * sin({n}phi{k}) / sqrt(1 - {e2!r} * sin({n}phi{k}) * sin({n}phi{k})), {n}p)") for k in range(9)]
    return [*steps, (f"{n}phi", f"{n}phi9")]


def _space_sql(ellipsoid: tuple[float, float], phi: str, lam: str, n: str) -> list[tuple[str, str]]:
    e2 = 2 / ellipsoid[1] - 1 / ellipsoid[1] ** 2
    return [(f"{n}nu", f"{ellipsoid[0]!r} / sqrt(1 - {e2!r} * sin({phi}) * sin({phi}))"), (f"{n}x", f"{n}nu * cos({phi}) * cos({lam})"), (f"{n}y", f"{n}nu * cos({phi}) * sin({lam})"), (f"{n}z", f"{n}nu * {1 - e2!r} * sin({phi})")]


def _crs_sql() -> str:
    """Oblique stereographic plane to sphere, to the Bessel ellipsoid by fixed-point steps, to space, shifted to WGS 84, and all the way back."""
    e2 = 2 / crs.BESSEL[1] - 1 / crs.BESSEL[1] ** 2
    phi0, lam0, arc = f"radians({crs.LAT0!r})", f"radians({crs.LON0!r})", math.pi / 180 / 3600
    rx, ry, rz = (t * arc for t in crs.TURN)
    k, (tx, ty, tz) = 1 + crs.PPM * 1e-6, crs.SHIFT
    constants = [("s0", f"sin({phi0})"), ("e", f"sqrt({e2!r})"), ("n", f"sqrt(1 + {e2!r} * pow(cos({phi0}), 4) / (1 - {e2!r}))"), ("r", f"sqrt({crs.BESSEL[0]!r} * (1 - {e2!r}) / pow(1 - {e2!r} * s0 * s0, 1.5) * {crs.BESSEL[0]!r} / sqrt(1 - {e2!r} * s0 * s0))"),
                 ("w1", "pow((1 + s0) / (1 - s0) * pow((1 - e * s0) / (1 + e * s0), e), n)"), ("q", "(w1 - 1) / (w1 + 1)"), ("c", "(n + s0) * (1 - q) / ((n - s0) * (1 + q))"), ("chi0", "asin((c * w1 - 1) / (c * w1 + 1))"), ("rr", f"2 * r * {crs.SCALE!r}")]
    plane = [("east", f"x - {crs.EAST!r}"), ("north", f"y - {crs.NORTH!r}"), ("far", "sqrt(east * east + north * north)"), ("beta", "2 * atan(far / rr)"), ("chi", "asin(cos(beta) * sin(chi0) + coalesce(north / nullif(far, 0), 0) * sin(beta) * cos(chi0))"),
             ("turn", "atan2(east * sin(beta), far * cos(chi0) * cos(beta) - north * sin(chi0) * sin(beta))"), ("psi", "ln((1 + sin(chi)) / (c * (1 - sin(chi)))) / (2 * n)"), ("f0", "2 * atan(exp(psi)) - pi() / 2")]
    plane += [(f"f{i + 1}", f"2 * atan(exp(psi) * pow((1 + e * sin(f{i})) / (1 - e * sin(f{i})), e / 2)) - pi() / 2") for i in range(9)]
    plane += [("blam", f"turn / n + {lam0}")]
    there = [("wx", f"{tx!r} + {k!r} * (bx - {rz!r} * by_ + {ry!r} * bz)"), ("wy", f"{ty!r} + {k!r} * ({rz!r} * bx + by_ - {rx!r} * bz)"), ("wz", f"{tz!r} + {k!r} * (-({ry!r}) * bx + {rx!r} * by_ + bz)")]
    bessel = [(("by_" if name == "by" else name), e.replace("by ", "by_ ")) for name, e in _space_sql(crs.BESSEL, "f9", "blam", "b")]
    again = [("vx", f"(gx - {tx!r}) / {k!r}"), ("vy", f"(gy - {ty!r}) / {k!r}"), ("vz", f"(gz - {tz!r}) / {k!r}"), ("ux", f"vx + {rz!r} * vy - {ry!r} * vz"), ("uy", f"-({rz!r}) * vx + vy + {rx!r} * vz"), ("uz", f"{ry!r} * vx - {rx!r} * vy + vz")]
    back = [("w", "c * pow((1 + sin(uphi)) / (1 - sin(uphi)) * pow((1 - e * sin(uphi)) / (1 + e * sin(uphi)), e), n)"), ("xi", "asin((w - 1) / (w + 1))"), ("dl", f"n * (ulam - {lam0})"), ("kk", "rr / (1 + sin(xi) * sin(chi0) + cos(xi) * cos(chi0) * cos(dl))"),
            ("backx", f"{crs.EAST!r} + kk * cos(xi) * sin(dl)"), ("backy", f"{crs.NORTH!r} + kk * (sin(xi) * cos(chi0) - cos(xi) * sin(chi0) * cos(dl))")]
    steps = [*constants, *plane, *bessel, *there, *_latitude_sql(crs.WGS, "w"), *_space_sql(crs.WGS, "wphi", "wlam", "g"), *again, *_latitude_sql(crs.BESSEL, "u"), *back]
    names = {"w": "w_", "e": "e_", "n": "n_"}
    return _nested_sql("(SELECT event_id, 120000 + value * 100 AS x, 400000 + (event_id % 1000)::DOUBLE * 100 AS y FROM events)", [(names.get(a, a), b) for a, b in _renamed(steps, names)])


def _renamed(steps: list[tuple[str, str]], names: dict[str, str]) -> list[tuple[str, str]]:
    return [(a, re.sub(r"(?<![\w.])([wen])(?![\w(.])", lambda m: names[m[1]], b)) for a, b in steps]


@query(f"SELECT event_id, round(degrees(wlam), 6) AS lon, round(degrees(wphi), 6) AS lat, sqrt((backx - x) * (backx - x) + (backy - y) * (backy - y)) < 0.001 AS returns FROM {_crs_sql()}")
def crs_round_trip(spark, sf_dir):
    """RD New to WGS 84 and back, of places in the Netherlands."""
    rd = V.bank(spark, sf_dir).select("event_id", (120000 + F.col("x") * 100).alias("x"), (400000 + F.col("y") * 100).alias("y"))
    wgs = rd.select("*", crs.to_wgs84(F.col("x"), F.col("y")).alias("w"))
    back = wgs.select("*", crs.to_rd(F.col("w.x"), F.col("w.y")).alias("b"))
    return back.select("event_id", F.round("w.x", 6).alias("lon"), F.round("w.y", 6).alias("lat"), (F.sqrt((F.col("b.x") - F.col("x")) ** 2 + (F.col("b.y") - F.col("y")) ** 2) < 0.001).alias("returns"))
