"""Lagged, differenced and future-shifted feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from shorewise.config import DataConfiguration, shifted_name

# fixed values: ordered categories and the code of an unknown one
UNKNOWN_CATEGORY = -1
KNOWN_CATEGORIES = {
    "BrpGewas_majority_class_category": ["Grasland"],
    "rws_vegetatielegger:vegetatieklassen_majority_class_vlklasse": ["Gras en Akker"],
}


def category_codes(ordered: dict[str, list[str]] = KNOWN_CATEGORIES) -> dict[str, dict[str, int]]:
    """Codes by column: a category's place in its list."""
    return {column: {c: i for i, c in enumerate(categories)} for column, categories in ordered.items()}


def dropped_rows(complete: DataFrame, names: list[str]) -> DataFrame:
    """One row: how many rows of a feature table kept whole have a null among the columns, and what percent of all; null percent of no rows."""
    whole = reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in names], F.lit(True))
    counted = complete.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~whole).alias("n_dropped"))
    return counted.withColumn("percent_dropped", F.try_divide(F.col("n_dropped") * 100.0, F.col("n_rows")))


def counted(complete: DataFrame, names: list[str]) -> tuple[DataFrame, Observation]:
    """The rows of a feature table without nulls among the columns, and an observation of n_rows and n_dropped that is filled by the pass that uses the rows."""
    whole = reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in names], F.lit(True))
    seen = Observation()
    return complete.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(~whole).alias("n_dropped")).where(whole), seen


def write_features(df: DataFrame, path: str, config: DataConfiguration, codes: dict[str, dict[str, int]] | None = None) -> dict[str, float | None]:
    """Writes the feature table, and gives n_rows, n_dropped and percent_dropped from the same pass."""
    complete, names = feature_table(df, config, codes, keep_incomplete=True)
    rows, seen = counted(complete, names["numerical"] + names["categorical"])
    rows.write.mode("overwrite").parquet(path)
    n = seen.get
    return {**n, "percent_dropped": 100.0 * n["n_dropped"] / n["n_rows"] if n["n_rows"] else None}


def encode_category(column: Column, codes: dict[str, int]) -> Column:
    """The category's code; -1 for null and unknown ones."""
    if not codes:
        return F.lit(UNKNOWN_CATEGORY)
    pairs = [F.lit(v) for item in codes.items() for v in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), F.lit(UNKNOWN_CATEGORY))


def unknown_categories(df: DataFrame, column: str, codes: dict[str, int]) -> DataFrame:
    """Distinct values without a code."""
    return df.select(column).where(F.col(column).isNotNull() & ~F.col(column).isin(list(codes) or [""])).distinct()


def difference(column: str, key: str, time: str) -> Column:
    return F.col(column) - F.lag(column).over(Window.partitionBy(key).orderBy(time))


def shift(column: str, by: int, key: str, time: str) -> Column:
    """The value so many rows earlier in the region, or later if `by` is negative."""
    w = Window.partitionBy(key).orderBy(time)
    return F.lag(f"`{column}`", by).over(w) if by >= 0 else F.lead(f"`{column}`", -by).over(w)


def feature_table(df: DataFrame, config: DataConfiguration, codes: dict[str, dict[str, int]] | None = None, keep_incomplete: bool = False) -> tuple[DataFrame, dict[str, list[str]]]:
    """The keys and all shifted columns, rows with a null among them dropped; and the columns' names by kind.

    Shifts are by row within the region: 0 to lags - 1 to the past, 1 to futures to
    the future. Unknown numerical columns are differenced first if so configured.
    All windows are alike, so that one exchange and one sort serve them all.
    """
    key, time = config.prediction_region_id_column_name, config.timestamp_column_name
    groups = [(config.known_numerical_columns, "numerical", False), (config.unknown_numerical_columns, "numerical", config.use_differences_in_features), (config.known_categorical_columns, "categorical", False), (config.unknown_categorical_columns, "categorical", False)]
    missing = sorted({c for columns, *_ in groups for c in columns} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if unmapped := [c for columns, kind, _ in groups if kind == "categorical" for c in columns if c not in (codes or {})]:
        raise KeyError(f"no category codes for {', '.join(unmapped)}")
    w = Window.partitionBy(key).orderBy(time)
    base: list[Column] = [F.col(key), F.col(time)]
    names: dict[str, list[str]] = {"numerical": [], "categorical": []}
    made: list[tuple[str, str]] = []
    for columns, kind, differ in groups:
        for c in columns:
            name = f"{c}_as_number" if kind == "categorical" else f"{'diff_' if differ else ''}{c}_float"
            value = encode_category(F.col(f"`{c}`"), codes[c]) if kind == "categorical" else F.col(f"`{c}`").cast("double")
            base.append((value.cast("double") if not differ else value - F.lag(value).over(w)).alias(name))
            made.append((name, kind))
    shifted = []
    for name, kind in made:
        for past, shifts in ((True, range(config.number_of_lags)), (False, range(1, config.number_of_futures + 1))):
            for k in shifts:
                shifted.append(shift(name, k if past else -k, key, time).alias(shifted_name(name, k, past)))
                names[kind].append(shifted_name(name, k, past))
    out = df.select(*base).select(key, time, *shifted)
    every = names["numerical"] + names["categorical"]
    whole = reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in every], F.lit(True))
    return (out if keep_incomplete else out.where(whole)), names
