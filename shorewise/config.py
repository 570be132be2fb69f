"""Configuration of the feature pipeline, checked when it is made or changed."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

OPERATIONS = ("numerical_density", "count", "total_area", "area_fraction", "majority_class", "centerline_shape")


class _Checked:
    """A dataclass that checks itself again on every assignment."""

    def __setattr__(self, name, value):
        if name not in {f.name for f in fields(self)}:
            raise ValueError(f"unknown field {name}")
        known = self.__dict__.get("_made")
        old = getattr(self, name, None)
        object.__setattr__(self, name, value)
        if known:
            try:
                self.check()
            except ValueError:
                object.__setattr__(self, name, old)
                raise

    def __post_init__(self):
        self.check()
        self.__dict__["_made"] = True


@dataclass
class FeatureGeneration(_Checked):
    """Which aggregations of a layer a region gets; None or False is off."""

    numerical_density: bool | None = None
    count: bool | None = None
    total_area: bool | None = None
    area_fraction: bool | None = None
    majority_class: dict | None = None
    centerline_shape: dict | None = None

    def check(self) -> None:
        for name in OPERATIONS:
            value, kind = getattr(self, name), dict if name in ("majority_class", "centerline_shape") else bool
            if value is not None and not isinstance(value, kind):
                raise ValueError(f"{name} must be a {kind.__name__} or None")

    def active(self) -> list[str]:
        return [name for name in OPERATIONS if getattr(self, name)]


def _default_features() -> dict[str, FeatureGeneration]:
    # fixed values: the layers and columns that the features come from
    return {
        "BrpGewas": FeatureGeneration(majority_class={"columns": ["category", "gewas"]}, area_fraction=True),
        "bag:pand": FeatureGeneration(majority_class={"columns": ["gebruiksdoel"]}, area_fraction=True),
        "rws_vegetatielegger:bomen": FeatureGeneration(numerical_density=True),
        "rws_vegetatielegger:vegetatieklassen": FeatureGeneration(majority_class={"columns": ["vlklasse"]}),
        "river_centerline": FeatureGeneration(centerline_shape={"neighbourhood_radius": 100}),
    }


@dataclass(frozen=True)
class FeatureService:
    """A web feature service and the layers to read from it."""

    name: str
    url: str
    relevant_layers: tuple[str, ...]
    version: str = "1.0.0"


# fixed values: the public services that the default layers come from
DEFAULT_SERVICES = (
    FeatureService("land_use", "https://service.pdok.nl/rvo/brpgewaspercelen/wfs/v1_0", ("BrpGewas",)),
    FeatureService("building_location", "https://service.pdok.nl/lv/bag/wfs/v2_0", ("bag:pand",), "2.0.0"),
    FeatureService("vegetation", "https://geo.rijkswaterstaat.nl/services/ogc/gdr/rws_vegetatielegger/ows?version=2.0.0", ("rws_vegetatielegger:bomen", "rws_vegetatielegger:heggen", "rws_vegetatielegger:vegetatieklassen"), "2.0.0"),
)


@dataclass
class DataConfiguration(_Checked):
    number_of_lags: int = 1
    number_of_futures: int = 1
    known_numerical_columns: list[str] = field(default_factory=lambda: ["timesteps_since_last_measurement"])
    unknown_numerical_columns: list[str] = field(default_factory=lambda: ["distance_to_erosion_border"])
    known_categorical_columns: list[str] = field(default_factory=list)
    unknown_categorical_columns: list[str] = field(default_factory=list)
    use_differences_in_features: bool = True
    feature_creation_config: dict[str, FeatureGeneration] = field(default_factory=_default_features)
    prediction_region_buffer: float = 10.0
    known_wfs_services: tuple[FeatureService, ...] = DEFAULT_SERVICES
    no_of_points_for_distance_calculation: int = 3
    prediction_region_id_column_name: str = "location_id"
    timestamp_column_name: str = "ahn_version"
    use_only_certain_river_bank_points: bool = True

    def check(self) -> None:
        if self.number_of_lags < 1:
            raise ValueError("number_of_lags must be at least 1")
        if self.number_of_futures < 0:
            raise ValueError("number_of_futures must not be negative")
        if self.no_of_points_for_distance_calculation < 1:
            raise ValueError("no_of_points_for_distance_calculation must be positive")
        if not self.feature_creation_config:
            raise ValueError("feature_creation_config must not be empty")
        if not all(isinstance(c, FeatureGeneration) for c in self.feature_creation_config.values()):
            raise ValueError("feature_creation_config holds FeatureGeneration values")


def flatten(nested: dict, separator: str = "_") -> dict:
    """One level of keys, joined by the separator; the levels below the first are joined by an underscore. Lists are an error."""
    flat: dict = {}
    for key, value in nested.items():
        if isinstance(value, list):
            raise NotImplementedError("lists can't be flattened")
        inner = {f"{key}{separator}{k}": v for k, v in flatten(value).items()} if isinstance(value, dict) else {key: value}
        flat |= inner
    return flat


def shifted_name(column: str, shift: int, past: bool = True) -> str:
    return f"{'past' if past else 'future'}_{column}_{shift}"
