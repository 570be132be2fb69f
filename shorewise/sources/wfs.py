"""Web feature services.

`read_services` reads layers of services within boxes that are rows of a DataFrame,
each feature once. Many services refuse to go on beyond a start index, so a box that
holds more features is cut in four until its parts don't: counts are asked for
first, then parts are dealt over tasks and read page by page.

A layer within one box is also a Spark data source:

    spark.dataSource.register(FeatureServiceSource)
    spark.read.format("wfs").option("url", ...).option("layers", "a,b").option("boxes", "x0 y0 x1 y1;...").load()

Pages: the first page's length is the step, and an empty page ends them. Rows hold the
feature as JSON text and the CRS name; sources.geojson turns them into geometry.
Features are asked for on executors, never when the source is set up.
"""

from __future__ import annotations

import importlib
import json
import math
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import urlopen
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shorewise.functions.geometry import bounds

# fixed values: what services allow and take
PAGE, DEFAULT_VERSION, MAX_PAGES, TRIES, MAX_START = 10_000, "1.0.0", 100_000, 3, 50_000
#: How often a box is cut in four, at most.
MAX_CUTS = 30


def http_transport(url: str, query: dict) -> dict:
    """The service's answer to one request."""
    with urlopen(f"{url}{'&' if '?' in url else '?'}{urlencode(query)}", timeout=60) as answer:  # noqa: S310
        return json.load(answer)


def http_capabilities(url: str, query: dict) -> bytes:
    """The service's description of itself, as XML."""
    with urlopen(f"{url}{'&' if '?' in url else '?'}{urlencode(query)}", timeout=60) as answer:  # noqa: S310
        return answer.read()


def layers_offered(capabilities: bytes) -> set[str]:
    """Names of the layers in a service's description, each with and without its prefix."""
    root = ElementTree.fromstring(capabilities)
    types = [e for e in root.iter() if e.tag.rpartition("}")[2] == "FeatureType"]
    names = [(e.text or "").strip() for t in types for e in t if e.tag.rpartition("}")[2] == "Name"]
    return {x for n in names if n for x in (n, n.rpartition(":")[2])}


def check_layers(services, ask: Callable[[str, dict], bytes] = http_capabilities) -> None:
    """Asks each service what it offers; an error names all relevant layers that aren't there."""
    missing = []
    for s in services:
        offered = layers_offered(ask(s.url, {"service": "WFS", "version": s.version, "request": "GetCapabilities"}))
        missing += [f"{s.name}: {layer}" for layer in s.relevant_layers if layer not in offered]
    if missing:
        raise ValueError(f"layers not offered: {', '.join(missing)}")


class TooMany(Exception):
    """There are more features than the service gives for one box."""


def _answer(ask: Callable[[], dict], tries: int = TRIES, pause: float = 1.0) -> dict:
    """The answer, asked for again after a failure, with longer and longer pauses."""
    for t in range(tries):
        try:
            return ask()
        except OSError:
            if t + 1 == tries:
                raise
            time.sleep(pause * 2**t)
    raise ValueError("no tries")


def pages(fetch: Callable[[int, int], dict], page: int = PAGE, max_pages: int = MAX_PAGES, tries: int = TRIES, pause: float = 1.0, total: int | None = None, max_start: int | None = None) -> Iterator[tuple[list[dict], str | None]]:
    """Features of each page with the first page's CRS name. fetch takes the number wanted and the start.

    Ends with an empty page, or with `total` features if that is known. A start beyond max_start isn't asked for: TooMany.
    """
    get = lambda n, start: _answer(lambda: fetch(n, start), tries, pause)
    first = get(page, 0)
    found = first.get("features") or []
    crs, step, start = ((first.get("crs") or {}).get("properties") or {}).get("name"), len(found), 0
    for _ in range(max_pages):
        if not found:
            return
        yield found, crs
        start += step
        if total is not None and start >= total:
            return
        if max_start is not None and start > max_start:
            raise TooMany
        found = get(step, start).get("features") or []
    raise RuntimeError(f"more than {max_pages} pages")


Box = tuple[float, float, float, float]


def request(layer: str, version: str, box: str, n: int, start: int) -> dict:
    """The query for some features of a layer, within a box if it isn't empty."""
    new = version >= "2"
    query = {"service": "WFS", "version": version, "request": "GetFeature", ("typeNames" if new else "typeName"): layer, "outputFormat": "json", ("count" if new else "maxFeatures"): n, "startIndex": start}
    return query | ({"bbox": box.replace(" ", ",")} if box else {})


def quarters(box: Box) -> list[Box]:
    x0, y0, x1, y1 = box
    x, y = (x0 + x1) / 2, (y0 + y1) / 2
    return [(x0, y0, x, y), (x, y0, x1, y), (x0, y, x, y1), (x, y, x1, y1)]


def _cut(box: Box, cuts: int) -> list[tuple[Box, int]]:
    if cuts >= MAX_CUTS or math.isinf(box[2] - box[0] + box[3] - box[1]) or (box[0] == box[2] and box[1] == box[3]):
        raise ValueError(f"more features than the service gives in one place, at {box}")
    return [(q, cuts + 1) for q in quarters(box)]


def parts_of(box: Box, count: Callable[[Box], int | None], most: int) -> Iterator[tuple[Box, int | None]]:
    """Parts of a box with at most so many features each, and their number; None where the service doesn't count. Empty parts are left out."""
    todo = [(box, 0)]
    while todo:
        part, cuts = todo.pop()
        n = count(part)
        if n is None or n <= most:
            if n != 0:
                yield part, n
        else:
            todo += _cut(part, cuts)


def features_within(box: Box, n: int | None, fetch: Callable[[Box], Callable[[int, int], dict]], max_start: int, **options) -> Iterator[tuple[Box, dict, str | None]]:
    """Each feature with the box that it was asked for with. If n isn't known and the service has more than it gives, the box's quarters are read instead."""
    todo = [(box, n, 0)]
    while todo:
        part, total, cuts = todo.pop()
        try:
            for found, crs in pages(fetch(part), total=total, max_start=max_start, **options):
                for feature in found:
                    yield part, feature, crs
        except TooMany:
            todo += [(q, None, c) for q, c in _cut(part, cuts)]


class _LayerBox(InputPartition):
    def __init__(self, layer: str, box: str):
        self.layer, self.box = layer, box


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[_LayerBox]:
        layers = [x for x in self.options["layers"].split(",") if x]
        return [_LayerBox(layer, box) for layer in layers for box in self.options.get("boxes", "").split(";")]

    def read(self, partition: _LayerBox) -> Iterator[tuple]:
        module, _, name = self.options.get("transport", f"{__name__}:http_transport").partition(":")
        transport = getattr(importlib.import_module(module), name)
        version = self.options.get("version", DEFAULT_VERSION)

        def fetch(n: int, start: int) -> dict:
            return transport(self.options["url"], request(partition.layer, version, partition.box, n, start))

        for found, crs in pages(fetch, int(self.options.get("page", PAGE)), pause=float(self.options.get("pause", 1))):
            for feature in found:
                yield partition.layer, partition.box, json.dumps(feature), crs


class FeatureServiceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wfs"

    def schema(self) -> str:
        return "layer string, box string, feature string, crs string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def boxes_of(regions: DataFrame, buffer: float = 10.0) -> DataFrame:
    """(xmin, ymin, xmax, ymax): the regions' bounds, widened by the buffer."""
    rows = regions.select(bounds(F.col("polygon")).alias("b")).where("b.xmin IS NOT NULL")
    return rows.select(*[(F.col(f"b.{c}") + (buffer if c.endswith("max") else -buffer)).alias(c) for c in BOX]).distinct()


BOX = ["xmin", "ymin", "xmax", "ymax"]
_PART = "service string, url string, version string, layer string, xmin double, ymin double, xmax double, ymax double, n long"
_FEATURE = "service string, layer string, box string, id string, feature string, crs string"


def _counted(answer: dict) -> int | None:
    for name in ("numberMatched", "totalFeatures"):
        if isinstance(answer.get(name), int):
            return answer[name]
    return None


def read_services(
    spark: SparkSession, services, boxes: DataFrame, only: str | None = None, *, transport: Callable[[str, dict], dict] = http_transport, ask: Callable[[str, dict], bytes] | None = http_capabilities, page: int = PAGE, max_start: int = MAX_START, pause: float = 1.0,
) -> DataFrame:
    """(service, layer, id, feature, crs): the features of all services' relevant layers (or of the service named) that meet any of the boxes (xmin, ymin, xmax, ymax).

    Each feature comes once, however many boxes and parts of boxes it meets: it is told by its id, and where it
    has none by its text, of which as many are kept as one box has. The services are first asked whether they offer the layers,
    unless ask is None.
    """
    chosen = [s for s in services if only in (None, s.name)]
    if not chosen:
        raise ValueError(f"unknown service {only}")
    if ask is not None:
        check_layers(chosen, ask)

    def fetch_of(row) -> Callable[[Box], Callable[[int, int], dict]]:
        return lambda box: lambda n, start: transport(row.url, request(row.layer, row.version, " ".join(map(repr, box)), n, start))

    def planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                fetch = fetch_of(row)
                count = lambda box: _counted(_answer(lambda: fetch(box)(1, 0), pause=pause))  # noqa: B023, E731
                for box, n in parts_of((row.xmin, row.ymin, row.xmax, row.ymax), count, max_start):
                    yield pd.DataFrame([(row.service, row.url, row.version, row.layer, *box, n)], columns=["service", "url", "version", "layer", *BOX, "n"]).astype({"n": "Int64"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n = None if pd.isna(row.n) else int(row.n)
                rows: list[tuple] = []
                for box, feature, crs in features_within((row.xmin, row.ymin, row.xmax, row.ymax), n, fetch_of(row), max_start, page=page, pause=pause):
                    own = feature.get("id")
                    rows.append((row.service, row.layer, repr(box), None if own is None else str(own), json.dumps(feature), crs))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=["service", "layer", "box", "id", "feature", "crs"])
                        rows = []
                yield pd.DataFrame(rows, columns=["service", "layer", "box", "id", "feature", "crs"])

    layers = F.array(*[F.struct(F.lit(s.name).alias("service"), F.lit(s.url).alias("url"), F.lit(s.version).alias("version"), F.lit(layer).alias("layer")) for s in chosen for layer in s.relevant_layers])
    # a row each, so that tasks share the boxes, and then the parts of crowded ones
    asked = boxes.select(*[F.col(c).cast("double") for c in BOX], F.explode(layers).alias("s")).select("s.*", *BOX)
    parts = asked.repartition("layer", *BOX).mapInPandas(planned, _PART)
    found = parts.repartition("service", "layer", *BOX).mapInPandas(read, _FEATURE)
    key = ["service", "layer", "__key"]
    rows = found.withColumn("__key", F.coalesce("id", F.concat(F.lit("\x00"), F.md5("feature"))))
    rows = rows.withColumn("__copy", F.when(F.col("id").isNull(), F.row_number().over(Window.partitionBy(*key, "box").orderBy("feature"))).otherwise(1))
    return rows.dropDuplicates([*key, "__copy"]).select("service", "layer", "id", "feature", "crs")
