"""RD New (EPSG 28992) to and from WGS 84 (EPSG 4326), in closed form.

Oblique stereographic projection of the Bessel 1841 ellipsoid and a 7-parameter
position-vector shift, with the published EPSG parameters; x is always east.
"""

from __future__ import annotations

from math import asin, cos, pi, radians, sin, sqrt, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

from shorewise.functions.geometry import let, point

RD, WGS84 = 28992, 4326

# fixed values: ellipsoids (semi-major axis, inverse flattening), projection and datum shift
BESSEL, WGS = (6377397.155, 299.1528128), (6378137.0, 298.257223563)
LAT0, LON0, SCALE, EAST, NORTH = 52.15616055555555, 5.38763888888889, 0.9999079, 155000.0, 463000.0
SHIFT = (565.4171, 50.3319, 465.5524)
TURN = (-0.398957388243134, 0.343987817378283, -1.87740163998045)
PPM = 4.0725

_E2 = {e: 2 / e[1] - 1 / e[1] ** 2 for e in (BESSEL, WGS)}
_E = sqrt(_E2[BESSEL])
_PHI, _LAM = radians(LAT0), radians(LON0)
_RHO = BESSEL[0] * (1 - _E2[BESSEL]) / (1 - _E2[BESSEL] * sin(_PHI) ** 2) ** 1.5
_NU = BESSEL[0] / sqrt(1 - _E2[BESSEL] * sin(_PHI) ** 2)
_R = sqrt(_RHO * _NU)
_N = sqrt(1 + _E2[BESSEL] * cos(_PHI) ** 4 / (1 - _E2[BESSEL]))
_W1 = ((1 + sin(_PHI)) / (1 - sin(_PHI)) * ((1 - _E * sin(_PHI)) / (1 + _E * sin(_PHI))) ** _E) ** _N
_CHI00 = asin((_W1 - 1) / (_W1 + 1))
_C = (_N + sin(_PHI)) * (1 - sin(_CHI00)) / ((_N - sin(_PHI)) * (1 + sin(_CHI00)))
_W2 = _C * _W1
_CHI0 = asin((_W2 - 1) / (_W2 + 1))
_ARC = pi / 180 / 3600


def _space(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _shifted(p: Column, back: bool) -> Column:
    s, (rx, ry, rz) = 1 + PPM * 1e-6, [t * _ARC for t in TURN]
    x, y, z = p["x"], p["y"], p["z"]
    if back:
        x, y, z = [(c - t) / s for c, t in zip((x, y, z), SHIFT, strict=True)]
        return _space(x + rz * y - ry * z, -rz * x + y + rx * z, ry * x - rx * y + z)
    return _space(SHIFT[0] + s * (x - rz * y + ry * z), SHIFT[1] + s * (rz * x + y - rx * z), SHIFT[2] + s * (-ry * x + rx * y + z))


def _to_space(phi: Column, lam: Column, ellipsoid: tuple[float, float]) -> Column:
    nu = ellipsoid[0] / F.sqrt(1 - _E2[ellipsoid] * F.sin(phi) * F.sin(phi))
    return let(nu, lambda n: _space(n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1 - _E2[ellipsoid]) * F.sin(phi)))


def _to_angles(q: Column, ellipsoid: tuple[float, float]) -> Column:
    """struct<phi, lam> at height 0, by fixed-point steps."""
    x, y, z = q["x"], q["y"], q["z"]
    p, e2 = F.sqrt(x * x + y * y), _E2[ellipsoid]
    step = lambda phi, _: F.atan2(z + e2 * ellipsoid[0] / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi)) * F.sin(phi), p)
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.atan2(z, p * (1 - e2)), step)
    return F.struct(phi.alias("phi"), F.atan2(y, x).alias("lam"))


def to_rd(lon: Column, lat: Column) -> Column:
    """Point in metres of a longitude and latitude in degrees."""
    space = let(let(_to_space(F.radians(lat), F.radians(lon), WGS), lambda p: _shifted(p, back=True)), lambda p: _to_angles(p, BESSEL))

    def conformal(g: Column) -> Column:
        s = F.sin(g["phi"])
        w = F.lit(_C) * F.pow((1 + s) / (1 - s) * F.pow((1 - _E * s) / (1 + _E * s), F.lit(_E)), F.lit(_N))
        return let(let(w, lambda v: F.struct(F.asin((v - 1) / (v + 1)).alias("chi"), (_N * (g["lam"] - _LAM)).alias("turn"))), plane)

    def plane(a: Column) -> Column:
        chi, turn = a["chi"], a["turn"]
        b = 1 + F.sin(chi) * sin(_CHI0) + F.cos(chi) * cos(_CHI0) * F.cos(turn)
        return let(2 * _R * SCALE / b, lambda k: point(EAST + k * F.cos(chi) * F.sin(turn), NORTH + k * (F.sin(chi) * cos(_CHI0) - F.cos(chi) * sin(_CHI0) * F.cos(turn))))

    return let(space, conformal)


def to_wgs84(x: Column, y: Column) -> Column:
    """Point in degrees of metres in RD New."""
    g, h = 2 * _R * SCALE * tan(pi / 4 - _CHI0 / 2), 4 * _R * SCALE * tan(_CHI0) + 2 * _R * SCALE * tan(pi / 4 - _CHI0 / 2)
    east, north = x - EAST, y - NORTH
    i = F.atan2(east, h + north)
    j = F.atan2(east, g - north) - i

    def angles(a: Column) -> Column:
        chi = _CHI0 + 2 * F.atan((north - east * F.tan(a["j"] / 2)) / (2 * _R * SCALE))
        return F.struct(F.sin(chi).alias("s"), ((a["j"] + 2 * a["i"]) / _N + _LAM).alias("lam"))

    def geographic(a: Column) -> Column:
        psi = F.log((1 + a["s"]) / (_C * (1 - a["s"]))) / (2 * _N)
        return let(psi, lambda p: F.struct(_latitude(p).alias("phi"), a["lam"].alias("lam")))

    bessel = let(let(F.struct(i.alias("i"), j.alias("j")), angles), geographic)
    space = let(bessel, lambda b: _to_space(b["phi"], b["lam"], BESSEL))
    out = let(let(space, lambda p: _shifted(p, back=False)), lambda p: _to_angles(p, WGS))
    return let(out, lambda o: point(F.degrees(o["lam"]), F.degrees(o["phi"])))


def _latitude(psi: Column) -> Column:
    """Latitude on the Bessel ellipsoid of an isometric latitude, by Newton steps."""
    first = 2 * F.atan(F.exp(psi)) - pi / 2

    def step(phi: Column, _: Column) -> Column:
        s = _E * F.sin(phi)
        at = F.log(F.tan(phi / 2 + pi / 4) * F.pow((1 - s) / (1 + s), F.lit(_E / 2)))
        return phi - (at - psi) * F.cos(phi) * (1 - s * s) / (1 - _E2[BESSEL])

    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), first, step)


def transform(points: Column, source: int, target: int) -> Column:
    """A line or ring in another CRS; codes may be numbers or text."""
    source, target = int(source), int(target)
    if source == target:
        return points
    if (source, target) == (WGS84, RD):
        return F.transform(points, lambda p: to_rd(p["x"], p["y"]))
    if (source, target) == (RD, WGS84):
        return F.transform(points, lambda p: to_wgs84(p["x"], p["y"]))
    raise ValueError(f"no transform from {source} to {target}")
