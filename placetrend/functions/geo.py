"""Planar geometry and the one projection the engine knows, approximate and rigorous."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from placetrend.functions.numeric import let

# Published federal approximation WGS84 -> LV95, terms as (coefficient, l power, p power)
LV95_EAST = ((2600072.37, 0, 0), (211455.93, 1, 0), (-10938.51, 1, 1), (-0.36, 1, 2), (-44.54, 3, 0))
LV95_NORTH = (
    (1200147.07, 0, 0), (308807.95, 0, 1), (3745.25, 2, 0), (76.63, 0, 2), (-194.56, 2, 1), (119.79, 0, 3),
)
LV95_ORIGIN_LAT_SEC = 169028.66
LV95_ORIGIN_LON_SEC = 26782.5


def _powers(base: Column, power: int) -> Column | None:
    product = None
    for _ in range(power):
        product = base if product is None else product * base
    return product


def _polynomial(terms, lon: Column, lat: Column) -> Column:
    total = None
    for coefficient, lon_power, lat_power in terms:
        term = F.lit(coefficient)
        for part in (_powers(lon, lon_power), _powers(lat, lat_power)):
            term = term if part is None else term * part
        total = term if total is None else total + term
    return total


def wgs84_to_lv95(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(east, north) in metres, good to about one metre inside the covered country."""
    p = (lat * 3600 - LV95_ORIGIN_LAT_SEC) / 10000
    l = (lon * 3600 - LV95_ORIGIN_LON_SEC) / 10000
    return _polynomial(LV95_EAST, l, p), _polynomial(LV95_NORTH, l, p)


# The published reference frames. Ellipsoids as (semi-major axis, squared eccentricity), the shift
# from WGS84 to the local datum in metres, the projection's centre in degrees and its coordinates.
WGS84_ELLIPSOID = (6378137.0, 0.0066943799901413165)
BESSEL_ELLIPSOID = (6377397.155, 0.006674372230614)
DATUM_SHIFT = (-674.374, -15.056, -405.346)
CENTRE_LAT, CENTRE_LON = 46 + 57 / 60 + 8.66 / 3600, 7 + 26 / 60 + 22.50 / 3600
FALSE_EAST, FALSE_NORTH = 2600000.0, 1200000.0
#: Rounds of the latitude on the local ellipsoid; each takes off two to three digits, and two are enough here.
LATITUDE_ROUNDS = 6


def _sphere() -> tuple[float, float, float, float]:
    """Radius, stretch of the longitudes, latitude of the centre and constant of the conformal sphere."""
    a, e2 = BESSEL_ELLIPSOID
    e, lat = math.sqrt(e2), math.radians(CENTRE_LAT)
    radius = a * math.sqrt(1 - e2) / (1 - e2 * math.sin(lat) ** 2)
    stretch = math.sqrt(1 + e2 / (1 - e2) * math.cos(lat) ** 4)
    centre = math.asin(math.sin(lat) / stretch)
    isometric = math.log(math.tan(math.pi / 4 + lat / 2)) - e / 2 * math.log((1 + e * math.sin(lat)) / (1 - e * math.sin(lat)))
    return radius, stretch, centre, math.log(math.tan(math.pi / 4 + centre / 2)) - stretch * isometric


def bessel_to_lv95(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(east, north) of a place on the local ellipsoid, in radians, by the oblique conformal projection:
    ellipsoid to sphere, sphere to a sphere whose equator runs through the centre, and that to a cylinder."""
    radius, stretch, centre, constant = _sphere()
    e = math.sqrt(BESSEL_ELLIPSOID[1])

    def sphere() -> tuple[Column, Column]:
        isometric = F.ln(F.tan(math.pi / 4 + lat / 2)) - e / 2 * F.ln((1 + e * F.sin(lat)) / (1 - e * F.sin(lat)))
        return 2 * (F.atan(F.exp(stretch * isometric + constant)) - math.pi / 4), stretch * (lon - math.radians(CENTRE_LON))

    b, l = sphere()
    turned_lon = F.atan2(F.sin(l) * F.cos(b), math.sin(centre) * F.sin(b) + math.cos(centre) * F.cos(l) * F.cos(b))
    sin_lat = math.cos(centre) * F.sin(b) - math.sin(centre) * F.cos(b) * F.cos(l)
    return FALSE_EAST + radius * turned_lon, FALSE_NORTH + radius / 2 * F.ln((1 + sin_lat) / (1 - sin_lat))


def wgs84_to_lv95_rigorous(lat: Column, lon: Column, height: Column | float = 0.0) -> tuple[Column, Column]:
    """(east, north) in metres, good to a centimetre as far as the frames' definition goes.

    A place becomes a point in space, is shifted to the local datum, and gets its latitude on the local
    ellipsoid by rounds of a fixed-point equation, then its plane coordinates. Without a height it is taken to
    lie on the ellipsoid, which moves it by some centimetres at most. Places beyond the poles of the
    projection have no coordinates.
    """
    (a, e2), (a_local, e2_local) = WGS84_ELLIPSOID, BESSEL_ELLIPSOID
    up = F.lit(height) if isinstance(height, float) else height

    def in_space(g: Column) -> Column:
        bend = a / F.sqrt(1 - e2 * F.sin(g["lat"]) * F.sin(g["lat"]))
        flat = (bend + g["up"]) * F.cos(g["lat"])
        x, y = flat * F.cos(g["lon"]) + DATUM_SHIFT[0], flat * F.sin(g["lon"]) + DATUM_SHIFT[1]
        z = (bend * (1 - e2) + g["up"]) * F.sin(g["lat"]) + DATUM_SHIFT[2]
        return F.struct(F.sqrt(x * x + y * y).alias("p"), z.alias("z"), F.atan2(y, x).alias("lon"))

    def on_ellipsoid(s: Column) -> Column:
        def again(at: Column, _: Column) -> Column:
            bend = a_local / F.sqrt(1 - e2_local * F.sin(at) * F.sin(at))
            return F.atan2(s["z"] + e2_local * bend * F.sin(at), s["p"])

        start = F.atan2(s["z"], s["p"] * (1 - e2_local))
        return F.struct(F.aggregate(F.sequence(F.lit(1), F.lit(LATITUDE_ROUNDS)), start, again).alias("lat"), s["lon"].alias("lon"))

    def projected(g: Column) -> Column:
        east, north = bessel_to_lv95(g["lat"], g["lon"])
        return F.struct(east.alias("east"), north.alias("north"))

    place = F.struct(F.radians(lat).alias("lat"), F.radians(lon).alias("lon"), up.alias("up"))
    plane = let(let(let(place, in_space), on_ellipsoid), projected)
    known = F.when(lat.isNotNull() & lon.isNotNull() & up.isNotNull(), plane)
    return known["east"], known["north"]


def valid_location(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def ring_edges(ring: Column) -> Column:
    """ARRAY<STRUCT<x,y>> -> ARRAY<STRUCT<x1,y1,x2,y2>>, closing the ring."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def strictly_inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule along a ray to the right; a point on an edge or corner is not inside.

    Edges that lie wholly left of, above or below the point cannot change the answer.
    """

    def crosses(e: Column) -> Column:
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return F.when((e["y1"] > y) != (e["y2"] > y), x < at).otherwise(False)

    def touches(e: Column) -> Column:
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (turn == 0.0)
            & (x >= F.least(e["x1"], e["x2"]))
            & (x <= F.greatest(e["x1"], e["x2"]))
            & (y >= F.least(e["y1"], e["y2"]))
            & (y <= F.greatest(e["y1"], e["y2"]))
        )

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return odd & ~F.exists(edges, touches)
