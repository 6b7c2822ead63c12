"""Geodesy as Column expressions: UTM (Krueger series of the third order), footprints, great distances on the ellipsoid, degrees-minutes-seconds.

The expressions are written as SQL text, which Spark compiles like any Column; boxes on the ground are (west, south, east, north) in metres of a UTM zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 and UTM.
A, FLATTENING, SCALE, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0

N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64) * SCALE
ALPHA = (N / 2 - 2 / 3 * N**2 + 5 / 16 * N**3, 13 / 48 * N**2 - 3 / 5 * N**3, 61 / 240 * N**3)
BETA = (N / 2 - 2 / 3 * N**2 + 37 / 96 * N**3, N**2 / 48 + N**3 / 15, 17 / 480 * N**3)
DELTA = (2 * N - 2 / 3 * N**2 - 2 * N**3, 7 / 3 * N**2 - 8 / 5 * N**3, 56 / 15 * N**3)
ECCENTRIC = 2 * N**0.5 / (1 + N)


def num(x: float) -> str:
    """A double literal; plain ones are decimals in SQL."""
    return f"{x:.17e}"


def zone_sql(lat: str, lon: str) -> str:
    """Six-degree zones, with the exceptions of south-western Norway and Svalbard."""
    return f"""(CASE WHEN {lat} >= 56 AND {lat} < 64 AND {lon} >= 3 AND {lon} < 12 THEN 32
 WHEN {lat} >= 72 AND {lat} <= 84 AND {lon} >= 0 AND {lon} < 9 THEN 31 WHEN {lat} >= 72 AND {lat} <= 84 AND {lon} >= 9 AND {lon} < 21 THEN 33
 WHEN {lat} >= 72 AND {lat} <= 84 AND {lon} >= 21 AND {lon} < 33 THEN 35 WHEN {lat} >= 72 AND {lat} <= 84 AND {lon} >= 33 AND {lon} < 42 THEN 37
 ELSE cast(floor(({lon} + 180e0) / 6e0) AS bigint) % 60 + 1 END)"""


def krueger_sql(lat: str, lon: str, zone: str) -> tuple[str, str, str]:
    """The sphere's coordinates xi and eta of a position in its zone, and the tangent of the conformal latitude that both contain."""
    phi, lam = f"radians({lat})", f"radians({lon} - ({zone} * 6e0 - 183e0))"
    t = f"sinh(atanh(sin({phi})) - {num(ECCENTRIC)} * atanh({num(ECCENTRIC)} * sin({phi})))"
    return f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1e0 + {t} * {t}))", t


def series_sql(xi: str, eta: str, lat: str) -> tuple[str, str]:
    """Easting and northing from xi and eta."""
    east = " + ".join(f"{num(a)} * cos({2 * j}e0 * {xi}) * sinh({2 * j}e0 * {eta})" for j, a in enumerate(ALPHA, 1))
    north = " + ".join(f"{num(a)} * sin({2 * j}e0 * {xi}) * cosh({2 * j}e0 * {eta})" for j, a in enumerate(ALPHA, 1))
    shift = f"CASE WHEN {lat} < 0 THEN {num(FALSE_NORTHING)} ELSE 0e0 END"
    return f"({num(FALSE_EASTING)} + {num(RADIUS)} * ({eta} + {east}))", f"({shift} + {num(RADIUS)} * ({xi} + {north}))"


def utm_sql(lat: str, lon: str) -> tuple[str, str]:
    """Easting and northing in one expression each."""
    xi, eta, _ = krueger_sql(lat, lon, zone_sql(lat, lon))
    return series_sql(xi, eta, lat)


def latlon_sql(east: str, north: str, zone: str, south: str) -> tuple[str, str]:
    """Latitude and longitude from UTM; south: SQL that tells whether the false northing applies."""
    xi = f"(({north} - CASE WHEN {south} THEN {num(FALSE_NORTHING)} ELSE 0e0 END) / {num(RADIUS)})"
    eta = f"(({east} - {num(FALSE_EASTING)}) / {num(RADIUS)})"
    xi1 = f"({xi} - (" + " + ".join(f"{num(b)} * sin({2 * j}e0 * {xi}) * cosh({2 * j}e0 * {eta})" for j, b in enumerate(BETA, 1)) + "))"
    eta1 = f"({eta} - (" + " + ".join(f"{num(b)} * cos({2 * j}e0 * {xi}) * sinh({2 * j}e0 * {eta})" for j, b in enumerate(BETA, 1)) + "))"
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    lat = f"degrees({chi} + " + " + ".join(f"{num(d)} * sin({2 * j}e0 * {chi})" for j, d in enumerate(DELTA, 1)) + ")"
    return lat, f"({zone} * 6e0 - 183e0 + degrees(atan2(sinh({eta1}), cos({xi1}))))"


def gsd_sql(flight_m: str, sensor_mm: str, focal_mm: str, height_px: str) -> str:
    """Ground sample distance in cm a pixel, rounded to three digits."""
    return f"round(({flight_m} * 1e2 * ({sensor_mm} * 0.1e0)) / ({focal_mm} * 0.1e0 * {height_px}), 3)"


# Sensor heights in mm by camera model, and that of an unnamed one.
SENSOR_HEIGHTS = {"FC7303": 24.0, "FC6310": 24.0, "FC220": 24.0, "FC330": 24.0, "default": 24.0, "ZenmuseP1": 24.0}


def gsd_of_camera(flight_m: Column, height_px: Column, model: Column, focal_mm: Column, sensor_mm: Column | None = None, own_focal_mm: Column | None = None) -> Column:
    """Ground sample distance in cm a pixel: the specified focal length and sensor height, else those of the image (its focal length, and its model's sensor); null where neither is known."""
    table = F.create_map(*[F.lit(x) for k, v in SENSOR_HEIGHTS.items() for x in (k, v)])
    sensor = F.coalesce(*([sensor_mm] if sensor_mm is not None else []), F.try_element_at(table, model))
    focal = F.coalesce(focal_mm, *([own_focal_mm] if own_focal_mm is not None else []))
    return F.round(F.try_divide(flight_m * 100.0 * (sensor * 0.1), focal * 0.1 * height_px), 3)


def footprint_sql(lat: str, lon: str, width: str, height: str, gsd: str) -> dict[str, str]:
    """West, south, east and north of an image in metres."""
    e, n = utm_sql(lat, lon)
    dx, dy = f"({width} / 2e0 * ({gsd} * 1e-2))", f"({height} / 2e0 * ({gsd} * 1e-2))"
    return {"west": f"({e} - {dx})", "south": f"({n} - {dy})", "east": f"({e} + {dx})", "north": f"({n} + {dy})"}


def pixel_utm_sql(x: str, y: str, width: str, height: str, gsd: str, east: str, north: str) -> tuple[str, str]:
    return f"({east} + ({x} - {width} / 2e0) * ({gsd} * 1e-2))", f"({north} + ({height} / 2e0 - {y}) * ({gsd} * 1e-2))"


def with_distance_km(rows: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, name: str, steps: int = 6) -> DataFrame:
    """rows with the distance in km on WGS84 by Vincenty's inverse formula, with a fixed number of steps; exact to a millimetre for points that are not nearly antipodal.

    Each intermediate value is a column of its own, since the next ones use it several times."""
    b, keep = A * (1 - FLATTENING), [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.select(*keep, *[F.atan((1 - FLATTENING) * F.tan(F.radians(v))).alias(k) for k, v in (("_u1", lat1), ("_u2", lat2))], F.radians(F.col(lon2) - F.col(lon1)).alias("_l"))
    rows = rows.select(*keep, F.sin("_u1").alias("_s1"), F.cos("_u1").alias("_c1"), F.sin("_u2").alias("_s2"), F.cos("_u2").alias("_c2"), "_l", F.col("_l").alias("_lam"))
    c = F.col
    fixed = ["_s1", "_c1", "_s2", "_c2", "_l", "_lam"]
    for step in range(steps + 1):
        rows = rows.select(*keep, *fixed, F.sqrt(F.pow(c("_c2") * F.sin("_lam"), 2.0) + F.pow(c("_c1") * c("_s2") - c("_s1") * c("_c2") * F.cos("_lam"), 2.0)).alias("_ss"), (c("_s1") * c("_s2") + c("_c1") * c("_c2") * F.cos("_lam")).alias("_cs"))
        rows = rows.select(*keep, *fixed, "_ss", "_cs", F.coalesce(F.try_divide(c("_c1") * c("_c2") * F.sin("_lam"), c("_ss")), F.when(c("_ss") == 0, 0.0)).alias("_sa"))
        rows = rows.select(*keep, *fixed, "_ss", "_cs", "_sa", (1 - c("_sa") * c("_sa")).alias("_ca"))
        rows = rows.select(*keep, *fixed, "_ss", "_cs", "_sa", "_ca", (c("_cs") - F.coalesce(F.try_divide(2 * c("_s1") * c("_s2"), c("_ca")), F.lit(0.0))).alias("_cm"), (FLATTENING / 16 * c("_ca") * (4 + FLATTENING * (4 - 3 * c("_ca")))).alias("_cc"))
        if step < steps:
            sigma = F.atan2("_ss", "_cs")
            lam = c("_l") + (1 - c("_cc")) * FLATTENING * c("_sa") * (sigma + c("_cc") * c("_ss") * (c("_cm") + c("_cc") * c("_cs") * (2 * c("_cm") * c("_cm") - 1)))
            rows = rows.select(*keep, *fixed[:-1], lam.alias("_lam"))
    rows = rows.select(*keep, "_ss", "_cs", "_cm", (c("_ca") * (A * A - b * b) / (b * b)).alias("_u"))
    rows = rows.select(*keep, "_ss", "_cs", "_cm", (1 + c("_u") / 16384 * (4096 + c("_u") * (-768 + c("_u") * (320 - 175 * c("_u"))))).alias("_aa"), (c("_u") / 1024 * (256 + c("_u") * (-128 + c("_u") * (74 - 47 * c("_u"))))).alias("_bb"))
    ds = c("_bb") * c("_ss") * (c("_cm") + c("_bb") / 4 * (c("_cs") * (2 * c("_cm") * c("_cm") - 1) - c("_bb") / 6 * c("_cm") * (4 * c("_ss") * c("_ss") - 3) * (4 * c("_cm") * c("_cm") - 3)))
    return rows.select(*keep, (b * c("_aa") * (F.atan2("_ss", "_cs") - ds) / 1000.0).alias(name))


def dms(x: Column) -> tuple[Column, Column, Column]:
    """Degrees, minutes and seconds of an absolute value."""
    whole = F.floor(F.abs(x))
    minutes = (F.abs(x) - whole) * 60
    return whole, F.floor(minutes), (minutes - F.floor(minutes)) * 60
