"""Column functions of stereo cameras and marker colours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempofuse.functions.vectors import Vec, cross, dot, norm


def triangulate(u_left: Column, u_right: Column, v: Column, fx: float, fy: float, cx: float, cy: float, baseline: float) -> tuple[Column, Column, Column]:
    """Place of a point seen by both cameras; null where the disparity is not positive."""
    d = u_left - u_right
    z = F.when(d > 0, fx * baseline / F.when(d > 0, d).otherwise(1.0))
    return (u_left - cx) * z / fx, (v - cy) * z / fy, z


def depth_error(z: Column, fx: float, baseline: float, disparity_error: Column) -> Column:
    return z * z / (fx * baseline) * disparity_error


def hex_hue(colour: Column) -> Column:
    """Hue of '#rrggbb' in half degrees, 0 to 180, null for a grey."""
    r, g, b = (F.conv(F.substring(F.regexp_replace(colour, "^#", ""), k, 2), 16, 10).cast("double") for k in (1, 3, 5))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.when(high > low, high - low)
    sector = F.when(high == r, F.pmod((g - b) / span, F.lit(6.0))).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return sector * 30.0


def hue_ranges(hue: Column, tolerance: float) -> Column:
    """The range about a hue as an array of [low, high]: two where it crosses the end of the circle at 180."""
    low, high = hue - tolerance, hue + tolerance
    pair = lambda a, b: F.array(a, b)
    return (
        F.when(low < 0, F.array(pair(F.lit(0.0), high), pair(low + 180, F.lit(180.0))))
        .when(high > 180, F.array(pair(low, F.lit(180.0)), pair(F.lit(0.0), high - 180)))
        .otherwise(F.array(pair(low, high)))
    )


def hue_spans(centres: list[float], tolerance: float) -> list[tuple[float, float]]:
    """The ranges about a colour's centres, on a circle of half degrees."""
    out = []
    for c in centres:
        low, high = c - tolerance, c + tolerance
        if low < 0:
            out += [(0.0, high), (180 + low, 179.0)]
        elif high > 179:
            out += [(low, 179.0), (0.0, high - 180)]
        else:
            out.append((low, high))
    return out


def in_hues(hue: Column, centres: list[float], tolerance: float) -> Column:
    """Whether a hue is in some range of a colour with one centre or more."""
    found = F.lit(False)
    for low, high in hue_spans(centres, tolerance):
        found = found | hue.between(low, high)
    return found


def search_window(u: Column, v: Column, reach: int, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """u0, v0, u1, v1 of the square about a place, within the picture."""
    return F.greatest(F.lit(0), u - reach), F.greatest(F.lit(0), v - reach), F.least(F.lit(width), u + reach), F.least(F.lit(height), v + reach)


def best_blobs(blobs: DataFrame, by: list[str], u: str = "u", v: str = "v", area: str = "area", expected: tuple[str, str] = ("eu", "ev")) -> DataFrame:
    """One blob of each group: the nearest to where it is expected, or if that is null the one of greatest area; of equal
    ones the first in order of place."""
    far = (F.col(u) - F.col(expected[0])) * (F.col(u) - F.col(expected[0])) + (F.col(v) - F.col(expected[1])) * (F.col(v) - F.col(expected[1]))
    rank = F.struct(F.coalesce(far, -F.col(area)).alias("rank"), u, v)
    return blobs.groupBy(*by).agg(F.min_by(F.struct(u, v, area), rank).alias("b")).select(*by, f"b.{u}", f"b.{v}", f"b.{area}")


def depth_at(centre: Column, around: Column) -> Column:
    """The depth at a pixel, or where it has none (not positive) the median of the positive ones around it (an array)."""
    good = F.array_sort(F.filter(around, lambda z: (z > 0) & ~F.isnan(z)))
    n = F.size(good)
    middle = (F.get(good, ((n - 1) / 2).cast("int")) + F.get(good, (n / 2).cast("int"))) / 2
    return F.when((centre > 0) & ~F.isnan(centre), centre).otherwise(middle)


def without_offset(df: DataFrame, offsets: DataFrame, camera: str = "camera_id", axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """df with its places taken from each camera's origin to the common one. offsets has a row for each camera (dx, dy,
    dz): a rig's few, so that it is broadcast; cameras without a row are at the origin."""
    met = df.join(F.broadcast(offsets), camera, "left")
    return met.select(*[(F.col(c) - F.coalesce(F.col(f"d{c}"), F.lit(0.0))).alias(c) if c in axes else F.col(c) for c in df.columns])


def direction_quaternion(place: Vec, least: float = 1e-6) -> tuple[Column, Column, Column, Column]:
    """(w, x, y, z) of the turn from the z axis to a place's direction; none for a place nearer than `least`."""
    d = norm(place)
    way = tuple(c / F.when(d > 0, d).otherwise(1.0) for c in place)
    up = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    axis = cross(up, way)
    size, c = norm(axis), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), way[2]))
    half = F.acos(c) / 2
    flat = size < 1e-6
    turned = (F.cos(half), *(a / F.when(flat, 1.0).otherwise(size) * F.sin(half) for a in axis))
    level = (F.when(c > 0, 1.0).otherwise(0.0), F.when(c > 0, 0.0).otherwise(1.0), F.lit(0.0), F.lit(0.0))
    still = (F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return tuple(F.when(d < least, s).when(flat, f).otherwise(t) for s, f, t in zip(still, level, turned, strict=True))


def with_direction(df: DataFrame, axes: tuple[str, str, str] = ("x", "y", "z"), names: tuple[str, str, str, str] = ("qw", "qx", "qy", "qz"), least: float = 1e-6) -> DataFrame:
    """df with distance, and direction_quaternion() of its places. Each step is a column: in one expression a step is
    written out, and worked, as often as the later ones use it."""
    x, y, z = (F.col(f"__way_{a}") for a in "xyz")
    df = df.withColumn("distance", norm(tuple(F.col(a) for a in axes)))
    df = df.withColumns({f"__way_{a}": F.col(c) / F.when(F.col("distance") > 0, F.col("distance")).otherwise(1.0) for a, c in zip("xyz", axes, strict=True)})
    df = df.withColumns({"__size": F.sqrt(y * y + x * x), "__cos": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))})  # the axis is z across the way
    df = df.withColumn("__half", F.acos("__cos") / 2).withColumn("__part", F.sin("__half") / F.when(F.col("__size") < 1e-6, 1.0).otherwise(F.col("__size")))
    still, flat, up = F.col("distance") < least, F.col("__size") < 1e-6, F.col("__cos") > 0
    turned = (F.cos("__half"), -y * F.col("__part"), x * F.col("__part"), 0.0 * F.col("__part"))
    level = (F.when(up, 1.0).otherwise(0.0), F.when(up, 0.0).otherwise(1.0), F.lit(0.0), F.lit(0.0))
    found = {n: F.when(still, float(k == 0)).when(flat, f).otherwise(t) for k, (n, f, t) in enumerate(zip(names, level, turned, strict=True))}
    return df.withColumns(found).drop(*[f"__way_{a}" for a in "xyz"], "__size", "__cos", "__half", "__part")


def display_axes(up: tuple[float, float, float]) -> list[tuple[float, float, float]]:
    """Rows of the matrix that takes camera places to the display's: z is up, x the camera's right made level."""
    n = math.sqrt(sum(c * c for c in up))
    z = tuple(c / n for c in up)
    x = (1 - z[0] * z[0], -z[1] * z[0], -z[2] * z[0])
    n = math.sqrt(sum(c * c for c in x))
    x = tuple(c / n for c in x)
    return [x, (z[1] * x[2] - z[2] * x[1], z[2] * x[0] - z[0] * x[2], z[0] * x[1] - z[1] * x[0]), z]


def displayed(place: Vec, origin: Vec, up: tuple[float, float, float]) -> Vec:
    """A place from an origin in the display's axes."""
    off = tuple(p - o for p, o in zip(place, origin, strict=True))
    return tuple(dot(tuple(F.lit(c) for c in row), off) for row in display_axes(up))
