"""Geometry, costs and scores as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_M, DEGREE_M, CELL_DEG = 6371008.8, 111320.0, 0.005


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres between two points in degrees; null if any is null."""
    lat1, lon1, lat2, lon2 = (F.col(x) if isinstance(x, str) else x for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # least() would pass over a null


def destination(lat: Column, lon: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    """Latitude and longitude reached on a flat earth, with bearings in radians clockwise from north."""
    return lat + metres * F.cos(bearing) / DEGREE_M, lon + metres * F.sin(bearing) / (F.lit(DEGREE_M) * F.cos(F.radians(lat)))


def cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.floor(lon / F.lit(CELL_DEG)).cast("int"), F.floor(lat / F.lit(CELL_DEG)).cast("int")


def clamp01(x: Column) -> Column:
    """x in [0, 1]; NaN and null are 0."""
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def weights(avoid_paved: Column) -> tuple[Column, Column]:
    a = clamp01(avoid_paved)
    return F.lit(6.0) * a, F.lit(2.0) + F.lit(10.0) * a


def paved_penalty(surface: Column) -> Column:
    return F.when(surface == 1, 1.0).when(surface == 2, 0.3).when(surface == 3, 0.0).otherwise(0.5)


def edge_cost(length: Column, surface: Column, traffic: Column, w_paved: Column, w_traffic: Column) -> Column:
    return length * (F.lit(1.0) + w_paved * paved_penalty(surface) + w_traffic * traffic / F.lit(255.0))


def score(length: Column, unpaved: Column, traffic_m: Column, retraced: Column, target: Column) -> dict[str, Column]:
    """The five figures of a loop; shares are 0 for an empty loop, the gap is 0 without a target."""
    share = lambda x: F.when(length > 0, x / length).otherwise(0.0)
    return {"distance_m": length, "part_non_bitume": share(unpaved), "part_trafic": share(traffic_m), "part_retracee": share(retraced),
            "ecart_cible": F.when(target > 0, (length - target) / target).otherwise(0.0)}


def loop_radius(target: Column, detour: Column) -> Column:
    return target / (F.lit(2 * math.pi) * detour)


def distance_label(metres: Column) -> Column:
    """`850 m` below a kilometre, else `1,0 km`."""
    km = F.replace(F.format_string("%.1f km", (F.round(metres / 100) / 10).cast("double")), F.lit("."), F.lit(","))
    return F.when(metres < 1000, F.format_string("%d m", F.round(metres).cast("long"))).otherwise(km)


def duration_label(minutes: Column) -> Column:
    """`59 min`, `1 h 00`, `2 h 05`."""
    m = F.round(minutes).cast("long")
    return F.when(m < 60, F.format_string("%d min", m)).otherwise(F.format_string("%d h %02d", F.expr("0") + F.floor(m / 60), m % 60))


def percent_label(part: Column) -> Column:
    """`12 %`; between 0 and 1 percent with a decimal, `0,4 %`."""
    p = part * 100
    fine = F.replace(F.format_string("%.1f %%", F.round(p * 10) / 10), F.lit("."), F.lit(","))
    return F.when((p > 0) & (p < 1), fine).otherwise(F.format_string("%d %%", F.floor(p + 0.5).cast("long")))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def gap_label(asked: Column, got: Column) -> Column:
    """What was asked for, where the loop's distance doesn't already say so; empty else."""
    km = lambda m: F.floor(m / 1000 + 0.5).cast("long")
    told = _finite(asked) & (asked > 0) & ~((km(asked) == km(got)) & (F.abs(asked - got) < 500))
    return F.when(told, F.format_string("tu en demandais %d", km(asked))).otherwise("")


def whole_km_label(metres: Column) -> Column:
    return F.when(_finite(metres), F.format_string("%d km", F.floor(metres / 1000 + 0.5).cast("long"))).otherwise("— km")


def duration_min(metres: Column, speed_kmh: Column) -> Column:
    """Minutes at a speed; 0 where either is null, not finite or not above 0."""
    fine = lambda x: (x > 0) & ~F.isnan(x) & (x < float("inf"))
    return F.when(fine(metres) & fine(speed_kmh), metres / 1000 / speed_kmh * 60).otherwise(0.0)


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
