"""Points, areas, settings and client keys as column expressions. Null and NaN coordinates are in no area."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIN_SETTING_M, MAX_SETTING_M, DEFAULT_SETTING_M, DEFAULT_AVOID_PAVED = 2_000.0, 50_000.0, 12_000.0, 0.7
SAME_POINT_DEG = 1e-5


def _within(x: Column, low: Column, high: Column) -> Column:
    """Bounds included; Spark holds NaN above all numbers, so the upper bound would only keep it out where it is finite."""
    return F.coalesce(~F.isnan(x) & (x >= low) & (x <= high), F.lit(False))


def in_bbox(lat: Column, lon: Column, min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    return _within(lat, min_lat, max_lat) & _within(lon, min_lon, max_lon)


def bbox_center(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> tuple[Column, Column]:
    return (min_lat + max_lat) / 2, (min_lon + max_lon) / 2


def valid_lat(lat: Column) -> Column:
    return _within(lat, F.lit(-90.0), F.lit(90.0))


def valid_lon(lon: Column) -> Column:
    return _within(lon, F.lit(-180.0), F.lit(180.0))


def valid_coord(lat: Column, lon: Column) -> Column:
    return valid_lat(lat) & valid_lon(lon)


def same_point(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    near = lambda x, y: F.coalesce(~F.isnan(x - y) & (F.abs(x - y) < SAME_POINT_DEG), F.lit(False))
    return near(lat1, lat2) & near(lon1, lon2)


def clamp_settings(distance_m: Column, avoid_paved: Column) -> tuple[Column, Column]:
    """Settings in their bounds; what is null or not finite becomes the default."""

    def bounded(x: Column, low: float, high: float, default: float) -> Column:
        odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(odd, default).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), x)))

    return bounded(distance_m, MIN_SETTING_M, MAX_SETTING_M, DEFAULT_SETTING_M), bounded(avoid_paved, 0.0, 1.0, DEFAULT_AVOID_PAVED)


def point_label(lat: Column, lon: Column) -> Column:
    """`48,1173, -1,6778`."""
    number = lambda x: F.replace(F.format_string("%.4f", x), F.lit("."), F.lit(","))
    return F.concat(number(lat), F.lit(", "), number(lon))


def host_of(address: Column) -> Column:
    """The host of `host:port` or `[host]:port`; any other address as it is."""
    plain, bracketed = r"^([^:\[\]]*):[^:\[\]]*$", r"^\[([^\[\]]*)\]:[^:\[\]]*$"
    return F.when(address.rlike(plain), F.regexp_extract(address, plain, 1)).when(address.rlike(bracketed), F.regexp_extract(address, bracketed, 1)).otherwise(address)


def client_key(peer: Column, forwarded: Column, trusted: list[str]) -> Column:
    """The peer's host or, only behind a trusted peer, the last forwarded entry: earlier ones are the client's own claims."""
    last = host_of(F.trim(F.element_at(F.split(forwarded, ","), -1)))
    use = host_of(peer).isin(*trusted) & (F.coalesce(forwarded, F.lit("")) != "") if trusted else F.lit(False)
    return F.when(use, last).otherwise(host_of(peer))


def places(features_json: Column) -> Column:
    """Places (name, complement, lat, lon, distance_m) of a document of address features; an empty array without any."""
    schema = "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<name:string,postcode:string,city:string,type:string,context:string,distance:double>>>"

    def place(x: Column) -> Column:
        p, at = x["properties"], x["geometry"]["coordinates"]
        department = F.trim(F.get(F.split(p["context"], ","), F.lit(1)))
        town = F.when(F.coalesce(department, F.lit("")) != "", F.concat(F.lit("Commune, "), department)).otherwise("Commune")
        parts = F.filter(F.array(p["postcode"], p["city"]), lambda s: s.isNotNull() & (s != ""))
        return F.struct(p["name"].alias("name"), F.when(p["type"] == "municipality", town).otherwise(F.array_join(parts, " ")).alias("complement"),
                        F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon"), p["distance"].alias("distance_m"))

    found = F.from_json(features_json, schema)["features"]
    return F.transform(F.coalesce(found, F.from_json(F.lit('{"features": []}'), schema)["features"]), place)
