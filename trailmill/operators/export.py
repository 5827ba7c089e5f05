"""Loops as documents: stitched legs, bounds, shareable ids, GPX and JSON. Attribution is in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions.geo import score, xml_escape
from trailmill.functions.tags import config_hash
from trailmill.operators.requests import validated

# Fixed values.
ATTRIBUTION = "Données © les contributeurs OpenStreetMap, sous licence ODbL"
GPX_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1">\n  <metadata>\n    <name>'
GPX_DESC = "</name>\n    <desc>{attribution} — %.0f m</desc>\n"
GPX_TRACK = '    <copyright author="OpenStreetMap contributors"><license>https://opendatacommons.org/licenses/odbl/</license></copyright>\n  </metadata>\n  <trk>\n    <name>'
GPX_POINT = '      <trkpt lat="%.7f" lon="%.7f"></trkpt>\n'
GPX_POINTS, GPX_END = "</name>\n    <trkseg>\n", "    </trkseg>\n  </trk>\n</gpx>\n"
REQUEST = ("struct<start:struct<lat:double,lon:double>,distance_m:double,tolerance:double,activity:string,"
           "preferences:struct<avoid_paved:double>,max_results:int,variant:int>")


def stitched(legs: DataFrame) -> DataFrame:
    """(request_id, candidate, nodes) of legs(request_id, candidate, leg, nodes): each leg but the first starts where the one before ends."""
    whole = legs.groupBy("request_id", "candidate").agg(F.array_sort(F.collect_list(F.struct("leg", "nodes"))).alias("l"))
    joined = F.flatten(F.transform("l", lambda x, i: F.when(i == 0, x["nodes"]).otherwise(F.slice(x["nodes"], F.lit(2), F.greatest(F.size(x["nodes"]) - 1, F.lit(0))))))
    return whole.select("request_id", "candidate", joined.alias("nodes"))


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    """Least and largest coordinates of points(lat, lon) for each value of `keys`; nulls where there is no point."""
    return points.groupBy(*keys).agg(*[f(c).alias(f"{k}_{c}") for k, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")])


def displayed(ranked: DataFrame) -> DataFrame:
    """`ranked` with its place on screen: most unpaved first, equals by rank."""
    return ranked.withColumn("place", F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("part_non_bitume"), "rank")))


def number_text(x: Column) -> Column:
    """The shortest decimal text of a number between 1e-18 and 1e20, without exponent and trailing zeros."""
    text = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), "0+$", ""), "\\.$", "")
    return F.when(x == 0, "0").otherwise(text)


def request_json(r: DataFrame) -> Column:
    """A request's JSON in the field order that shareable ids hold."""
    n, q = (lambda c: number_text(F.coalesce(r[c].cast("double"), F.lit(0.0)))), lambda c: F.to_json(F.array(F.coalesce(r[c], F.lit(""))))
    text = q("activity")
    return F.concat(F.lit('{"start":{"lat":'), n("start_lat"), F.lit(',"lon":'), n("start_lon"), F.lit('},"distance_m":'), n("distance_m"), F.lit(',"tolerance":'), n("tolerance"),
                    F.lit(',"activity":'), F.substring(text, F.lit(2), F.length(text) - 2), F.lit(',"preferences":{"avoid_paved":'), n("avoid_paved"),
                    F.lit('},"max_results":'), n("max_results"), F.lit(',"variant":'), n("variant"), F.lit("}"))


def loop_id(json: Column, index: Column) -> Column:
    return F.concat(index.cast("string"), F.lit("."), F.rtrim(F.translate(F.base64(F.encode(json, "utf-8")), "+/\r\n", "-_"), F.lit("=")))


def decoded_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    """`ids` with the index and request fields of each id, and `error`, null for a good one."""
    index = F.regexp_extract(F.substring_index(column, ".", 1), "^[0-9]{1,9}", 0)
    body = F.when(F.col(column).contains("."), F.regexp_extract(column, "^[^.]*\\.([A-Za-z0-9_-]*)$", 1)).otherwise("")
    padded = F.concat(F.translate(body, "-_", "+/"), F.repeat(F.lit("="), ((4 - F.length(body) % 4) % 4).cast("int")))
    # a remainder of 1 is no base 64 at all
    raw = F.when(F.length(body) % 4 != 1, F.try_to_binary(padded, F.lit("base64")))
    opened = ids.withColumns({"index": F.when(index != "", index).cast("int"), "__r": F.from_json(F.decode(raw, "utf-8"), REQUEST)})
    r = F.col("__r")
    fields = {"start_lat": r["start"]["lat"], "start_lon": r["start"]["lon"], "distance_m": r["distance_m"], "tolerance": r["tolerance"], "activity": r["activity"],
              "avoid_paved": r["preferences"]["avoid_paved"], "max_results": r["max_results"], "variant": r["variant"]}
    bad = F.when(F.col("index").isNull() | (body == ""), "malformed id").when(r.isNull(), "unreadable request")
    checked = validated(opened.withColumns(fields).withColumn("__bad", bad))
    return checked.withColumn("error", F.coalesce("__bad", "error")).drop("__r", "__bad")


def shared_loops(ids: DataFrame, ranked: DataFrame) -> DataFrame:
    """ids(id, request_id, index) with the loop of that index in the request's ranking, else status not_found."""
    at = ranked.select("request_id", (F.col("rank") - 1).alias("index"), "candidate")
    return ids.join(at, ["request_id", "index"], "left").withColumn("status", F.when(F.col("candidate").isNull(), "not_found").otherwise("ok"))


def to_gpx(loops: DataFrame, creator: str = "trailmill") -> DataFrame:
    """(request_id, candidate, filename, gpx) of loops(request_id, candidate, length_m, distance_m, coords); none for a loop without points."""
    name = xml_escape(F.format_string("Boucle %.1f km", F.col("length_m") / 1000))
    point = lambda c: F.format_string(GPX_POINT, c["lat"], c["lon"])
    gpx = F.concat(F.lit(GPX_HEAD.format(creator=creator)), name, F.format_string(GPX_DESC.format(attribution=ATTRIBUTION), F.col("length_m")), F.lit(GPX_TRACK), name,
                   F.lit(GPX_POINTS), F.array_join(F.transform("coords", point), ""), F.lit(GPX_END))
    filename = F.format_string(f"{creator}-%.0fm.gpx", F.col("distance_m"))
    return loops.filter(F.size("coords") > 0).select("request_id", "candidate", filename.alias("filename"), gpx.alias("gpx"))


def to_loops_json(loops: DataFrame) -> DataFrame:
    """(request_id, json): one document for each request, loops(…, rank, id, length_m, unpaved_m, traffic_exposure_m, retraced_m, distance_m, coords) by rank."""
    s = score(F.col("length_m"), F.col("unpaved_m"), F.col("traffic_exposure_m"), F.col("retraced_m"), F.col("distance_m"))
    one = F.struct("rank", F.struct("id", F.struct(*[v.alias(k) for k, v in s.items()]).alias("score"), F.transform("coords", lambda c: F.array(c["lon"], c["lat"])).alias("geometry")).alias("loop"))
    grouped = loops.groupBy("request_id").agg(F.array_sort(F.collect_list(one)).alias("l"))  # at most 10 loops of a request are ranked
    return grouped.select("request_id", F.to_json(F.struct(F.transform("l", lambda x: x["loop"]).alias("loops"), F.lit(ATTRIBUTION).alias("attribution"))).alias("json"))


def to_loop_json(loops: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, candidate, json): a document for each loop with the request it answers; `loops` as for to_loops_json()."""
    s = score(F.col("length_m"), F.col("unpaved_m"), F.col("traffic_exposure_m"), F.col("retraced_m"), F.col("distance_m"))
    loop = F.struct("id", F.struct(*[v.alias(k) for k, v in s.items()]).alias("score"), F.transform("coords", lambda c: F.array(c["lon"], c["lat"])).alias("geometry"))
    asked = requests.select("request_id", F.struct(F.struct(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")).alias("start"), "distance_m", "tolerance", "activity",
                                                   F.struct("avoid_paved").alias("preferences"), "max_results", "variant").alias("request"))
    out = loops.select("request_id", "candidate", loop.alias("loop")).join(asked, "request_id")
    return out.select("request_id", "candidate", F.to_json(F.struct("loop", "request", F.lit(ATTRIBUTION).alias("attribution"))).alias("json"))


def region_document(built: DataFrame, provenance: DataFrame) -> DataFrame:
    """One JSON document of a row of bounds, built_at and config_hash: the box, where the data come from, attribution."""
    sources = provenance.agg(F.array_sort(F.collect_list(F.struct("name", "file", "sha256", "size_bytes"))).alias("sources"))  # a row for each source file
    one = built.select(F.struct("min_lat", "min_lon", "max_lat", "max_lon").alias("bbox"), "built_at", "config_hash").join(sources, F.lit(True))  # single rows
    return one.select(F.to_json(F.struct("bbox", F.struct("built_at", "sources", "config_hash").alias("data"), F.lit(ATTRIBUTION).alias("attribution"))).alias("json"))


def regions(points: DataFrame, provenance: DataFrame, built_at: str = "") -> DataFrame:
    """The document of points(lat, lon); without points the box is zeros."""
    box = bounds(points)
    return region_document(box.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in box.columns], F.lit(built_at).alias("built_at"), F.lit(config_hash()).alias("config_hash")), provenance)
