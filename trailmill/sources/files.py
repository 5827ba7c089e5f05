"""Extracts and networks as files: XML and Parquet inputs, fingerprints, the built network."""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trailmill.functions.tags import config_hash
from trailmill.operators import export

FORMAT_VERSION = 2
#: Degrees of a tile of the written network: some 100 km.
TILE_DEG = 1.0
TAGS = ("highway", "surface", "access")
BOX = ("min_lat", "min_lon", "max_lat", "max_lon")
PROVENANCE = "name string, file string, sha256 string, size_bytes long"
MANIFEST = "format_version int, built_at string, config_hash string, tile_deg double, nodes long, segments long, directed_edges long, " + ", ".join(f"{c} double" for c in BOX)
#: binaryFile holds a whole file in one row; larger files are read as streams.
MAX_FINGERPRINT_BYTES = 1 << 30


def tag_map(tags: Column) -> Column:
    """map<string,string> of an array of (_k, _v); of a key given twice the first holds, a null key holds nothing."""
    known = F.filter(tags, lambda t: t["_k"].isNotNull())
    keys = F.transform(known, lambda t: t["_k"])
    first = F.filter(known, lambda t, i: F.array_position(keys, t["_k"]) == i + 1)
    return F.coalesce(F.map_from_arrays(F.transform(first, lambda t: t["_k"]), F.transform(first, lambda t: t["_v"])), F.create_map().cast("map<string,string>"))


def looked_up(ways: DataFrame, *more: str) -> DataFrame:
    """(way_id, nodes, highway, surface, access) of ways(way_id, nodes, tags), and a column for each further tag asked for."""
    return ways.select("way_id", "nodes", *[F.try_element_at("tags", F.lit(k)).alias(k) for k in (*TAGS, *more)])


def read_tagged_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of an OpenStreetMap XML extract: (node_id, lat, lon), (way_id, nodes, tags) with all tags as a map."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lat double, _lon double").load(path)
    ways = spark.read.format("xml").option("rowTag", "way").schema("_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>").load(path)
    refs = F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.array().cast("array<bigint>")).alias("nodes")
    return (nodes.select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")),
            ways.select(F.col("_id").alias("way_id"), refs, tag_map(F.col("tag")).alias("tags")))


def read_osm_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of an OpenStreetMap XML extract: (node_id, lat, lon), (way_id, nodes, highway, surface, access)."""
    nodes, ways = read_tagged_xml(spark, path)
    return nodes, looked_up(ways)


def write_osm_tables(nodes: DataFrame, ways: DataFrame, folder: str) -> None:
    """nodes(node_id, lat, lon) and ways(way_id, nodes, tags) as tables that read_osm_tables() reads."""
    nodes.select("node_id", "lat", "lon").write.parquet(f"{folder}/osm_node")
    ways.select("way_id", "nodes", "tags").write.parquet(f"{folder}/osm_way")


def read_osm_tables(spark: SparkSession, folder: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) as read_osm_xml() gives them, with columns for further tags asked for; tags are looked up as the ways are scanned."""
    nodes = spark.read.schema("node_id long, lat double, lon double").parquet(f"{folder}/osm_node")
    ways = spark.read.schema("way_id long, nodes array<bigint>, tags map<string,string>").parquet(f"{folder}/osm_way")
    return nodes, looked_up(ways, *more)


def _streamed_sha256(spark: SparkSession, path: str) -> str:
    """sha256 of a file of any size, read piece by piece in the driver's JVM through the file system that Spark reads by."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(at)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def fingerprints(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, file, sha256, size_bytes) of the files at `path`; files over MAX_FINGERPRINT_BYTES are hashed one after another, when this is called."""
    files = spark.read.format("binaryFile").load(path)
    found = files.filter(F.col("length") <= MAX_FINGERPRINT_BYTES).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > MAX_FINGERPRINT_BYTES).select("path", "length").collect()  # a row for each large file
    if large:
        found = found.unionAll(spark.createDataFrame([(r.path, r.length, _streamed_sha256(spark, r.path)) for r in large], "path string, length long, sha256 string"))
    return found.select(F.lit(name).alias("name"), F.element_at(F.split("path", "/"), -1).alias("file"), "sha256", F.col("length").alias("size_bytes"))


def write_network(nodes: DataFrame, edges: DataFrame, folder: str, provenance: DataFrame | None = None, tile_deg: float = TILE_DEG, built_at: str | None = None) -> None:
    """The built network below `folder`, with where it comes from and its figures.

    Nodes lie in tiles of `tile_deg` degrees and edges in the tile of the node they start from, so readers of an area open
    the files of its tiles alone; a full tile is many files, in order of cell or edge. `provenance` has the columns of
    fingerprints(). Counts and bounds are seen as the tables are written; the manifest is written last, so a folder without
    it is no network. A network without segments is an error, as is an edge whose start is no node. A node without a
    position lies in tile 0, 0.
    """
    spark = nodes.sparkSession
    tile = lambda c: F.coalesce(F.floor(F.col(c) / tile_deg), F.lit(0)).cast("int")
    seen, met = Observation(), Observation()
    figures = [f(F.col(c).cast("double")).alias(f"{k}_{c}") for k, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")]
    # seen above the exchanges: a range partitioning reads what lies below it once more, for its sample
    placed = nodes.withColumns({"tile_y": tile("lat"), "tile_x": tile("lon")}).repartitionByRange("tile_y", "tile_x", "cell_y", "cell_x", "node_id")
    placed = placed.sortWithinPartitions("tile_y", "tile_x", "cell_y", "cell_x").observe(seen, F.count(F.lit(1)).alias("nodes"), *figures)
    placed.write.partitionBy("tile_y", "tile_x").parquet(f"{folder}/net_node")
    start = nodes.select(F.col("node_id").alias("from_node"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), F.lit(True).alias("_known"))
    tiled = edges.join(start, "from_node", "left").withColumns({"tile_y": tile("from_lat"), "tile_x": tile("from_lon")})
    tiled = tiled.repartitionByRange("tile_y", "tile_x", "edge_id").sortWithinPartitions("tile_y", "tile_x", "edge_id")
    tiled = tiled.observe(met, F.count(F.lit(1)).alias("edges"), F.count_if(F.col("_known").isNull()).alias("astray"))
    tiled.select(*edges.columns, "from_lat", "from_lon", "tile_y", "tile_x").write.partitionBy("tile_y", "tile_x").parquet(f"{folder}/edge")
    of_nodes, of_edges = seen.get, met.get
    if not of_edges["edges"]:
        raise ValueError("the network has no segments")
    if of_edges["astray"]:
        raise ValueError(f"{of_edges['astray']} edges start from no node")
    sources = provenance if provenance is not None else spark.createDataFrame([], PROVENANCE)
    sources.select("name", "file", "sha256", "size_bytes").write.parquet(f"{folder}/provenance")
    # a box of zeros where there are no nodes
    when = built_at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    row = (FORMAT_VERSION, when, config_hash(), tile_deg, of_nodes["nodes"], of_edges["edges"] // 2, of_edges["edges"], *[of_nodes[c] or 0.0 for c in BOX])
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row: version, hash of the tag tables, tile size, counts and bounds of a written network; other versions are refused."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    version = manifest.first().format_version  # one row
    if version != FORMAT_VERSION:
        raise ValueError(f"network format {version}, expected {FORMAT_VERSION}")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_network(spark: SparkSession, folder: str, bbox: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(net_node, edge) of a written network: all of it, or the nodes in bbox = (min_lat, min_lon, max_lat, max_lon) and the edges that start in it."""
    manifest = read_manifest(spark, folder).first()
    nodes, edges = spark.read.parquet(f"{folder}/net_node"), spark.read.parquet(f"{folder}/edge")
    if bbox:
        south, west, north, east = bbox
        tiles = lambda low, high: (math.floor(low / manifest.tile_deg), math.floor(high / manifest.tile_deg))
        near = F.col("tile_y").between(*tiles(south, north)) & F.col("tile_x").between(*tiles(west, east))
        nodes = nodes.filter(near & F.col("lat").between(south, north) & F.col("lon").between(west, east))
        edges = edges.filter(near & F.col("from_lat").between(south, north) & F.col("from_lon").between(west, east))
    return nodes.drop("tile_y", "tile_x"), edges.drop("tile_y", "tile_x", "from_lat", "from_lon")


def read_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """(name, file, sha256, size_bytes) of the files a network was built from."""
    return spark.read.schema(PROVENANCE).parquet(f"{folder}/provenance")


def network_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The coverage document of a written network, from its manifest and provenance: no node is read."""
    return export.region_document(read_manifest(spark, folder), read_provenance(spark, folder))
