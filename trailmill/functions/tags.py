"""Which ways are walkable, and what their tags say."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Way classes 1 path, 2 track, 3 footway, 4 residential, 5 tertiary, 6 secondary; traffic 0-255.
WAY_CLASSES = {
    "bridleway": (1, 0), "cycleway": (3, 10), "footway": (3, 0), "living_street": (4, 40), "path": (1, 0), "pedestrian": (3, 10),
    "residential": (4, 90), "secondary": (6, 255), "service": (4, 60), "tertiary": (5, 180), "track": (2, 0), "unclassified": (4, 120)}
# Surfaces 1 paved, 2 gravel, 3 ground.
SURFACES = {
    "asphalt": 1, "cobblestone": 1, "compacted": 2, "concrete": 1, "dirt": 3, "earth": 3, "fine_gravel": 2, "grass": 3, "gravel": 2, "ground": 3,
    "mud": 3, "paved": 1, "paving_stones": 1, "pebblestone": 2, "sand": 3, "sett": 1, "unpaved": 3, "woodchips": 3}
DEFAULT_SURFACES = {1: 3, 2: 3, 3: 1, 4: 1, 5: 1, 6: 1}
CLASS_NAMES = {1: "path", 2: "track", 3: "footway", 4: "residential", 5: "tertiary", 6: "secondary"}


def _lookup(column: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)


def classify_ways(ways: DataFrame) -> DataFrame:
    """(way_id, nodes, way_class, surface, traffic, tagged) of the walkable ways of (way_id, nodes, highway, surface, access).

    Other values of highway, private or forbidden access and fewer than two references drop a way.
    """
    klass = _lookup(F.col("highway"), {k: v[0] for k, v in WAY_CLASSES.items()})
    traffic = _lookup(F.col("highway"), {k: v[1] for k, v in WAY_CLASSES.items()})
    known = _lookup(F.col("surface"), SURFACES)
    open_ = F.col("access").isNull() | ~F.col("access").isin("private", "no")
    kept = ways.filter(F.col("highway").isin(*WAY_CLASSES) & open_ & (F.size("nodes") >= 2))
    return kept.select("way_id", "nodes", klass.alias("way_class"), F.coalesce(known, _lookup(klass, DEFAULT_SURFACES)).alias("surface"),
                       traffic.alias("traffic"), F.col("surface").isNotNull().alias("tagged"))


def config_hash() -> str:
    """A fingerprint of the tables above."""
    lines = [f"way\t{k}\t{c}\t{t}\n" for k, (c, t) in sorted(WAY_CLASSES.items())]
    lines += [f"surface\t{k}\t{c}\n" for k, c in sorted(SURFACES.items())] + [f"default\t{k}\t{v}\n" for k, v in sorted(DEFAULT_SURFACES.items())]
    return hashlib.sha256("".join(lines).encode()).hexdigest()[:16]
