"""Kinds of roads, areas, labels and points of interest, and the dimension table of their zooms and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ordinal, name, tag value, build zoom, display zoom, default lanes, draw rank of each road kind.
ROADS = [
    (0, "Motorway", "motorway", 10, 10, 6.0, 5),
    (1, "Trunk", "trunk", 10, 10, 4.0, 4),
    (2, "Primary", "primary", 10, 10, 4.0, 4),
    (3, "Secondary", "secondary", 12, 13, 2.0, 3),
    (4, "Tertiary", "tertiary", 14, 15, 2.0, 3),
    (5, "Unclassified", "unclassified", 14, 15, 2.0, 1),
    (6, "Residential", "residential", 14, 15, 2.0, 1),
    (7, "LivingStreet", "living_street", 16, 17, 2.0, 0),
    (8, "Service", "service", 16, 17, 1.0, 0),
    (9, "Footway", None, 16, 17, 1.0, 0),
    (10, "Raceway", "raceway", 14, 15, 2.0, 0),
    (11, "Unknown", "road", 16, 17, 2.0, 0),
    (12, "MajorRoad", None, 4, 5, 6.0, 5),
    (13, "Rail", "rail", 12, 12, 1.0, 2),
    (14, "RailMinor", "light_rail", 14, 14, 1.0, 2),
    (15, "Border", None, 4, 4, 1.0, 6),
    (16, "MotorwayLink", "motorway_link", 10, 10, 1.0, 5),
    (17, "TrunkLink", "trunk_link", 10, 10, 1.0, 4),
    (18, "PrimaryLink", "primary_link", 10, 10, 1.0, 4),
    (19, "SecondaryLink", "secondary_link", 12, 13, 1.0, 3),
    (20, "TertiaryLink", "tertiary_link", 14, 15, 1.0, 3),
]
# Ordinal, name, build zoom, display zoom, draw rank of each area kind.
AREAS = [(0, "Water", 3, 3, 2), (1, "Forest", 3, 3, 3), (2, "Grass", 12, 12, 1), (3, "Building", 14, 16, 4), (4, "Land", 1, 1, 0)]
# Ordinal, name, place value, zoom of each label class; the rank is the ordinal.
LABELS = [(0, "City", "city", 4), (1, "Town", "town", 8), (2, "Village", "village", 11), (3, "Suburb", "suburb", 12), (4, "Hamlet", "hamlet", 12), (5, "Locality", "locality", 13), (6, "Water", None, 8), (7, "Park", None, 10)]
# Ordinal, name, build zoom, display zoom.
POIS = [(0, "TrafficSignal", 14, 15)]
STRUCTURES = ("None", "Bridge", "Tunnel")
EDGES = ("Connected", "Disconnected", "Cut")
#: Metres of a lane.
LANE_M = 3.7
HIGHWAY = {value: k for k, _, value, *_ in ROADS if value and k not in (13, 14)}
RAILWAY = {"rail": 13, "light_rail": 14, "narrow_gauge": 14}
PLACE = {value: k for k, _, value, _ in LABELS if value}
ZOOMS = (14, 12, 10, 8, 6, 4)


def kind_dimension(spark: SparkSession) -> DataFrame:
    """shape, ordinal, name, min_zoom, display_min_zoom, default_lanes, is_link, rank: 35 rows, fit to broadcast."""
    rows = [("road", k, name, low, show, lanes, k >= 16, rank) for k, name, _, low, show, lanes, rank in ROADS]
    rows += [("area", k, name, low, show, None, False, rank) for k, name, low, show, rank in AREAS]
    rows += [("label", k, name, zoom, zoom, None, False, k) for k, name, _, zoom in LABELS]
    rows += [("poi", k, name, low, show, None, False, 0) for k, name, low, show in POIS]
    return spark.createDataFrame(rows, "shape STRING, ordinal INT, name STRING, min_zoom INT, display_min_zoom INT, default_lanes DOUBLE, is_link BOOLEAN, rank INT")


def road_width(lanes: Column, default_lanes: Column) -> Column:
    """Metres of a carriageway: its lanes, or where none are told the kind's, at LANE_M each."""
    return F.when(lanes > 0, lanes).otherwise(default_lanes) * LANE_M
