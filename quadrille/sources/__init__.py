"""Python data sources; register(spark) makes the formats osmpbf, shp and pmtiles known."""

from pyspark.sql import SparkSession

from .osmpbf import OsmPbfSource
from .pmtiles import PmTilesSource
from .shapefile import ShapeSource


def register(spark: SparkSession) -> None:
    for source in (OsmPbfSource, ShapeSource, PmTilesSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # pmtiles prunes by tile_id and z
