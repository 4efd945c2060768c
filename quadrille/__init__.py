"""A PySpark engine for map-tile analytics and training-data preparation."""
