"""Terrain-aware mobility analytics as Spark DataFrame transformations."""
