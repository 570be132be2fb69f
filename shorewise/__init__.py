"""Geospatial change features on Spark."""
