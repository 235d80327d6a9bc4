"""Sequence similarity and transformation analytics on PySpark."""
