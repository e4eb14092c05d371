"""Quarrymill: retrieval and corpus analytics as plain PySpark DataFrame plans."""
