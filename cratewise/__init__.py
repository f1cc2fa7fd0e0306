"""Catalogue and signal analytics as Spark DataFrame operators."""
