"""Inspection analytics as Spark jobs."""
