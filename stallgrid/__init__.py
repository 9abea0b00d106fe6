"""Stallgrid: catalog search and search analytics as Spark jobs."""
