"""Rookery: retrieval and recruiting analytics as ordinary Spark jobs."""
