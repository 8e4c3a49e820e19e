"""Shaping, routing, profiling and export of delimited and typed tables on Spark."""
