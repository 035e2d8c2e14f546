"""Timestamped property-graph analytics on Spark."""
