"""Quarryline: code-graph and knowledge analytics as ordinary Spark DataFrame queries."""
