"""Spark jobs that build walkable networks and generate loops over them."""
