"""Cubes: models, cuboids, building, segments, routing."""
