"""Distributed operators on scene, chip, pixel and vector tables."""
