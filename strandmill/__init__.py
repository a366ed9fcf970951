"""Seed-and-extend sequence comparison and related data-parallel kernels on Spark."""
