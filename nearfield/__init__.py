"""Neighbourhood, density and trajectory analytics as lazy Spark DataFrame queries."""
