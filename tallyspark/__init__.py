"""Paired-comparison analytics on Spark: ratings, forecasts, qualifiers, simulation and their checks."""
