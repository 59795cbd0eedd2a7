"""Ensemble forecast verification and corpus operators as Spark DataFrame transformations."""
