"""Strata: corpus evidence operators expressed as Spark DataFrame plans."""
