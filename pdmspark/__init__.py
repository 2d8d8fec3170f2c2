"""Predictive-maintenance analytics on long, multi-machine sensor series, as Spark DataFrame operators."""
