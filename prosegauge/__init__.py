"""Prosegauge: text-quality analytics as Spark DataFrame plans."""
