"""Marketplace analytics expressed as Spark DataFrame plans."""
