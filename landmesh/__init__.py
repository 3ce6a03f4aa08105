"""Landscape connectivity analytics, expressed as Spark DataFrame plans."""
