"""Telling machine-written from human-written text with Spark DataFrames and ``pyspark.ml``."""
