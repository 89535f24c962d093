"""Retail customer analytics expressed as Spark DataFrame operators and Spark ML jobs."""
