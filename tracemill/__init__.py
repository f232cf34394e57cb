"""Tracemill: trace and evaluation analytics expressed as Spark DataFrame plans."""
