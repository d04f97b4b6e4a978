"""Strandline: evidence-aware time-series relational operators for PySpark."""
