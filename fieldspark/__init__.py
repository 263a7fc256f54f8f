"""Hourly, gap-checked, provenance-carrying environmental fields as Spark DataFrame operators."""
