"""Whole requests: operators chained into one logical plan each."""
