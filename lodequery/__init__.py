"""Lodequery: analytics over searchable project knowledge on Spark."""
