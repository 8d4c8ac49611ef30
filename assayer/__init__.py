"""Declarative schema validation on Spark."""
