"""Spark-first scoring of dated, sourced text items."""
