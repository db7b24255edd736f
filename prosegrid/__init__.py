"""Prose corpus analytics and linting on Spark DataFrames."""
