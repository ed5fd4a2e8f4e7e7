"""Joins, aggregates and folds on DataFrames."""
