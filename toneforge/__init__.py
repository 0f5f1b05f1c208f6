"""Diacritic-aware text analytics on Spark DataFrames."""
