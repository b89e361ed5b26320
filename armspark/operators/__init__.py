"""Operators on experiment tables: DataFrame in, DataFrame out."""
