"""Operators on profile tables: DataFrame in, DataFrame out."""
