"""Relational, learning and trajectory operators: DataFrame in, DataFrame out."""
