"""Operators over readings: DataFrame in, DataFrame out."""
