"""Operators over canonical samples: DataFrame in, DataFrame out."""
