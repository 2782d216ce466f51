"""Relational operators over inventory tables: DataFrame in, DataFrame out."""
