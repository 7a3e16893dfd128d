"""Reusable relational, retrieval and learning operators: DataFrame in, DataFrame out."""
