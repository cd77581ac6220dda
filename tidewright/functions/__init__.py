"""Scalar functions and aggregates of the dialect as Spark columns."""
