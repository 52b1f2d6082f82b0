"""Scalar Column functions: calendar parts, text cleaning, numeric helpers.

Everything here returns a ``pyspark.sql.Column`` built from native
functions, so it stays inside whole-stage code generation.
"""
