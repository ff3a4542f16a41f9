"""Operators for preparing training text, on Spark.

Every operator takes DataFrames and column names, reads only the columns it is
told to read, and returns a DataFrame.  Nothing outside this subpackage
imports it.
"""
