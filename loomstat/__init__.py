"""Spark-native table, text and metric analytics.

Everything takes and returns DataFrames (or Columns) and stays lazy unless a
docstring says otherwise.
"""

__version__ = "0.1.0"
