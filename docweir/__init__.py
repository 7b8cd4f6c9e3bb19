"""Document-intake analytics expressed as Spark DataFrame operators.

Every public operator takes DataFrames (or Columns) and returns a DataFrame
(or a Column).  Nothing in the package reads a clock or a random source: the
caller passes ``today``/``now``, thresholds and keys.
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
