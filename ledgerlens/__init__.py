"""ledgerlens: filing-text analytics, retrieval, event studies and evaluation on Spark.

Every public operator is a function from DataFrames (and Columns) to DataFrames
that runs on Spark's own engine.  See README.md for the operator map.
"""

__version__ = "0.1.0"
