"""Sequence analytics on Spark DataFrames.

Sequences are distributed rows, models are small driver-side objects that are
sent to the executors, and every operator takes and returns a DataFrame.
"""

__version__ = "0.1.0"
