"""Spark-native dataset preparation and classifier evaluation.

Every operator takes DataFrames and returns a DataFrame; plans compose operators and
stage their narrow intermediate tables in the cluster's shared folder.
"""

__version__ = "0.1.0"
