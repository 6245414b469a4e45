"""Spark-native text mining and representation comparison.

Every operator is a function from DataFrames and parameters to a DataFrame;
nothing runs until the caller writes or collects, except model fitting.
"""
