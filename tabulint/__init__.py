"""A PySpark-native engine for code and text analytics.

Everything is a column-parameterised DataFrame transform: callers pass the
DataFrames and the column names, Catalyst picks the physical strategy.
"""
