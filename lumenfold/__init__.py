"""A PySpark-native analytics engine: operators as functions from DataFrames to DataFrames."""
