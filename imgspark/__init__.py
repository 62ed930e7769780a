"""A PySpark-native image analytics engine: frames and pixels as DataFrames."""
