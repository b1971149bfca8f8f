"""Entity queries and corpus processing on PySpark DataFrames."""
