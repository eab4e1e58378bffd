"""Job-posting analytics on Spark: operators are functions from DataFrames to a DataFrame."""
