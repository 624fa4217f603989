"""Time-series analytics and strategy simulation on Spark DataFrames."""
