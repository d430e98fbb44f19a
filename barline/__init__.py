"""Cross-sectional ranking of time series on Spark DataFrames."""
