"""Speech-analytics operators on Spark DataFrames."""
