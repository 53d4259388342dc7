"""Graph analytics and corpus preparation on Spark DataFrames."""
