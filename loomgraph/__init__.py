"""Graph analytics and table operators on Spark DataFrames."""
