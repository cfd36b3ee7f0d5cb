"""Query and analysis of text collections on Spark DataFrames."""
