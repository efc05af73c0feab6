"""Media catalogue and duplicate detection on Spark DataFrames."""
