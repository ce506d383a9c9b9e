"""strandset: sets of fixed-length DNA words on Spark DataFrames."""
