"""Evidence graphs over large text collections, built from Spark DataFrames."""
