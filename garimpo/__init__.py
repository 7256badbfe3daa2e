"""garimpo: clinical-text de-identification analytics on Spark DataFrames."""
