"""factloom: text corpora woven into a weighted fact graph and queried with Spark DataFrames."""
