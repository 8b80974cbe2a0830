"""pixelloom: image analytics on Spark, with collections of images as DataFrames."""
