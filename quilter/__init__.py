"""quilter: block-based image data and training-data preparation on Spark DataFrames."""
