"""tarja: detect, validate, mask and evaluate personal data in Spark DataFrames."""
