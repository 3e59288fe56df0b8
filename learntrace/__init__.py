"""Training-dynamics and example scoring on Spark DataFrames."""
