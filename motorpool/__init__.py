"""Set-based operators for mobility-fleet analytics on Spark DataFrames."""
