"""formline: point-in-time form, trajectory and valuation operators on Spark DataFrames."""
