"""Analytics of records with two clocks, an incident and a later receipt, on Spark DataFrames."""
