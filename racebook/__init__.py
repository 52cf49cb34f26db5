"""Race probability, odds and verification analytics on PySpark DataFrames."""
