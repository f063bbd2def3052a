"""E-mail classification and evaluation on Spark DataFrames."""
