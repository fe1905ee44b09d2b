"""Source code as data: a code-intelligence engine on Spark DataFrames."""
