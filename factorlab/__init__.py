"""Non-negative matrix factorization with covariates, and the statistics around it, on Spark DataFrames."""
