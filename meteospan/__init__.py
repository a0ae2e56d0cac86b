"""Station series, scenario ensembles and pair-copula analysis on Spark DataFrames."""
