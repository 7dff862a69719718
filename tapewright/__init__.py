"""Price/volume time-series analytics and corpus tools on Spark DataFrames."""
