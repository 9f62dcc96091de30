"""Software-supply-chain analytics on Spark DataFrames."""
