"""tickloom: microstructure and panel analytics on Spark DataFrames."""
