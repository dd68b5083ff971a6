"""lodestrata: corpus analytics on Spark. Every operator is a function from DataFrames to a DataFrame."""
