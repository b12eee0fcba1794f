"""Document-layout analytics and text preparation on Spark DataFrames."""
