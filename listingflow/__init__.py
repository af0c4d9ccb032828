"""listingflow: curating award and funding listings with Spark DataFrames."""
