"""modengine: chat moderation and corpus preparation on Spark DataFrames."""
