"""Flight-delay and event-trajectory analytics on Spark DataFrames."""
