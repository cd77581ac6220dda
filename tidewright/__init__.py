"""A streaming-SQL and event-pattern library on Spark: queries over ordered events as DataFrames."""
