"""timeloom: interval, time-series, ranking and semi-structured analytics as Spark DataFrames."""
