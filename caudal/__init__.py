"""Banking analytics on Spark DataFrames: raw -> cleaned -> metrics."""
