"""strata: a transactional event-table layer whose tables are ordinary Spark DataFrames."""
