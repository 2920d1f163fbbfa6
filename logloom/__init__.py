"""PostgreSQL server logs as Spark DataFrames, and reports over them."""
