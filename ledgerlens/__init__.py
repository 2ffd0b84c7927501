"""Transaction-risk analytics on a bank star schema, written as Spark DataFrame jobs."""
