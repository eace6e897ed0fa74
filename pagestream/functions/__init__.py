"""Column functions, all of them compositions of Spark built-ins."""
