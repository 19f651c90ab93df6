"""Column functions. All are compositions of Spark built-ins."""
